"""Exact search for the largest inner products by a Voronoi kNN join.

Vectors are lifted so that a query's nearest neighbours are its largest inner
products. Queries and data are cut into the Voronoi cells of common pivots. From each
cell's extent and its smallest distances to the pivot comes a bound on how far a
query of a cell can be from its k-th neighbour; a vector goes only to those groups of
query cells whose bound it can meet. Each group is solved locally, in slices of
bounded size, and the slices' best are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fixed
from .vectors import each_length, every, lifted, packed_vectors, ranked, unpacked

#: Sampled vectors, one for so many of the square root of all, at least and at most so many.
PIVOT_SHARE, LEAST_PIVOTS, MOST_PIVOTS = 2, 64, 1024
#: Rows of one id that bounds allow for; with an id of more, nothing is pruned.
ROWS_OF_AN_ID = 64
GROUP_QUERIES = 512
SLICE_ROWS = 8192
SLACK = 1e-6  # relative, for rounding in distances
#: Squared lengths from which products may not fit in 64 bits, and from which distances are
#: taken of vectors made smaller by a power of two, so that none is infinite.
LARGE, TOO_LARGE, SHRINK = 2.0**62, 1e300, 2.0**-560


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(0.0, square))


def _cells(pivots: np.ndarray, most: float, lift: bool, shrink: float):
    """Each vector's nearest pivot and its distance; queries are not lifted."""
    dim = pivots.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(1), dim) * shrink
            x = lifted(x, most) if lift else np.column_stack([x, np.zeros(len(x))])
            d = _distances(x, pivots)
            cell = d.argmin(axis=1)
            made = [pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["vec_id", "vector", "cell", "far"])

    return run


def _bounds(between: np.ndarray, reach: np.ndarray, nearest: list[list[float]], k: int) -> np.ndarray:
    """For each query cell, a distance within which each of its queries has ``k`` data."""
    out = np.full(len(reach), np.inf)
    for i, r in enumerate(reach):
        if r >= 0:
            reachable = sorted(r + between[i, j] + d for j, near in enumerate(nearest) for d in near)
            if len(reachable) >= k:
                out[i] = reachable[k - 1]
    return out


def _groups(counts: np.ndarray, between: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Query cells put together along a chain of near pivots, with the blocks to cut each group into."""
    left, chain = [int(i) for i in np.flatnonzero(counts)], []
    while left:
        at = min(left, key=lambda i: (between[chain[-1], i] if chain else 0.0, i))
        left.remove(at)
        chain.append(at)
    out: list[list[int]] = []
    for i in chain:
        if out and counts[out[-1]].sum() + counts[i] <= size:
            out[-1].append(i)
        else:
            out.append([i])
    return [(cells, -(-int(counts[cells].sum()) // size)) for cells in out]


def _replicas(low: np.ndarray, high: np.ndarray, group_cells: list[list[int]], blocks: list[int], slices: list[int]):
    """A row for each group, block and slice that a vector goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = (batch.column(c).to_numpy() for c in (2, 3))
            ids = batch.column(0).to_numpy()
            for g, cells in enumerate(group_cells):
                meets = ((far[:, None] >= low[cells][:, cell].T) & (far[:, None] <= high[cells][:, cell].T)).any(axis=1)
                rows = np.flatnonzero(meets)
                if not len(rows):
                    continue
                part = (ids[rows].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slices[g])
                for block in range(blocks[g]):
                    taken = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), g, np.int32)), pa.array(np.full(len(rows), block, np.int32)),
                            pa.array(part.astype(np.int32)), batch.column(0).take(taken), batch.column(1).take(taken),
                        ],
                        names=["g", "block", "slice", "vec_id", "vector"],
                    )

    return run


def _order(score: int) -> bytes:
    """Bytes that sort as whole numbers of any size a product of doubles has."""
    return (score + (1 << 2200)).to_bytes(280, "big")


def _best_of(products: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, of equal ones those that come first."""
    if len(products) <= k:
        return np.arange(len(products))
    least = np.partition(products, len(products) - k)[len(products) - k]
    above = np.flatnonzero(products > least)
    return np.concatenate([above, np.flatnonzero(products == least)[: k - len(above)]])


def _solve(dim: int, k: int, large: bool):
    """The ``k`` best of a slice for each query of a block: exact integer products."""

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if queries.num_rows and data.num_rows:
            ids = data["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], unpacked(data["vector"], dim)[order]
            asked, q = queries["vec_id"].to_numpy(), unpacked(queries["vector"], dim)
            whole = [[int(v) for v in row] for row in x] if large else []
            for a in range(0, len(q), 64):
                part, own = q[a : a + 64], asked[a : a + 64]
                exact = not large and np.abs(part).max(initial=0) * np.abs(x).max(initial=0) * dim < 2**53
                # Doubles hold the products, or 64 bits do.
                products = part @ x.T if exact else None if large else part.astype(np.int64) @ x.astype(np.int64).T
                for i, query_id in enumerate(own):
                    others = np.flatnonzero(ids != query_id)
                    if large:
                        row = [int(v) for v in part[i]]
                        scores = {int(c): sum(u * v for u, v in zip(row, whole[c], strict=True)) for c in others}
                        best = sorted(scores, key=lambda c: (-scores[c], c))[:k]
                        found = [scores[c] for c in best]
                    else:
                        best = others[_best_of(products[i, others], k)]
                        found = products[i, best].astype(np.int64).tolist()
                    out[0] += [query_id] * len(best)
                    out[1] += ids[best].tolist()
                    out[2] += [max(-(1 << 63), min((1 << 63) - 1, s)) for s in found]
                    out[3] += [_order(s) if large else None for s in found]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
        return pa.table(arrays, names=["query_id", "vec_id", "score", "exact"])

    return run


def _summary(data: DataFrame, k: int) -> DataFrame:
    """Of each cell: rows, largest and ``k`` smallest distances; parts of cells are reduced first."""
    near = lambda column: F.slice(F.array_sort(column), 1, k)
    # Of each part of a cell, what can be among the smallest of the whole.
    first = F.row_number().over(Window.partitionBy("cell", "part").orderBy("far"))
    small = (
        data.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
        .withColumn("r", first)
        .filter(F.col("r") <= k)
        .groupBy("cell")
        .agg(near(F.collect_list("far")).alias("near"))
    )
    extent = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    return extent.join(small, "cell")


FOUND = "query_id long, vec_id long, score long, exact binary"


def largest_products(vectors: DataFrame, queries: DataFrame, k: int, pivots: int | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's ``k`` largest inner products.

    Both frames come from :func:`~.vectors.packed_vectors` and hold whole numbers. Vectors
    are compared with those of their own length. A vector that has the query's id is no
    candidate, equal scores go to the smaller id, and different vectors of one id are
    candidates each; as queries they share one list of ``k``. Ranks are those of the exact
    products, whatever their size; a ``score`` beyond 64 bits is the nearest long. Without
    data or queries there are no rows.
    """
    vectors, queries = fixed(vectors), fixed(queries)
    most = vectors.agg(F.max("square")).first()[0]
    large = most is not None and not most < LARGE
    found = each_length(vectors, queries, lambda *of: _of_length(*of, large, k, pivots), FOUND)
    # The lists of an id's vectors of several lengths are one.
    return ranked(found, k, "exact" if large else "score")


def _of_length(
    vectors: DataFrame, queries: DataFrame, dim: int, n: int, most: float, large: bool, k: int, pivots: int | None
) -> DataFrame:
    pivots = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(n) // PIVOT_SHARE))
    shrink = 1.0
    if not most < TOO_LARGE:
        shrink, most = SHRINK, dim * (2.0**512 * SHRINK * 2.0**512) ** 2
    of_one_id = vectors.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("vector").toArrow()
    centres = lifted(unpacked(drawn["vector"], dim) * shrink, most)
    between = _distances(centres, centres)
    with_cell = "vec_id long, vector binary, cell int, far double"
    data = fixed(vectors.select("vec_id", "vector").mapInArrow(_cells(centres, most, True, shrink), with_cell))
    asked = fixed(queries.select("vec_id", "vector").mapInArrow(_cells(centres, most, False, shrink), with_cell))
    # Summaries: a few numbers a cell. More neighbours than wanted, as a query's own id is none.
    need = k + min(of_one_id, ROWS_OF_AN_ID)
    nearest: list[list[float]] = [[] for _ in centres]
    sizes, farthest = np.zeros(len(centres), np.int64), np.full(len(centres), -1.0)
    for row in _summary(data, need).collect():
        nearest[row["cell"]], sizes[row["cell"]], farthest[row["cell"]] = row["near"], row["n"], row["far"]
    reach, counts = np.full(len(centres), -1.0), np.zeros(len(centres), np.int64)
    for row in asked.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        reach[row["cell"]], counts[row["cell"]] = row["far"], row["n"]
    bound = _bounds(between, reach, nearest, need)
    if of_one_id > ROWS_OF_AN_ID:
        bound[:] = np.inf
    slack = SLACK * (1.0 + between.max() + np.sqrt(most)) + 1e-6
    low = between - reach[:, None] - bound[:, None] - slack
    high = between + reach[:, None] + bound[:, None] + slack
    groups = _groups(counts, between, GROUP_QUERIES)
    cells, blocks = [g[0] for g in groups], [g[1] for g in groups]
    # At most what the cells hold that a group can need.
    slices = [int(-(-sizes[(farthest >= low[c].min(axis=0))].sum() // SLICE_ROWS)) or 1 for c in cells]
    group_of = np.full(len(centres), -1)
    for g, c in enumerate(cells):
        group_of[c] = g
    replicas = data.mapInArrow(
        _replicas(low, high, cells, blocks, slices), "g int, block int, slice int, vec_id long, vector binary"
    )
    of = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("g") + 1)
    placed = (
        asked.withColumn("g", F.element_at(F.array(*(F.lit(int(v)) for v in group_of)), F.col("cell") + 1))
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), of(blocks)).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), of(slices) - 1)))
        .select("g", "block", "slice", "vec_id", "vector")
    )
    key = ["g", "block", "slice"]
    return placed.groupBy(*key).cogroup(replicas.groupBy(*key)).applyInArrow(_solve(dim, k, large), FOUND)


def op6_topk(embeddings: DataFrame) -> DataFrame:
    """The 5 largest integer inner products of every 50th vector with all others of its length.

    Vectors that are NULL, empty or hold NULL or non-finite components take no part, nor
    do rows without an id. Rows that agree in id and vector are one. Ties go to the smaller id;
    an empty table gives no row. See :func:`largest_products`.
    """
    vectors = fixed(packed_vectors(embeddings, scale=256.0))
    return largest_products(vectors, vectors.filter(every(50)), 5)
