"""Approximate nearest neighbours by collision counting.

Each vector is projected on many random lines; each line is one sorted array. A
query's window on each array is centred at its own projection and widened step by
step (virtual rehashing: the arrays stay as they are). A vector that falls into
enough windows is verified by its true inner product. The windows stop widening when
vectors as near as the k-th one found would, with high probability, have been in
enough windows already, so no count of candidates is fixed.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fixed
from .vectors import each_length, every, lifted, packed_vectors, ranked, unpacked

LINES = 48
CERTAINTY = 0.95  # for a vector as near as the k-th found to have been verified
GROWTH = 1.5  # of a window's width in a step
SLICE_ROWS = 8192
BLOCK_QUERIES = 1024
SEED = 20


def collision_rule(lines: int, certainty: float, rate: float = 0.62) -> tuple[int, float]:
    """Windows that a vector must fall into, and the half-width for a distance of 1.

    At that half-width a vector at distance 1 falls into a window with probability
    ``rate``, and into the needed number of them with ``certainty``.
    """
    chance = lambda n: math.comb(lines, n) * rate**n * (1 - rate) ** (lines - n)
    needed, below = 0, 0.0
    while below + chance(needed) <= 1 - certainty:
        below += chance(needed)
        needed += 1
    return needed, NormalDist().inv_cdf((1 + rate) / 2)


class CollisionIndex:
    """Sorted arrays of the projections of a slice's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, lines: int = LINES):
        order = np.argsort(ids)
        self.ids, self.vectors, self.most = ids[order], vectors[order], most
        rng = np.random.default_rng(SEED)
        self.lines = rng.standard_normal((vectors.shape[1] + 1, lines))
        projected = (lifted(self.vectors, most) @ self.lines).T
        self.places = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.places, axis=1)
        self.needed, self.unit = collision_rule(lines, CERTAINTY)

    def _guess(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Where the k-th largest product may lie, from some of the vectors."""
        some = self.vectors[:: -(-len(self.ids) // 256)] @ queries.T
        tail = NormalDist().inv_cdf(max(0.5, 1 - (k + 1) / (len(self.ids) + 2)))
        return some.mean(axis=0) + tail * some.std(axis=0)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """Places of each query's ``k`` nearest found, best first."""
        n, lines = self.sorted.shape[1], len(self.sorted)
        centre = queries @ self.lines[:-1]  # queries are not lifted
        square = np.einsum("ij,ij->i", queries, queries) + self.most
        # The first width is a guess; it has no effect on what the last one must cover.
        half = self.unit * np.sqrt(np.maximum(0.0, square - 2 * self._guess(queries, k))) + 1e-12
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        scores: list[np.ndarray] = [np.zeros(0)] * len(queries)
        state: list[tuple | None] = [None] * len(queries)
        active = np.arange(len(queries))
        while len(active):
            low = np.array([a.searchsorted(c - half[active]) for a, c in zip(self.sorted, centre[active].T, strict=True)])
            high = np.array([a.searchsorted(c + half[active], "right") for a, c in zip(self.sorted, centre[active].T, strict=True)])
            again = []
            for i, a, b in zip(active, low.T.tolist(), high.T.tolist(), strict=True):
                if state[i] is None:
                    parts = [self.places[j, a[j] : b[j]] for j in range(lines)]
                    counts, seen = np.zeros(n, np.int64), self.ids == own[i]
                else:  # what the wider windows add
                    counts, seen, c, d = state[i]
                    parts = [self.places[j, a[j] : c[j]] for j in range(lines)]
                    parts += [self.places[j, d[j] : b[j]] for j in range(lines)]
                counts += np.bincount(np.concatenate(parts), minlength=n)
                new = np.flatnonzero((counts >= self.needed) & ~seen)
                seen[new] = True
                if len(new):
                    place = np.concatenate([found[i], new])
                    score = np.concatenate([scores[i], self.vectors[new] @ queries[i]])
                    if len(place) > k:
                        kept = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                        place, score = place[kept], score[kept]
                    best = np.lexsort((place, -score))[:k]
                    found[i], scores[i] = place[best], score[best]
                if seen.all():
                    continue
                if len(found[i]) == k:
                    distance = self.unit * math.sqrt(max(0.0, square[i] - 2 * scores[i][-1]))
                    if half[i] >= distance:
                        continue
                    half[i] = distance  # no wider than the k-th found asks for
                else:
                    half[i] *= GROWTH
                state[i] = (counts, seen, a, b)
                again.append(i)
            active = np.array(again, np.int64)
        return found


def _solve(dim: int, most: float, k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if queries.num_rows and data.num_rows:
            index = CollisionIndex(data["vec_id"].to_numpy(), unpacked(data["vector"], dim), most)
            asked, q = queries["vec_id"].to_numpy(), unpacked(queries["vector"], dim)
            for own, query, found in zip(asked, q, index.search(asked, q, k), strict=True):
                out[0].append(np.full(len(found), own))
                out[1].append(index.ids[found])
                # One fixed order of adding, whatever else was verified along with a vector.
                out[2].append(np.array([float((index.vectors[i] * query).sum()) for i in found]))
        types = (pa.int64(), pa.int64(), pa.float64())
        columns = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types, strict=True)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    return run


FOUND = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's ``k`` largest inner products found.

    Both frames come from :func:`~.vectors.packed_vectors`. Every vector is in the
    index, with those of its own length. A vector that has the query's id is no candidate;
    equal scores go to the smaller id. Different vectors of one id are candidates each, and
    as queries share one list. Without data or queries there are no rows.
    """
    vectors, queries = fixed(vectors), fixed(queries)
    return ranked(each_length(vectors, queries, lambda *of: _of_length(*of, k), FOUND), k)


def _of_length(vectors: DataFrame, queries: DataFrame, dim: int, n: int, most: float, k: int) -> DataFrame:
    slices, blocks = -(-n // SLICE_ROWS), -(-max(1, queries.count()) // BLOCK_QUERIES)
    part = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    steps = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # Blocks of queries meet slices of the data.
    asked = queries.select("vec_id", "vector", part(blocks).alias("block"), steps(slices).alias("slice"))
    data = vectors.select("vec_id", "vector", part(slices).alias("slice"), steps(blocks).alias("block"))
    return asked.groupBy("block", "slice").cogroup(data.groupBy("block", "slice")).applyInArrow(_solve(dim, most, k), FOUND)


def op7_ann(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest found, by inner product, of every 20th vector among all others of its length.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components take no part,
    nor do rows without an id. Rows that agree in id and vector are one. Ties go to the
    smaller id; an empty table gives no row. See :func:`nearest`.
    """
    vectors = fixed(packed_vectors(embeddings, drop_zero=True))
    return nearest(vectors, vectors.filter(every(20)), 20)
