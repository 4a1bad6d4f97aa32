"""Texts that share most of their word shingles, found by SimHash and checked exactly.

Two texts with four fifths of their shingles in common differ in some 15 % of the bits of
their SimHash. The bits are cut into blocks of 16, in one of which such texts mostly
differ in one bit at most; the anchors of that block's covering code, the Hamming code,
bring them together, as :mod:`simhash` does. What comparisons at anchors find close in all
bits makes neighbourhoods, for which a spanning forest of each task is enough. The texts of
a neighbourhood then meet, and all its pairs that can be similar are checked on the shingles
themselves. Only links that hold are thinned to forests, which join what all of them join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fixed, mixed, released, slices, utf8, word_hashes
from .components import components
from .simhash import CODE_BITS, _forest, _hamming, deal_out, sorted_members

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
SIMILARITY = (4, 5)
BLOCKS = 8
BLOCK_BITS = 16
#: Differing bits of all 128 up to which texts are neighbours; at the least similarity 19 are expected.
CLOSE = 30
PAIRS = 2 << 20
#: Links that a task holds before it gives their forest.
LINKS = 1 << 20
#: Shingles of a neighbourhood that are checked at a time; more are dealt out in pairs of tiles.
TILE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BATCH = 2 << 20


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, int]]:
    """For each text the sorted hashes of its different shingles, and a hash of all its words.

    Words are lower-cased by A-Z. A text of fewer words is one shingle, one without words none.
    """
    data, offsets = utf8(texts)
    data = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
    words, docs = word_hashes(data, offsets)
    bounds = np.searchsorted(docs, np.arange(len(offsets)))
    for begin, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        of = words[begin:stop]
        n = max(len(of) - shingle + 1, min(len(of), 1))
        sums = np.zeros(n, np.uint64)
        for j in range(min(shingle, len(of))):
            sums = mixed(sums * _STEP + of[j : j + n] + np.uint64(j + 1))
        with np.errstate(over="ignore"):
            place = mixed(np.arange(1, len(of) + 1, dtype=np.uint64) * _STEP)
            whole = mixed(np.uint64(len(of)) + np.sum(mixed(of ^ place), dtype=np.uint64))
        yield np.unique(sums), int(whole.astype(np.int64))


def _simhash(hashes: np.ndarray) -> tuple[int, int]:
    """Two words of 64 bits, each bit set where it is set in over half of ``hashes`` mixed anew."""
    out = []
    for k in (1, 2):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            made = mixed(hashes[at : at + (1 << 16)] + np.uint64(k * int(_STEP) % (1 << 64)))
            ones += np.unpackbits(made.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0]))
    return out[0], out[1]


def text_prints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, bits: bool = True) -> DataFrame:
    """``docs`` without ``text`` and with ``node``, a hash of its words, ``shingles``, their number, and ``p1``, ``p2``, its SimHash.

    Without ``bits`` there is ``node`` alone.
    """
    names = ["node", "shingles", "p1", "p2"] if bits else ["node"]
    kept = [c for c in docs.columns if c != text]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    source = docs.select(*kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            for first, stop in slices(utf8(texts)[1], _BATCH):
                part = texts.slice(first, stop - first)
                rows = [(node, *((len(s), *_simhash(s)) if bits else ())) for s, node in shingle_sets(part, shingle)]
                made = [pa.array(c, pa.int64()) for c in zip(*rows)]
                others = batch.slice(first, stop - first).columns[:-1]
                yield pa.RecordBatch.from_arrays([*others, *made], names=[*kept, *names])

    return source.mapInArrow(released(run), ", ".join([*fields, *(f"{n} long" for n in names)]))


def _anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and whether it is the home (0) or a guest (1), of rows of two 64-bit words."""
    home, near = _hamming()
    found = []
    for block in range(BLOCKS):
        word = prints[:, block * BLOCK_BITS // 64].view(np.uint64)
        part = (word >> np.uint64(block * BLOCK_BITS % 64)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)
        code, plain = part & ((1 << CODE_BITS) - 1), part >> CODE_BITS << CODE_BITS
        base, rows = block << 32, np.arange(len(part))
        found.append((base | plain | home[code], rows, 0))
        for other in near[code].T:
            there = other >= 0
            found.append(((base | plain | other)[there], rows[there], 1))
        found.append(((base | plain | home[code]) ^ (1 << CODE_BITS), rows, 1))
    return tuple(np.concatenate([np.broadcast_to(f[k], len(f[1])) for f in found]) for k in range(3))


_OF_NODE = ("node", "shingles", "p1", "p2")


def _members(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            anchor, row, guest = _anchors(np.column_stack(values[2:]))
            columns = [pa.array(anchor.astype(np.int64)), *(pa.array(v[row]) for v in values), pa.array(guest.astype(np.int8))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", *_OF_NODE, "guest"])

    schema = ", ".join(["anchor long", *(f"{c} long" for c in _OF_NODE), "guest tinyint"])
    return nodes.select(*_OF_NODE).mapInArrow(released(run), schema)


def least_forest(a: np.ndarray, b: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Numbers of the links of a least spanning forest: the narrowest that join what all links join."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((b, a, width))] = np.arange(len(a))
    by_rank = np.argsort(rank)
    label, chosen = np.arange(len(nodes)), np.zeros(len(a), bool)
    while True:
        across = np.flatnonzero(label[left] != label[right])
        if not len(across):
            return np.flatnonzero(chosen)
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, label[left[across]], rank[across])
        np.minimum.at(best, label[right[across]], rank[across])
        picked = by_rank[np.unique(best[best < len(a)])]
        chosen[picked] = True
        u, v = left[picked], right[picked]
        while (label[u] != label[v]).any():
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            while (new[new] != new).any():
                new = new[new]
            label = new[label]


def _close_pairs(
    keys: np.ndarray, node: np.ndarray, shingles: np.ndarray, prints: np.ndarray, guest: np.ndarray, close: int, similarity: tuple[int, int]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forests of the neighbours among the members of whole anchors, sorted so that homes come before guests."""
    change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    begins, ends = np.concatenate([[0], change]), np.concatenate([change, [len(keys)]])
    group = np.repeat(np.arange(len(begins)), ends - begins)
    homes = np.flatnonzero(guest == 0)
    first = (begins + np.bincount(group[homes], minlength=len(begins)))[group[homes]]
    size = ends[group[homes]] - first
    total, at = np.cumsum(size), 0
    bits = prints.view(np.uint64)
    least, whole = similarity
    while at < len(homes):
        done = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        count = size[at:stop]
        left = np.repeat(homes[at:stop], count)
        right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[at:stop], count)
        at = stop
        width = np.bitwise_count(bits[left, 0] ^ bits[right, 0]).astype(np.int64)
        some = np.flatnonzero(width <= close)
        left, right, width = left[some], right[some], width[some]
        width += np.bitwise_count(bits[left, 1] ^ bits[right, 1])
        some = (width <= close) & (node[left] != node[right])
        fewer, more = np.minimum(shingles[left], shingles[right]), np.maximum(shingles[left], shingles[right])
        # Sets of other sizes are not similar, nor small ones that differ at all.
        some &= (fewer * whole >= more * least) & ((fewer * (whole - least) >= least) | (width == 0))
        if some.any():
            a, b = node[left[some]], node[right[some]]
            kept = least_forest(a, b, width[some])
            yield a[kept], b[kept]


def _compare(close: int, similarity: tuple[int, int]):
    def stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = _forest(*map(np.concatenate, zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for key, (node, shingles, p1, p2, guest) in sorted_members(batches):
            for found in _close_pairs(key, node, shingles, np.column_stack([p1, p2]), guest, close, similarity):
                held.append(found)
                n += len(found[0])
                if n > LINKS:
                    yield stars(held)
                    held, n = [], 0
        if held:
            yield stars(held)

    return run


def neighbourhoods(nodes: DataFrame, close: int = CLOSE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``node`` and ``root`` of all ``nodes`` (node, shingles, p1, p2) that have neighbours, the root itself included.

    Neighbours are close in their SimHash and of sizes that similar sets may have;
    nodes of one root are those that neighbours join.
    """
    dealt = deal_out(_members(nodes), "node", _OF_NODE)
    links = dealt.mapInArrow(released(_compare(close, similarity)), "a long, b long").distinct()
    # A node has a link for each task at most. All to its smallest one, of which there are few.
    least = links.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    links = least.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
    roots = components(links.select("l.a", "l.b").distinct())
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ranges, on end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - begins, sizes)


def similar_forest(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ``sets`` (of different values each) linked by a forest that joins what all similar pairs join.

    Similar sets share one of their rarest values, as many of which are indexed as may be
    missing in the other, and one. Sets that are joined already are not looked at again.
    """
    least, whole = similarity
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    value = rank[value]
    value = value[np.lexsort((value, row))]
    begin = np.cumsum(size) - size
    prefix = np.minimum(size, size - -(-least * size // whole) + 1)
    rare = _ranges(begin, prefix)
    rare = rare[np.argsort(value[rare], kind="stable")]
    free, marked, links = np.ones(len(sets), bool), np.zeros(len(count), bool), []

    def index() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = row[rare]
        keep = free[of]
        sizes = np.bincount(value[rare[keep]], minlength=len(count))
        return of[keep], np.cumsum(sizes) - sizes, sizes

    holders, starts, sizes = index()
    indexed = left = len(sets)
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed], waiting = False, [seed]
        left -= 1
        while waiting and left:
            i = waiting.pop()
            own = value[begin[i] : begin[i] + size[i]]
            some = holders[_ranges(starts[own[: prefix[i]]], sizes[own[: prefix[i]]])]
            some = np.unique(some[free[some]])
            some = some[(size[some] * whole >= size[i] * least) & (size[i] * whole >= size[some] * least)]
            marked[own] = True
            # Not all at once: about TILE values.
            cut = np.flatnonzero(np.diff(np.cumsum(size[some]) // TILE)) + 1
            for part in np.split(some, cut) if len(some) else []:
                common = np.add.reduceat(marked[value[_ranges(begin[part], size[part])]], np.cumsum(size[part]) - size[part], dtype=np.int64)
                part = part[common * (least + whole) >= (size[part] + size[i]) * least]
                links.append((np.full(len(part), i), part))
                free[part] = False
                left -= len(part)
                waiting += part.tolist()
            marked[own] = False
            if 2 * left < indexed:
                (holders, starts, sizes), indexed = index(), left
    none = np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip((none, none), *links)))


def _similar(shingle: int, similarity: tuple[int, int]):
    """Links that hold among the texts of each (root, i, j), of rows sorted by these."""

    def links(node: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        of = np.array(node, np.int64)
        return tuple(of[k] for k in similar_forest(sets, similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, sets = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            nodes, texts, at, found = batch.column(3).to_pylist(), batch.column(4), 0, []
            for first, stop in slices(utf8(texts)[1], _BATCH):
                for made, _ in shingle_sets(texts.slice(first, stop - first), shingle):
                    if keys[at] != key:
                        if len(sets) > 1:
                            found.append(links(node, sets))
                        key, node, sets = keys[at], [], []
                    node.append(nodes[at])
                    sets.append(made)
                    at += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])
        if len(sets) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in links(node, sets)], names=["a", "b"])

    return run


def similar_links(near: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join all texts of one neighbourhood whose similarity is reached.

    ``near`` has node and root, ``nodes`` node and shingles, ``texts`` node and text. The
    similarity is that of sets of shingles, common ones over all. Every pair of a
    neighbourhood meets: a large one is cut into tiles, of which each two meet.
    """
    sized = nodes.select(F.col("node").alias("__node"), "shingles")
    sized = fixed(near.join(sized, F.col("node") == F.col("__node")).drop("__node"))
    tiles = sized.groupBy(F.col("root").alias("__root")).agg(F.ceil(F.sum(F.col("shingles") + 16) / tile).cast("int").alias("__tiles"))
    own = F.pmod(F.xxhash64("node"), F.col("__tiles")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("__tiles") - 1), lambda k: (F.col("__tiles") == 1) | (k != F.col("own")))
    dealt = sized.join(tiles, F.col("root") == F.col("__root")).withColumn("own", own)
    dealt = dealt.select(F.col("node").alias("__node"), "root", "own", F.explode(others).alias("other"))
    one = texts.groupBy("node").agg(F.any_value("text").alias("text"))
    met = one.join(dealt, F.col("node") == F.col("__node")).select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "text"
    )
    parts = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return met.mapInArrow(released(_similar(shingle, similarity)), "a long, b long")


def near_text_groups(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, close: int = CLOSE) -> DataFrame:
    """``docs`` without ``text`` and with ``node`` and ``root``: rows of one root are near copies.

    Rows of equal words share a node; nodes are linked where their sets of shingles are
    as similar as ``similarity`` says, and groups are what links join. NULL is the empty
    text; texts without words are one node. Ids are not looked at. Repeated rows keep a
    row each, an empty table gives none.
    """
    prints = fixed(text_prints(docs, text, shingle))
    first = [F.any_value(c).alias(c) for c in _OF_NODE[1:]]
    nodes = fixed(prints.groupBy("node").agg(*first))
    twice = docs.select(F.col(text).alias("text"), F.col(text).alias("__text"))
    texts = text_prints(twice, "__text", shingle, bits=False)
    roots = components(similar_links(neighbourhoods(nodes, close, similarity), nodes, texts, shingle, similarity))
    return _rooted(prints, roots).select(*[c for c in docs.columns if c != text], "node", "root")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the ``root`` of their group: the smallest node, of one alone itself."""
    roots = fixed(roots.select(F.col("node").alias("__node"), "root"))
    joined = nodes.join(roots, F.col("node") == F.col("__node"), "left").drop("__node")
    return joined.withColumn("root", F.coalesce("root", "node"))
