"""SimHash fingerprints of word shingles, and their links by anchor-point covering.

Fingerprints that differ in few bits agree in one of a few blocks but for at most one
bit. In a block, 15 bits are covered by the Hamming code: every value is within one
bit of exactly one codeword, its home anchor. The block's other bits are part of the
anchor as they are. A fingerprint goes to its home, as such, and as a guest to every
anchor within the covering radius plus one bit, so that any two that are close in a
block meet as home and guest. Each anchor compares its own, and gives links that
connect what is close without all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fixed, released, utf8
from .components import components

BITS = 64
CODE_BITS = 15
SHINGLE = 4
SEED = 42
THRESHOLD = 4
SPLIT = 4096  # members of an anchor that one comparison takes; more are dealt out in tiles
PAIRS = 2 << 20  # compared at a time


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The 8 bytes of a text's fingerprint, highest bit first; no words give zero."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(shingle, len(words)) - 1
    digest, ones, n = xxhash.xxh64_digest, np.zeros(BITS, np.int64), len(words) - last
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        spans = zip(starts[k : min(n, k + (1 << 16))].tolist(), ends[k + last : k + last + (1 << 16)].tolist(), strict=False)
        hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        data = data.tobytes()
        made = b"".join(fingerprint(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        prints = np.frombuffer(made, ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``print``, the 64-bit fingerprint as a signed number, of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(_fingerprints), "doc_id long, print long")


@cache
def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit value its codeword, and all codewords within two bits (-1: none)."""
    values = np.arange(1 << CODE_BITS)
    syndrome = np.zeros(len(values), np.int64)
    for bit in range(CODE_BITS):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    flip = np.concatenate([[0], 1 << np.arange(CODE_BITS)])  # by syndrome
    home = values ^ flip[syndrome]
    near = np.full((len(values), 1 + CODE_BITS // 2), -1)
    near[:, 0] = home
    for s in range(1, CODE_BITS + 1):
        pairs = [flip[i] ^ flip[i ^ s] for i in range(1, CODE_BITS + 1) if i < i ^ s]
        rows = values[syndrome == s]
        near[rows, 1 : 1 + len(pairs)] = rows[:, None] ^ np.array(pairs)
    return home, near


def blocks(threshold: int) -> list[tuple[int, int]]:
    """Shift and width of blocks, one of which holds at most one of ``threshold`` differing bits."""
    n = max(3, threshold // 2 + 1)  # an anchor fits in 32 bits
    edges = [BITS * k // n for k in range(n + 1)]
    out = [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if not 0 <= threshold or min(w for _, w in out) < CODE_BITS:
        raise ValueError(f"a threshold of {threshold} bits is not covered")
    return out


def anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and whether it is the home (0) or a guest (1), for all fingerprints."""
    home, near = _hamming()
    values = prints.astype(np.int64).view(np.uint64)
    rows = np.arange(len(values))
    found = []
    for k, (shift, width) in enumerate(blocks(threshold)):
        part = (values >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
        code, plain = part & ((1 << CODE_BITS) - 1), part >> CODE_BITS << CODE_BITS
        base = k << 32
        own = base | plain | home[code]
        found.append((own, rows, 0))
        for other in near[code].T:  # the codeword of the value itself, or two bits off
            there = other >= 0
            found.append(((base | plain | other)[there], rows[there], 1))
        for bit in range(CODE_BITS, width):
            found.append((own ^ (1 << bit), rows, 1))
    return (
        np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]),
        np.concatenate([np.full(len(f[0]), f[2], np.int8) for f in found]),
    )


def _members(prints: DataFrame, threshold: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            anchor, row, guest = anchors(values, threshold)
            columns = [pa.array(anchor), pa.array(values[row]), pa.array(guest)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "print", "guest"])

    return prints.select("print").mapInArrow(released(run), "anchor long, print long, guest tinyint")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node of a graph to the smallest of its component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def _links_of(keys: np.ndarray, values: np.ndarray, guest: np.ndarray, threshold: int) -> Iterator[pa.RecordBatch]:
    """Links among the members of whole anchors, sorted so that homes come before guests."""
    change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    begins = np.concatenate([[0], change])
    ends = np.concatenate([change, [len(keys)]])
    group = np.repeat(np.arange(len(begins)), ends - begins)
    homes = np.flatnonzero(guest == 0)
    n_homes = np.bincount(group[homes], minlength=len(begins))
    first = (begins + n_homes)[group[homes]]
    size = ends[group[homes]] - first
    total, at = np.cumsum(size), 0
    bits = values.view(np.uint64)
    while at < len(homes):
        done = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        count = size[at:stop]
        left = np.repeat(homes[at:stop], count)
        right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[at:stop], count)
        close = (np.bitwise_count(bits[left] ^ bits[right]) <= threshold) & (values[left] != values[right])
        at = stop
        if close.any():
            a, b = _forest(values[left[close]], values[right[close]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def sorted_members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Keys (anchor, i, j) and other columns of sorted members, whole anchors at a time."""
    held: list[tuple[np.ndarray, ...]] = []

    def gathered() -> tuple[np.ndarray, list[np.ndarray]]:
        key, *columns = map(np.concatenate, zip(*held, strict=True))
        return key, columns

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
        columns = [c.to_numpy() for c in batch.columns[3:]]
        # The last anchor of a batch may go on in the next one.
        cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key[0] != key[-1]).any() else 0
        if cut:
            held.append((key[:cut], *(c[:cut] for c in columns)))
            yield gathered()
            held = []
        elif held and (held[-1][0][-1] != key[-1]).any():
            yield gathered()
            held = []
        held.append((key[cut:], *(c[cut:] for c in columns)))
    if held:
        yield gathered()


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (value, guest) in sorted_members(batches):
            yield from _links_of(key, value, guest, threshold)

    return run


def deal_out(members: DataFrame, by: str, columns: tuple[str, ...]) -> DataFrame:
    """Members (anchor, ``columns``, guest) brought together by anchor and sorted, homes first.

    An anchor with more than ``SPLIT`` members is dealt out: its homes and its guests are
    cut into tiles by ``by``, and each pair of tiles is compared on its own, so that no
    task holds a hot anchor.
    """
    hot = members.groupBy(F.col("anchor").alias("__anchor")).count().filter(F.col("count") > SPLIT)
    hot = fixed(hot.select("__anchor", F.ceil(F.col("count") / SPLIT).cast("int").alias("__tiles")))
    if hot.isEmpty():
        dealt = members.select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), *columns, "guest")
    else:
        tiles = F.coalesce("__tiles", F.lit(1))
        own = F.pmod(F.xxhash64(by), tiles).cast("int")
        met = members.join(hot, F.col("anchor") == F.col("__anchor"), "left").select(
            "anchor", *columns, "guest", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
        )
        home = F.col("guest") == 0
        dealt = met.select(
            "anchor", F.when(home, F.col("own")).otherwise(F.col("other")).alias("i"),
            F.when(home, F.col("other")).otherwise(F.col("own")).alias("j"), *columns, "guest",
        )
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "guest")


def close_links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints at ``threshold`` or fewer differing bits.

    ``prints`` has distinct values ``print``.
    """
    dealt = deal_out(_members(prints, threshold), "print", ("print",))
    return dealt.mapInArrow(released(_compare(threshold)), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id``, ``print`` and ``component_id`` of every row of ``docs``.

    Texts whose fingerprints differ in at most ``threshold`` bits are linked; a
    component is named by its smallest doc_id. NULL and empty texts have fingerprint
    zero and are linked like others. A NULL doc_id counts only where its component has
    no other; repeated rows keep a row each.
    """
    prints = fixed(fingerprints(docs))
    firsts = fixed(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(close_links(firsts, threshold))
    rooted = fixed(
        firsts.join(roots, F.col("print") == F.col("node"), "left").select(
            "print", "first", F.coalesce("root", "print").alias("root")
        )
    )
    smallest = fixed(rooted.groupBy(F.col("root").alias("__root")).agg(F.min("first").alias("component_id")))
    named = fixed(
        rooted.join(smallest, F.col("root") == F.col("__root")).select(F.col("print").alias("__print"), "component_id")
    )
    return prints.join(named, F.col("print") == F.col("__print")).select("doc_id", "print", "component_id")


def op10_simhash(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
