"""Removal of passages that repeat earlier text, by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of words; these are the
index. Every rolling window of a block's length, of all documents, probes it. A block
that some other position matches is an anchor hit. Hits are extended to all windows
of the wanted length that hold one, the windows are compared by 128-bit hashes, and
runs of windows that also start earlier are the maximal repeats. A repeat of 20 words
holds a block of 10 whole, so no repeat is missed.

Documents are grouped in chunks of bounded text, hashes in ranges of bounded size.
What a chunk sends to a range, and gets back as one bit for each hash, is packed, and a
hash is sent once by a chunk however often it occurs there. Nothing but hashes and bits
is joined; the texts are dealt to their chunks by one exchange that all steps share.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, utf8, word_hashes

WINDOW = 20
#: Text of a chunk at least and at most; a range holds the hashes of as much text. Between the
#: two it grows with the square root of all text, since every chunk sends a row to every range.
LEAST_CHUNK, MOST_CHUNK, CHUNK_ROOT = 4 << 20, 64 << 20, 70
#: Documents of a chunk, however short.
CHUNK_ROWS = 200_000
LAST = np.iinfo(np.int64).max  # a missing doc_id comes after all others
_FIRST, _SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def block_words(window: int) -> int:
    """The largest block of which any ``window`` words hold an aligned one."""
    return (window + 1) // 2


def _rolling(words: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """Hash of the ``n`` words from each position on."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * factor + words[k : k + len(out)]
    return out


@dataclass
class Chunk:
    """Hashes of a chunk's words, documents in the order of their ids."""

    table: pa.Table
    ids: np.ndarray
    split: np.ndarray  # whether other chunks may hold rows of a document's id
    doc: np.ndarray  # of each word
    start: np.ndarray  # of each word, within its document
    words: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Chunk:
        ids = table["__id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        table, ids = table.take(pa.array(order)).combine_chunks(), ids[order]
        words, doc = word_hashes(*utf8(table["text"]))
        begins = np.searchsorted(doc, np.arange(len(ids)))
        split = table["__split"].combine_chunks().to_numpy(zero_copy_only=False)
        return cls(table, ids, split, doc, np.arange(len(words)) - begins[doc] if len(words) else doc, words)

    def inside(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each position on are of one document."""
        size = max(0, len(self.words) - n + 1)
        return self.doc[:size] == self.doc[n - 1 : n - 1 + size]

    def probes(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of rolling windows of ``n`` words, their hashes, whether they are blocks."""
        at = np.flatnonzero(self.inside(n))
        return at, mixed(_rolling(self.words, n, _FIRST)[at]), self.start[at] % n == 0

    def windows(self, n: int, hits: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
        """Positions, two hashes and order keys of the windows of ``n`` words that hold a hit."""
        before = np.concatenate([[0], np.cumsum(hits)])
        at = np.flatnonzero(self.inside(n))
        at = at[before[at + n - block + 1] > before[at]]
        one = _rolling(self.words, n, _FIRST)[at]
        two = _rolling(mixed(self.words ^ _SECOND), n, _SECOND)[at]
        # Rows that share a doc_id share its positions.
        rank = np.cumsum(np.concatenate([[0], (self.ids[1:] != self.ids[:-1]).astype(np.int64)]))
        return at, mixed(one), two, (rank[self.doc[at]] << 40) | self.start[at]


def _ranges(hashes: np.ndarray, ranges: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans of the non-empty ranges of sorted ``hashes``, and the ranges' numbers."""
    of = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    edges = [*begins.tolist(), len(of)]
    return list(zip(edges[:-1], edges[1:], strict=True)), of[begins].astype(np.int32)


def _unique(hashes: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, where each hash is in them, whether it occurs twice, any of its flags."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    index = np.cumsum(new) - 1
    inverse = np.empty(len(order), np.int64)
    inverse[order] = index
    begins = np.flatnonzero(new)
    counts = np.diff(np.append(begins, len(ordered)))
    flagged = np.zeros(len(begins), bool)
    flagged[inverse[flags]] = True
    return ordered[begins], inverse, counts > 1, flagged


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _probe_rows(window: int, ranges: int):
    """Step 1: what each chunk asks each range."""
    n = block_words(window)

    def run(table: pa.Table) -> pa.Table:
        chunk = table["__chunk"][0].as_py()
        _, hashes, blocks = Chunk.of(table).probes(n)
        distinct, _, twice, block = _unique(hashes, blocks)
        spans, numbers = _ranges(distinct, ranges)
        low = distinct.astype(np.uint32)
        return pa.table(
            {
                "range": pa.array(numbers, pa.int32()),
                "chunk": pa.array(np.full(len(spans), chunk), pa.int32()),
                "low": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
                "twice": pa.array([_bits(twice[a:b]) for a, b in spans], pa.binary()),
                "block": pa.array([_bits(block[a:b]) for a, b in spans], pa.binary()),
            }
        )

    return run


def _answers(table: pa.Table, kind: int, sizes: list[int], flags: np.ndarray) -> pa.Table:
    """One row for each asking chunk some of whose flags are set."""
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    kept = [k for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if flags[a:b].any()]
    return pa.table(
        {
            "chunk": table["chunk"].take(pa.array(kept, pa.int64())).cast(pa.int32()),
            "kind": pa.array(np.full(len(kept), kind), pa.int32()),
            "range": table["range"].take(pa.array(kept, pa.int64())).cast(pa.int32()),
            "bits": pa.array([_bits(flags[edges[k] : edges[k + 1]]) for k in kept], pa.binary()),
        }
    )


def _match_blocks(table: pa.Table) -> pa.Table:
    """Step 2: which hashes of a range are of a block and occur at two positions or more."""
    low = [np.frombuffer(x.as_py(), np.uint32) for x in table["low"]]
    sizes = [len(x) for x in low]
    twice, block = (
        np.concatenate([_unpacked(x.as_py(), n) for x, n in zip(table[c], sizes, strict=True)]) for c in ("twice", "block")
    )
    _, inverse, shared, indexed = _unique(np.concatenate(low), block)
    shared[inverse[twice]] = True
    return _answers(table, 1, sizes, (shared & indexed)[inverse])


def _marked(answers: list[tuple[int, bytes]], distinct: np.ndarray, ranges: int) -> np.ndarray:
    """The flags that came back for a chunk's sorted distinct hashes."""
    out = np.zeros(len(distinct), bool)
    spans, numbers = _ranges(distinct, ranges)
    place = dict(zip(numbers.tolist(), spans, strict=True))
    for number, bits in answers:
        a, b = place[number]
        out[a:b] = _unpacked(bits, b - a)
    return out


def _of_kind(answers: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    rows = zip(answers["kind"].to_pylist(), answers["range"].to_pylist(), answers["bits"].to_pylist(), strict=True)
    return [(number, bits) for k, number, bits in rows if k == kind]


def _extended(chunk: Chunk, answers: pa.Table, window: int, ranges: int):
    """The windows around a chunk's hits, grouped by equal hashes.

    Returns positions, group of each, each group's first hash, second hash, doc_id and
    start of its earliest window, and whether a window is later than that. The start is
    zero where no other chunk has rows of the id.
    """
    n = block_words(window)
    at, hashes, blocks = chunk.probes(n)
    distinct, inverse, _, _ = _unique(hashes, blocks)
    hits = np.zeros(len(chunk.words), bool)
    hits[at] = _marked(_of_kind(answers, 1), distinct, ranges)[inverse]
    at, one, two, key = chunk.windows(window, hits, n)
    order = np.lexsort((key, two, one))
    at, one, two, key = at[order], one[order], two[order], key[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(at) else np.zeros(0, bool)
    group, begins = np.cumsum(new) - 1, np.flatnonzero(new)
    first = at[begins]
    doc = chunk.doc[first]
    start = np.where(chunk.split[doc], chunk.start[first], 0).astype(np.uint32)
    return at, group, one[begins], two[begins], chunk.ids[doc], start, key > key[begins][group]


def _window_rows(window: int, ranges: int):
    """Step 3: each chunk's windows around hits, once each, with the earliest place there."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        spans, numbers, number = [], np.zeros(0, np.int32), 0
        one = two = ids = starts = np.zeros(0, np.uint64)
        if table.num_rows and answers.num_rows:
            number = table["__chunk"][0].as_py()
            _, _, one, two, ids, starts, _ = _extended(Chunk.of(table), answers, window, ranges)
            spans, numbers = _ranges(one, ranges)
        return pa.table(
            {
                "range": pa.array(numbers, pa.int32()),
                "chunk": pa.array(np.full(len(spans), number), pa.int32()),
                "one": pa.array([one[a:b].tobytes() for a, b in spans], pa.binary()),
                "two": pa.array([two[a:b].tobytes() for a, b in spans], pa.binary()),
                "ids": pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()),
                "starts": pa.array([starts[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    return run


def _match_windows(table: pa.Table) -> pa.Table:
    """Step 4: which windows of a range have an earlier place in another chunk."""
    parts = {c: [np.frombuffer(x.as_py(), np.uint64) for x in table[c]] for c in ("one", "two", "ids")}
    sizes = [len(x) for x in parts["one"]]
    one, two, ids = (np.concatenate(parts[c]) for c in ("one", "two", "ids"))
    ids = ids.view(np.int64)
    starts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["starts"]])
    order = np.lexsort((starts, ids, two, one))
    a, b, c, d = one[order], two[order], ids[order], starts[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    least = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.empty(len(ids), bool)
    later[order] = (c > c[least]) | ((c == c[least]) & (d > d[least]))
    return _answers(table, 2, sizes, later)


def _spans(covered: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _kept(window: int, ranges: int, columns: list[str]):
    """Step 5: each document without its repeats."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk.of(table)
        table, n_docs = chunk.table, len(chunk.ids)
        covered = np.zeros(len(chunk.words) + 1, np.int64)
        if answers.num_rows:
            at, group, one, _, _, _, later = _extended(chunk, answers, window, ranges)
            later = later | _marked(_of_kind(answers, 2), one, ranges)[group]
            np.add.at(covered, at[later], 1)
            np.add.at(covered, at[later] + window, -1)
        covered = np.cumsum(covered)[:-1] > 0
        edges = np.searchsorted(chunk.doc, np.arange(n_docs + 1))
        data, offsets = utf8(table["text"])
        data, texts, spans = data.tobytes(), [], []
        for k in range(n_docs):
            words = data[offsets[k] : offsets[k + 1]].split()
            gone = covered[edges[k] : edges[k + 1]]
            if gone.any():
                spans.append(_spans(gone))
                words = compress(words, (~gone).tolist())
            else:
                spans.append([])
            texts.append(b" ".join(words))
        removed = np.concatenate([[0], np.cumsum(covered)])
        out = {c: table[c] for c in columns}
        out["kept"] = pa.array(texts, pa.binary()).cast(pa.string())
        out["n_words"] = pa.array(np.diff(edges), pa.int64())
        out["n_removed"] = pa.array(removed[edges[1:]] - removed[edges[:-1]], pa.int64())
        out["removed"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.table(out)

    return run


def chunked(docs: DataFrame, columns: list[str], chunk_bytes: int | None = None, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, int]:
    """``docs`` with ``__id``, ``__chunk`` and ``__split``, and the number of chunks.

    Rows of an id are in one chunk, but for ids, NULL among them, with more text or rows
    than a chunk should have: their rows are dealt over all chunks (``__split``).
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total, rows = docs.agg(F.sum(size.cast("long")), F.count("*")).first()
    total = total or 0
    chunk_bytes = chunk_bytes or max(LEAST_CHUNK, min(MOST_CHUNK, int(CHUNK_ROOT * total**0.5)))
    n = max(total // chunk_bytes, rows // chunk_rows) + 1
    large = (
        docs.groupBy(F.col("doc_id").alias("__large")).agg(F.sum(size.cast("long")).alias("bytes"), F.count("*").alias("rows"))
        .filter((F.col("bytes") > chunk_bytes) | (F.col("rows") > chunk_rows))
    )
    # At most twice as many as chunks.
    known = docs.join(F.broadcast(large.select("__large", F.lit(True).alias("__is"))), F.col("doc_id").eqNullSafe(F.col("__large")), "left")
    split = F.coalesce("__is", F.lit(False))
    # Equal rows of one id are apart as well.
    spread = F.when(split, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id"))
    placed = known.select(
        *columns,
        F.col("doc_id").cast("long").alias("__id"),
        split.alias("__split"),
        F.pmod(spread, F.lit(n)).cast("int").alias("__chunk"),
    )
    return placed, n


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int | None = None) -> DataFrame:
    """``docs`` with ``kept`` (the words left, joined by spaces), ``n_words``, ``n_removed``, ``removed``.

    A word goes if ``window`` words around it also start earlier: in a smaller doc_id,
    or before in the same document; ``removed`` lists the spans of such words. NULL
    text has no words. Rows that share a doc_id share its positions, so that repeated
    rows are no repeats of each other; rows without a doc_id count as one after all
    others. Columns of these four names are replaced. An empty table gives no row.
    ``chunk_bytes`` is chosen by the size of all text where it is not given.
    """
    made = ("kept", "n_words", "n_removed", "removed")
    columns = [c for c in docs.columns if c not in made]
    placed, n = chunked(docs, columns, chunk_bytes)
    chunks = placed.groupBy("__chunk")
    asked = chunks.applyInArrow(_probe_rows(window, n), "range int, chunk int, low binary, twice binary, block binary")
    answer = "chunk int, kind int, range int, bits binary"
    hits = asked.groupBy("range").applyInArrow(_match_blocks, answer)
    windows = chunks.cogroup(hits.groupBy("chunk")).applyInArrow(
        _window_rows(window, n), "range int, chunk int, one binary, two binary, ids binary, starts binary"
    )
    later = windows.groupBy("range").applyInArrow(_match_windows, answer)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return chunks.cogroup(hits.unionByName(later).groupBy("chunk")).applyInArrow(
        _kept(window, n, columns),
        f"{schema}, kept string, n_words long, n_removed long, removed array<struct<start:int,end:int>>",
    )


def op8_repeats(docs: DataFrame) -> DataFrame:
    """Counts and digest of every document's words without those that repeat 20 earlier ones."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
