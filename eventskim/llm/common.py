"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word is a longest run of bytes outside these six separators.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared checkpoint folder, so that later steps reread it.

    The partitions and their order are those stored, whatever executors are lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` computed once."""
    return F.transform(F.array(value), body)[0]


def row_hash(*columns: str) -> Column:
    """128 bits of the values of ``columns``, in which NULL differs from all values."""
    values = [v for c in columns for v in (F.col(c), F.col(c).isNull())]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on ``keys`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


KEPT = 120_000  # entries of a cache generation


class Recent(dict):
    """``make(key)`` for every key; two generations of bounded size are remembered."""

    def __init__(self, make: Callable, kept: int = KEPT):
        self.make, self.kept, self.older = make, kept, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string column on end, and the n + 1 offsets; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document number of every word; words end with their document."""
    inside = ~_IS_SEPARATOR[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of whole documents of about ``most`` bytes; a longer one stands alone."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        out.append((first, last))
        first = last
    return out


BATCH_BYTES = 2 << 20


def _sizes(column: pa.Array) -> np.ndarray:
    """Offsets of a string or binary column's values."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return utf8(column)[1]
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    return np.concatenate([[0], np.cumsum(lengths)])


def released(run: Callable) -> Callable:
    """``run`` over a task's batches; afterwards the worker, which lives on, gives back Arrow's memory."""

    def runs(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return runs


def mapped(df: DataFrame, by: str, made: dict[str, str], start: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """``df`` with columns ``made`` (name to type) from its column ``by``; such columns are replaced.

    ``start()`` is called once a task and gives a function of a list of values, some
    of them None, that returns the new columns. It gets about ``BATCH_BYTES`` at a time.
    """
    kept = [c for c in df.columns if c not in made]
    source = df.select(*kept) if by in kept else df.select(*kept, by)
    at = source.columns.index(by)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in kept]

    def run(batches):
        of = start()
        for batch in batches:
            for first, stop in slices(_sizes(batch.column(at)), BATCH_BYTES):
                part = batch.slice(first, stop - first)
                columns = [*part.columns[: len(kept)], *of(part.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    return source.mapInArrow(released(run), ", ".join([*fields, *(f"`{c}` {t}" for c, t in made.items())]))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_up_to(n: int) -> list[np.ndarray]:
    while len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            known = _powers[k]
            _powers[k] = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and document number of every word, from about ``most`` bytes at a time."""
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, stop in slices(offsets, most):
        part = data[offsets[first] : offsets[stop]]
        starts, ends, doc = word_bounds(part, offsets[first : stop + 1] - offsets[first])
        power, inverse = _powers_up_to(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        hashes.append(mixed((sums[ends] - sums[starts]) * inverse[starts]))
        docs.append(doc + first)
    return np.concatenate(hashes), np.concatenate(docs)
