"""Sums of doubles that do not depend on the order of their terms.

A double is a whole number m times a power of two 2^s. Terms of equal s are added as
whole numbers, in each task and after the shuffle, which is exact; a column has some 2,000
values of s at most. Each column's few totals are then put together as one long whole
number, and that is rounded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

#: Whole numbers are added in three parts of so many bits, which overflows beyond 10^13 terms.
_BITS = 19
#: In place of s, for terms that are no numbers.
_INFINITE, _MINUS_INFINITE, _NAN = 9997, 9998, 9999


def _rounded(parts: list[dict]) -> float | None:
    """The double nearest to the sum of m 2^s over ``parts``; None for none."""
    found = {p["s"] for p in parts} - {None}
    if not found:
        return None
    if _NAN in found or {_INFINITE, _MINUS_INFINITE} <= found:
        return float("nan")
    if found & {_INFINITE, _MINUS_INFINITE}:
        return float("inf") if _INFINITE in found else float("-inf")
    known = [(p["s"], sum(p[f"m{k}"] << (k * _BITS) for k in range(3))) for p in parts if p["s"] is not None]
    low = min(0, *(s for s, _ in known))
    total = sum(m << (s - low) for s, m in known)
    try:
        return total / (1 << -low)  # division of whole numbers is rounded once
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def parts_of(values: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(s, m0, m1, m2) for each s of ``values``, numbers without NULL; the same parts as Spark's."""
    if values.dtype.kind in "iub":
        whole, s = values.astype(np.int64), np.zeros(len(values), np.int64)
    else:
        x = values.astype(np.float64)
        finite = np.isfinite(x)
        fraction, exponent = np.frexp(np.where(finite, x, 0))
        whole = (fraction * 2.0**53).astype(np.int64)
        s = np.where(whole == 0, 0, exponent.astype(np.int64) - 53)
        s = np.where(finite, s, np.where(np.isnan(x), _NAN, np.where(x > 0, _INFINITE, _MINUS_INFINITE)))
    mask = (1 << _BITS) - 1
    found, at = np.unique(s, return_inverse=True)
    sums = np.zeros((3, len(found)), np.int64)
    for k in range(3):
        np.add.at(sums[k], at, (whole >> (k * _BITS)) & mask if k < 2 else whole >> (2 * _BITS))
    return [tuple(map(int, row)) for row in zip(found, *sums)]


PARTS = "group string, dataset string, s int, m0 bigint, m1 bigint, m2 bigint"


def sums_of_parts(parts: DataFrame) -> DataFrame:
    """(group, dataset, total) from rows of :data:`PARTS`, of which a column may have any number.

    Rows with s NULL only say that there is such a column.
    """
    added = parts.groupBy("group", "dataset", "s").agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(3)])
    gathered = added.groupBy("group", "dataset").agg(F.collect_list(F.struct("s", "m0", "m1", "m2")).alias("parts"))
    return gathered.mapInArrow(_sum_of_parts, "group string, dataset string, total double")


def _sum_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals = [_rounded(parts) for parts in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(totals, pa.float64())], names=["group", "dataset", "total"])


class _Totals:
    """Whole numbers added up by s: the same terms as :func:`parts_of`, kept over many arrays."""

    #: Bits of the lower part of a 53-bit number. Sums of either part of 2^25 numbers are exact as doubles.
    LOWER = 26
    ROWS = 1 << 25

    def __init__(self) -> None:
        self.found: dict[int, int] = {}

    def _add(self, s: int, m: int) -> None:
        self.found[s] = self.found.get(s, 0) + m

    def add(self, values: np.ndarray) -> None:
        for at in range(0, len(values), self.ROWS):
            self._add_some(values[at : at + self.ROWS])

    def _add_some(self, values: np.ndarray) -> None:
        if values.dtype.kind in "iu":
            values = values.astype(np.int64)
            # Neither half of so many numbers overflows.
            high = values >> 32
            self._add(0, (int(high.sum()) << 32) + int((values - (high << 32)).sum()))
            return
        x = values.astype(np.float64)
        fraction, exponent = np.frexp(x)
        if not np.isfinite(fraction).all():
            finite = np.isfinite(x)
            for s, some in ((_NAN, np.isnan(x)), (_INFINITE, x == np.inf), (_MINUS_INFINITE, x == -np.inf)):
                if some.any():
                    self._add(s, 0)
            fraction, exponent = fraction[finite], exponent[finite]
        if not len(fraction):
            return
        least = int(exponent.min())
        at = exponent - least
        scaled = fraction * 2.0 ** (53 - self.LOWER)
        upper = np.floor(scaled)
        uppers = np.bincount(at, upper)
        lowers = np.bincount(at, (scaled - upper) * 2.0**self.LOWER)
        for k in np.flatnonzero((uppers != 0) | (lowers != 0)).tolist() or [0]:
            self._add(least + k - 53, (int(uppers[k]) << self.LOWER) + int(lowers[k]))

    def parts(self) -> list[tuple[int, int, int, int]]:
        mask = (1 << _BITS) - 1
        return [(s, m & mask, (m >> _BITS) & mask, m >> (2 * _BITS)) for s, m in self.found.items()]


def _parts_of_rows(group: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [_Totals() for _ in names]
        for batch in batches:
            for total, column in zip(totals, batch.columns):
                total.add((column.drop_null() if column.null_count else column).to_numpy(zero_copy_only=False))
        rows = [(group, name, *part) for name, total in zip(names, totals) for part in total.parts()]
        if rows:
            types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "dataset", "s", "m0", "m1", "m2"])

    return run


def exact_sums(df: DataFrame, group: str) -> DataFrame:
    """Sum of every numeric column, one row each: (group, dataset, total).

    The total is the double nearest to the exact sum of a column's values, whatever the
    order in which they are added: NULL without any, NaN or infinite as in IEEE arithmetic.
    Decimals are taken as the nearest doubles. Tasks add up their rows column by column; one
    shuffle of their partial sums, and another of the few totals.
    """
    ship_package(df.sparkSession)
    fields = [f for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if not fields:
        raise ValueError(f"group {group} has no numeric column")

    def number(f: T.StructField) -> Column:
        x = F.col(f"`{f.name}`")
        return x.cast("double") if isinstance(f.dataType, T.DecimalType) else x

    names = [f.name for f in fields]
    numbers = df.select(*[number(f).alias(f"c{k}") for k, f in enumerate(fields)])
    parts = numbers.mapInArrow(_parts_of_rows(group, names), PARTS)
    # A row for each column, so that one without values has its row.
    every = F.explode(F.array(*[F.lit(name) for name in names])).alias("dataset")
    none = df.sparkSession.range(1).select(F.lit(group).alias("group"), every, F.lit(None).cast("int").alias("s"))
    none = none.select("*", *[F.lit(None).cast("long").alias(f"m{k}") for k in range(3)])
    return sums_of_parts(parts.unionAll(none))
