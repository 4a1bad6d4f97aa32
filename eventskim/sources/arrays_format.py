"""Column arrays as a Spark data source: ``spark.read.format("column_arrays")``.

Options: ``groups`` (names with commas between them), ``columns`` (all by default),
``ranges``, ``slicesPerFile`` or ``sliceBytes``. Groups are scanned side by side, as
:func:`~eventskim.sources.colgroup.read_colgroup` does. ``ranges`` is a JSON object of
columns and the two ends, the first included, between which their values must lie; null
is no end. The scan reads the arrays of such columns first, and of the others only the
stretches in which a row passes.

The format ``column_arrays_pushed`` is given the comparisons of the query by Spark, and
needs ``spark.sql.python.filterPushdown.enabled``. Spark 4.1 keeps what it pushed with the
loaded table: filter a DataFrame of that format in one way only, and load another for
each other use, or rows are missing. ``ranges`` has no such fault.

A scan reads the columns of its schema. Spark does not tell a source of this kind which
of them a query uses, so name them with ``columns`` or a schema.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from ..schema import column_name
from ..session import ship_package
from .colgroup import BATCH_ROWS, SLICE_BYTES, _NUMPY, _TYPES, _column_types, _header, _open, common_type, list_arrays

FORMAT, PUSHED_FORMAT = "column_arrays", "column_arrays_pushed"
_HEADER_THREADS = 32


@dataclass(frozen=True)
class StoredArray:
    file: str
    group: str
    dataset: str
    path: str
    bytes: int

    @property
    def column(self) -> str:
        return column_name(self.dataset)


def _stored(root: str, groups: Sequence[str]) -> list[StoredArray]:
    """The arrays of ``groups`` below ``root``, which only lists folders."""
    local = root.removeprefix("file:") if root.startswith("file:") else root
    if "://" in local.lstrip("/"):
        store, start = fs.FileSystem.from_uri(root)
        scheme = root.split("://", 1)[0] + "://" + (root.split("://", 1)[1].split("/", 1)[0] if not start.startswith("/") else "")
    else:
        store, start, scheme = fs.LocalFileSystem(), "/" + unquote(local).lstrip("/"), ""
    found = []
    for info in store.get_file_info(fs.FileSelector(start, recursive=True)):
        parts = info.path.rsplit("/", 2)
        if info.type == fs.FileType.File and len(parts) == 3 and parts[1] in groups and parts[2].endswith(".npy"):
            if not parts[2].startswith((".", "_")):
                found.append(StoredArray(parts[0], parts[1], parts[2][:-4], scheme + info.path, info.size))
    return sorted(found, key=lambda a: a.path)


def _schema_of(arrays: Sequence[StoredArray], columns: Sequence[str] | None) -> T.StructType:
    """Columns and types of all files, from the headers of their arrays."""
    with ThreadPoolExecutor(_HEADER_THREADS) as pool:
        kinds = list(pool.map(lambda a: _header(a.path)[0].lstrip("<>=|"), arrays))
    types: dict[str, T.DataType] = {}
    origin: dict[str, tuple[str, str]] = {}
    for array, kind in zip(arrays, kinds):
        if kind not in _TYPES:
            raise ValueError(f"{array.path}: no column type for arrays of type {kind}")
        at = (array.group, array.dataset)
        if origin.setdefault(array.column, at) != at:
            raise ValueError(f"two datasets would be column {array.column}: {origin[array.column]}, {at}")
        types[array.column] = common_type(types.get(array.column, _TYPES[kind]), _TYPES[kind])
    by_lower = {c.lower(): c for c in types}
    names = [column_name(c) for c in columns] if columns else sorted(types)
    missing = [c for c in names if c.lower() not in by_lower]
    if missing:
        raise ValueError(f"missing datasets: {missing}")
    return T.StructType([T.StructField(c, types[by_lower[c.lower()]], False) for c in names])


@dataclass
class Slice(InputPartition):
    """Slice ``number`` of ``of`` equal ones of a file's rows; the paths follow the schema."""

    file: str
    paths: tuple[str, ...]
    number: int
    of: int


def _test(condition: Filter) -> Callable[[np.ndarray], np.ndarray] | None:
    """What ``condition`` says of stored values; None for one that Spark has to evaluate.

    Spark holds NaN for larger than all numbers and equal to itself.
    """
    value = getattr(condition, "value", None)
    if isinstance(condition, IsNotNull):
        return lambda x: np.ones(len(x), bool)
    values = value if isinstance(condition, In) else (value,)
    if not all(isinstance(v, (int, float)) and v == v for v in values):
        return None
    if isinstance(condition, EqualTo):
        return lambda x: x == value
    if isinstance(condition, In):
        return lambda x: np.logical_or.reduce([x == v for v in values])
    if isinstance(condition, GreaterThan):
        return lambda x: (x > value) | (x != x)
    if isinstance(condition, GreaterThanOrEqual):
        return lambda x: (x >= value) | (x != x)
    if isinstance(condition, LessThan):
        return lambda x: x < value
    if isinstance(condition, LessThanOrEqual):
        return lambda x: x <= value
    return None


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.fields = list(schema.fields)
        self.root = options["path"]
        self.groups = _names(options.get("groups", ""))
        self.slices = int(options["slicesPerFile"]) if "slicesPerFile" in options else None
        self.slice_bytes = int(options.get("sliceBytes", SLICE_BYTES))
        if not self.groups or (self.slices is not None and self.slices < 1):
            raise ValueError("option groups is needed, and slices must be positive")
        self.number = {f.name.lower(): i for i, f in enumerate(self.fields)}
        self.filters: list[tuple[int, Filter]] = []
        for name, (low, high) in json.loads(options.get("ranges", "{}")).items():
            if name.lower() not in self.number:
                raise ValueError(f"a range of {name}, which is not read")
            ends = ((GreaterThanOrEqual, low), (LessThan, high))
            self.filters += [(self.number[name.lower()], kind((name,), end)) for kind, end in ends if end is not None]

    def partitions(self) -> Sequence[InputPartition]:
        by_file: dict[str, dict[str, StoredArray]] = {}
        for array in _stored(self.root, self.groups):
            by_file.setdefault(array.file, {})[array.column.lower()] = array
        if not by_file:
            raise ValueError(f"no file below {self.root} has group {self.groups[0]}")
        wanted = [f.name.lower() for f in self.fields]
        out = []
        for file, arrays in by_file.items():
            lacking = [f.name for f, w in zip(self.fields, wanted) if w not in arrays]
            if lacking:
                raise ValueError(f"the arrays of {file} are not all there: {lacking}")
            chosen = [arrays[w] for w in wanted]
            n = self.slices or max(1, -(-sum(a.bytes for a in chosen) // self.slice_bytes))
            out += [Slice(file, tuple(a.path for a in chosen), k, n) for k in range(n)]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        headers = [_header(p) for p in partition.paths]
        rows = {h[1] for h in headers}
        if len(rows) != 1:
            raise ValueError(f"the arrays of {partition.file} are not row-aligned: {min(rows)} to {max(rows)} rows")
        [rows] = rows
        step = rows // partition.of
        begin = partition.number * step
        end = rows if partition.number == partition.of - 1 else begin + step
        handles = [_open(p) for p in partition.paths]

        def values(i: int, at: int, n: int) -> np.ndarray:
            kind, _, offset = headers[i]
            stored = np.dtype(kind)
            return np.frombuffer(handles[i].read_at(n * stored.itemsize, offset + at * stored.itemsize), stored, n)

        tests = [(i, _test(c)) for i, c in self.filters]
        try:
            for at in range(begin, end, BATCH_ROWS):
                n = min(BATCH_ROWS, end - at)
                known: dict[int, np.ndarray] = {}
                passed = np.ones(n, bool)
                for i, test in tests:
                    if i not in known:
                        known[i] = values(i, at, n)
                    passed &= test(known[i])
                if not passed.any():
                    continue
                columns = []
                for i, field in enumerate(self.fields):
                    raw = known[i] if i in known else values(i, at, n)
                    kind = np.dtype(_NUMPY[field.dataType])
                    raw = raw.astype(kind, casting="safe" if raw.dtype.kind != "b" else "unsafe", copy=False)
                    columns.append(pa.array(raw if passed.all() else raw[passed]))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in self.fields])
        finally:
            for handle in handles:
                handle.close()


class _PushedReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            path = getattr(condition, "attribute", ())
            if len(path) == 1 and path[0].lower() in self.number and _test(condition) is not None:
                self.filters.append((self.number[path[0].lower()], condition))
            else:
                yield condition


def _names(text: str) -> list[str]:
    return [n.strip().strip("/") for n in text.split(",") if n.strip()]


class ColumnArrays(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        groups = _names(self.options.get("groups", ""))
        arrays = _stored(self.options["path"], groups)
        lost = [g for g in groups if g not in {a.group for a in arrays}]
        if lost or not groups:
            raise ValueError(f"no file below {self.options['path']} has group {lost[0] if lost else ''}")
        return _schema_of(arrays, _names(self.options.get("columns", "")) or None)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


class PushedColumnArrays(ColumnArrays):
    """The same, with the query's comparisons evaluated by the scan; for one use of a DataFrame."""

    @classmethod
    def name(cls) -> str:
        return PUSHED_FORMAT

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PushedReader(schema, self.options)


def register_arrays(spark: SparkSession) -> None:
    """Make both formats known to ``spark``."""
    ship_package(spark)
    for source in (ColumnArrays, PushedColumnArrays):
        spark.dataSource.register(source)


def scan_arrays(
    spark: SparkSession,
    path: str,
    *groups: str,
    columns: Sequence[str] | None = None,
    ranges: Mapping[str, tuple] | None = None,
    push_filters: bool = False,
    slices_per_file: int | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The rows of ``groups`` through the format; the types of all files are found by tasks.

    The same rows and columns as :func:`~eventskim.sources.colgroup.read_colgroup`, those
    with values in ``ranges`` alone. With ``push_filters`` the scan evaluates what the
    query compares as well: such a DataFrame is for one use, see the module.
    """
    register_arrays(spark)
    if push_filters:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    groups = tuple(g.strip("/") for g in groups)
    found = _column_types(list_arrays(spark, path, groups))
    lost = [g for g in groups if g not in {v[0] for v in found.values()}]
    if lost:
        raise ValueError(f"no file below {path} has group {lost[0]}")
    by_lower = {n.lower(): n for n in found}
    names = [column_name(c) for c in columns] if columns else sorted(found)
    missing = [n for n in names if n.lower() not in by_lower]
    if missing:
        raise ValueError(f"missing datasets: {missing}")
    schema = T.StructType([T.StructField(n, found[by_lower[n.lower()]][2], False) for n in names])
    kept = json.dumps({column_name(c): list(ends) for c, ends in (ranges or {}).items()})
    reader = spark.read.format(PUSHED_FORMAT if push_filters else FORMAT).schema(schema)
    reader = reader.option("groups", ",".join(groups)).option("sliceBytes", slice_bytes).option("ranges", kept)
    if slices_per_file is not None:
        reader = reader.option("slicesPerFile", slices_per_file)
    return reader.load(path)
