"""Column arrays: ``<path>/.../<file>/<group>/<dataset>.npy``.

Each "file" is a folder, at any depth, that holds groups, and each dataset is one
1-D array. Spark lists the arrays, tasks read their headers, and a scan is cut into
slices ``[begin, end)`` of a file, of whose arrays a task reads only that range.
Several row-aligned groups can be scanned as one table, since their slices are cut
alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.exact import PARTS, parts_of, sums_of_parts
from ..schema import column_name
from ..session import ensure_checkpoint_dir, ship_package

BATCH_ROWS = 1 << 17
SLICE_BYTES = 128 << 20

# Array type without byte order -> the narrowest column type that holds its values.
_TYPES: dict[str, T.DataType] = {
    "b1": T.ByteType(),
    "i1": T.ByteType(),
    "u1": T.ShortType(),
    "i2": T.ShortType(),
    "u2": T.IntegerType(),
    "i4": T.IntegerType(),
    "u4": T.LongType(),
    "i8": T.LongType(),
    "f2": T.FloatType(),
    "f4": T.FloatType(),
    "f8": T.DoubleType(),
}
_WHOLE = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())
_NUMPY = {
    T.ByteType(): "i1",
    T.ShortType(): "i2",
    T.IntegerType(): "i4",
    T.LongType(): "i8",
    T.FloatType(): "f4",
    T.DoubleType(): "f8",
}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds all values of both."""
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.index)
    if T.LongType() in (a, b):
        raise ValueError("64-bit integers and fractions have no common type")
    exact = {a, b} <= {T.ByteType(), T.ShortType(), T.FloatType()}
    return T.FloatType() if exact else T.DoubleType()


def _open(path: str):
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        filesystem, path = fs.FileSystem.from_uri(path)
    else:
        filesystem = fs.LocalFileSystem()
    return filesystem.open_input_file(path)


def _header(path: str) -> tuple[str, int, int]:
    """Type, rows and start of the values of an array."""
    with _open(path) as handle:
        version = np.lib.format.read_magic(handle)
        read = {
            (1, 0): np.lib.format.read_array_header_1_0,
            (2, 0): np.lib.format.read_array_header_2_0,
        }[version]
        shape, _, dtype = read(handle)
        if len(shape) != 1:
            raise ValueError(f"{path} must be one-dimensional, has shape {shape}")
        return dtype.str, shape[0], handle.tell()


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, rows, offsets = zip(*map(_header, batch.column("path").to_pylist())) if batch.num_rows else ([], [], [])
        columns = [*batch.columns, pa.array(kinds, pa.string()), pa.array(rows, pa.int64()), pa.array(offsets, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "kind", "rows", "offset"])


def list_arrays(spark: SparkSession, path: str, groups: Sequence[str] | None = None) -> DataFrame:
    """The arrays below ``path``, or those of ``groups``: path, file, group, dataset, kind, rows, offset."""
    ship_package(spark)
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.npy")
        .load(path)
        .select("path")
    )
    part = lambda k: F.regexp_extract("path", r"^(.*)/([^/]+)/([^/]+)\.npy$", k)
    named = found.select("path", part(1).alias("file"), part(2).alias("group"), part(3).alias("dataset"))
    schema = "path string, file string, group string, dataset string, kind string, rows long, offset long"
    ensure_checkpoint_dir(spark)
    if groups is not None:
        named = named.filter(F.col("group").isin(*groups))
    return named.mapInArrow(_headers, schema).checkpoint()


def _column_types(arrays: DataFrame) -> dict[str, tuple[str, str, T.DataType]]:
    """Column -> (group, dataset, type that holds the values of all files)."""
    out: dict[str, tuple[str, str, T.DataType]] = {}
    kinds = arrays.groupBy("group", "dataset", F.substr("kind", F.lit(2)).alias("kind"))
    for row in kinds.agg(F.min("path").alias("path")).orderBy("group", "dataset", "kind").collect():
        if row["kind"] not in _TYPES:
            raise ValueError(f"{row['path']}: no column type for arrays of type {row['kind']}")
        name, kind = column_name(row["dataset"]), _TYPES[row["kind"]]
        known = out.get(name, (row["group"], row["dataset"], kind))
        if known[:2] != (row["group"], row["dataset"]):
            raise ValueError(f"two datasets would be column {name}: {known[:2]}, {(row['group'], row['dataset'])}")
        out[name] = (row["group"], row["dataset"], common_type(known[2], kind))
    return out


def cut_slices(rows: Column, slices: Column) -> Column:
    """``rows`` cut into ``slices`` of equal length, the last taking the rest, without empty ones."""
    step = F.floor(rows / slices)
    cut = lambda i: F.struct(
        (i * step).alias("begin"), F.when(i == slices - 1, rows).otherwise((i + 1) * step).alias("end")
    )
    cuts = F.transform(F.sequence(F.lit(0).cast("long"), (slices - 1).cast("long")), cut)
    return F.filter(cuts, lambda c: c["begin"] < c["end"])


def _ranges(fields: Sequence[T.StructField]):
    names, types = [f.name for f in fields], [np.dtype(_NUMPY[f.dataType]) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                arrays = sorted(row["arrays"], key=lambda a: a["at"])
                handles = [_open(a["path"]) for a in arrays]
                try:
                    for begin in range(row["begin"], row["end"], BATCH_ROWS):
                        n = min(BATCH_ROWS, row["end"] - begin)
                        columns = []
                        for handle, array, kind in zip(handles, arrays, types):
                            stored = np.dtype(array["kind"])
                            raw = handle.read_at(n * stored.itemsize, array["offset"] + begin * stored.itemsize)
                            values = np.frombuffer(raw, stored, n)
                            columns.append(pa.array(values.astype(kind, casting="safe" if stored.kind != "b" else "unsafe")))
                        yield pa.RecordBatch.from_arrays(columns, names)
                finally:
                    for handle in handles:
                        handle.close()

    return run


def read_colgroup(
    spark: SparkSession,
    path: str,
    *groups: str,
    columns: Sequence[str] | None = None,
    slices_per_file: int | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The rows of one group, or of several row-aligned ones side by side.

    ``columns`` (dataset or column names) are read, by default all that the groups
    have anywhere, in the order of their names. A column has the narrowest type that
    holds its values in all files. A file that lacks one of the arrays, or whose
    arrays differ in length, is an error.
    """
    groups = tuple(g.strip("/") for g in groups)
    if slices_per_file is not None and slices_per_file < 1:
        raise ValueError("slices must be positive")
    arrays = list_arrays(spark, path, groups)
    found = _column_types(arrays)
    lost = [g for g in groups if g not in {v[0] for v in found.values()}]
    if lost:
        raise ValueError(f"no file below {path} has group {lost[0]}")
    names = [column_name(c) for c in columns] if columns else sorted(found)
    by_lower = {n.lower(): n for n in found}
    missing = [n for n in names if n.lower() not in by_lower]
    if missing:
        raise ValueError(f"missing datasets: {missing}")
    chosen = [found[by_lower[n.lower()]] for n in names]
    fields = [T.StructField(n, kind, False) for n, (_, _, kind) in zip(names, chosen)]
    place = reduce(
        lambda at, k: at.when((F.col("group") == chosen[k][0]) & (F.col("dataset") == chosen[k][1]), k),
        range(len(chosen)),
        F.when(F.lit(False), -1),
    )
    files = (
        arrays.withColumn("at", place)
        .filter("at IS NOT NULL")
        .groupBy("file")
        .agg(
            F.min("rows").alias("rows"),
            F.max("rows").alias("most"),
            F.collect_list(F.struct("at", "path", "kind", "offset")).alias("arrays"),
        )
    )
    odd = files.filter((F.col("rows") != F.col("most")) | (F.size("arrays") != len(chosen))).select("file", "rows", "most").first()
    if odd:
        raise ValueError(f"the arrays of {odd['file']} are not row-aligned or not all there: {odd['rows']} to {odd['most']} rows")
    if slices_per_file is None:
        width = sum(np.dtype(_NUMPY[f.dataType]).itemsize for f in fields)
        slices = F.greatest(F.lit(1), F.ceil(F.col("rows") * width / slice_bytes))
    else:
        slices = F.lit(slices_per_file)
    cut = files.select("file", "arrays", F.explode(cut_slices(F.col("rows"), slices)).alias("cut"))
    cut = cut.select("file", "arrays", "cut.begin", "cut.end")
    tasks = max(1, cut.count())
    return cut.repartition(tasks).mapInArrow(_ranges(fields), T.StructType(fields))


def _array_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in PARTS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            known = (row["group"], column_name(row["dataset"]))
            found = [(*known, None, None, None, None)]
            stored = np.dtype(row["kind"])
            with _open(row["path"]) as handle:
                for begin in range(row["begin"], row["end"], BATCH_ROWS):
                    n = min(BATCH_ROWS, row["end"] - begin)
                    raw = handle.read_at(n * stored.itemsize, row["offset"] + begin * stored.itemsize)
                    found += [(*known, *part) for part in parts_of(np.frombuffer(raw, stored, n))]
            columns = [pa.array(c, t) for c, t in zip(zip(*found), _PART_TYPES)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


_PART_TYPES = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def sum_arrays(spark: SparkSession, path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Sums of all datasets of all groups below ``path``: (group, dataset, total).

    Each array is summed for itself, in slices, so they need not be aligned or be in all
    files. The totals do not depend on the order: see :func:`~eventskim.operators.exact_sums`.
    """
    arrays = list_arrays(spark, path)
    _column_types(arrays)  # names the array of a type that is no number
    width = F.regexp_extract("kind", r"(\d+)$", 1).cast("int")
    slices = F.greatest(F.lit(1), F.ceil(F.col("rows") * width / slice_bytes))
    # An empty array has a slice too.
    cuts = F.when(F.col("rows") > 0, cut_slices(F.col("rows"), slices)).otherwise(
        F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("end")))
    )
    cut = arrays.select("path", "group", "dataset", "kind", "offset", F.explode(cuts).alias("cut"))
    cut = cut.select("path", "group", "dataset", "kind", "offset", "cut.begin", "cut.end")
    tasks = cut.count()
    if not tasks:
        raise ValueError(f"no array below {path}")
    return sums_of_parts(cut.repartition(tasks).mapInArrow(_array_parts, PARTS))
