"""Folders of Parquet files that need not be alike: one schema for all, from every footer.

Tasks read the footers. A column has the narrowest type that holds the values of every
file, by the rule of :func:`~eventskim.sources.groups.bind_group`; where there is none,
the error names the column and a file of each kind.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..schema import column_name
from ..session import ensure_checkpoint_dir, ship_package
from .colgroup import _open

#: Where Spark keeps the schema of a file it writes.
_SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"
_NUMBERS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType())


def wider_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds the values of both; numbers of 64 bits and fractions have none."""
    if a == b or b == T.NullType():
        return a
    if a == T.NullType():
        return b
    if a not in _NUMBERS or b not in _NUMBERS:
        raise ValueError(f"{a.simpleString()} and {b.simpleString()} have no common type")
    fractions = {a, b} & {T.FloatType(), T.DoubleType()}
    if fractions and T.LongType() in (a, b):
        raise ValueError("64-bit integers and fractions have no common type")
    if fractions:
        # Readers widen stored integers to double, not to float.
        return T.DoubleType()
    return max(a, b, key=_NUMBERS.index)


@dataclass(frozen=True)
class FolderColumn:
    """A column of a folder: its type, and the names it is stored under."""

    name: str
    type: T.DataType
    stored: tuple[str, ...]
    #: A file without it, if there is one.
    lacking: str | None = None


def _to_json(kind: T.DataType) -> str:
    return T.StructType([T.StructField("_", kind)]).json()


def _from_json(text: str) -> T.DataType:
    return T.StructType.fromJson(json.loads(text))[0].dataType


def _fields_of(footer: pa.Schema) -> list[tuple[str, str]]:
    """Names and types, as JSON, of a file's columns."""
    known = (footer.metadata or {}).get(_SPARK_SCHEMA)
    if known:
        return [(f.name, _to_json(f.dataType)) for f in T.StructType.fromJson(json.loads(known))]
    return [(f.name, _to_json(from_arrow_type(f.type))) for f in footer]


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for path in batch.column(0).to_pylist():
            with _open(path) as handle:
                out += [(path, i, *field) for i, field in enumerate(_fields_of(pq.read_schema(handle)))]
        columns = list(zip(*out)) or [()] * 4
        types = (pa.string(), pa.int32(), pa.string(), pa.string())
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays(arrays, names=["path", "at", "dataset", "kind"])


def stored_fields(spark: SparkSession, *paths: str) -> DataFrame:
    """A row for each column of each file below ``paths``: path, at, dataset, kind (JSON)."""
    ship_package(spark)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path")
        .filter(~F.regexp_extract("path", r"([^/]+)$", 1).rlike(r"^[._]"))
    )
    return files.mapInArrow(_footers, "path string, at int, dataset string, kind string")


def folder_columns(spark: SparkSession, *paths: str) -> list[FolderColumn]:
    """The columns of all files below ``paths``, in the order they have in files.

    Columns are the same whose names are after renaming, in whatever case; a file that
    has one twice is an error. The driver sees a row for each column, stored name and
    type, and one more for each column, however many files there are.
    """
    ensure_checkpoint_dir(spark)
    column = F.lower(F.replace("dataset", F.lit("."), F.lit("_")))
    fields = stored_fields(spark, *paths).withColumn("column", column).checkpoint()
    kinds = (
        fields.groupBy("column", "dataset", "kind").agg(F.min("at").alias("at"), F.min("path").alias("path"))
        .orderBy("at", "path", "column", "dataset", "kind")
        .collect()
    )
    if not kinds:
        raise ValueError(f"no file with columns below {', '.join(paths)}")
    by_column: dict[str, list] = {}
    for row in kinds:
        by_column.setdefault(row["column"], []).append(row)
    files = fields.groupBy("path").agg(F.collect_set("column").alias("has"), F.count("*").alias("n"))
    twice = files.filter(F.size("has") < F.col("n")).agg(F.min("path")).first()[0]
    if twice:
        raise ValueError(f"{twice} has two datasets that would be one column")
    names = F.array(*[F.lit(c) for c in by_column])
    lacking = files.select("path", F.explode(F.array_except(names, "has")).alias("column"))
    without = dict(lacking.groupBy("column").agg(F.min("path")).collect())
    return [_folder_column(rows, without.get(column)) for column, rows in by_column.items()]


def _folder_column(rows: Sequence, lacking: str | None) -> FolderColumn:
    """One column from the kinds that files store it as."""
    name, kind = column_name(rows[0]["dataset"]), _from_json(rows[0]["kind"])
    for row in rows[1:]:
        try:
            kind = wider_type(kind, _from_json(row["kind"]))
        except ValueError as e:
            raise ValueError(f"column {name}: {e}; see {rows[0]['path']} and {row['path']}") from None
    stored: dict[str, str] = {}
    for row in rows:
        stored.setdefault(row["dataset"].lower(), row["dataset"])
    if kind == T.NullType():
        kind = T.IntegerType()  # no file has a value
    return FolderColumn(name, kind, tuple(stored.values()), lacking)


def read_folder(
    spark: SparkSession,
    *paths: str,
    columns: Sequence[str] | None = None,
    absent: str = "null",
    rename: bool = True,
) -> DataFrame:
    """All rows of all files below ``paths``, with the columns that any of them has.

    ``columns`` (dataset or column names) are those read, by default all. A file that
    lacks one gives NULL there, or with ``absent="error"`` is an error that names it.
    Columns have the type that holds all files' values. They are named by the column rule;
    without ``rename``, as the first file stores them.
    """
    if absent not in ("null", "error"):
        raise ValueError("absent is 'null' or 'error'")
    found = {c.name.lower(): c for c in folder_columns(spark, *paths)}
    wanted = [column_name(c) for c in columns] if columns is not None else [c.name for c in found.values()]
    unknown = [c for c in wanted if c.lower() not in found]
    if unknown:
        raise ValueError(f"missing datasets: {unknown}; no file below {', '.join(paths)} has them")
    chosen = [found[c.lower()] for c in wanted]
    lost = [f"{c.name} in {c.lacking}" for c in chosen if c.lacking]
    if lost and absent == "error":
        raise ValueError(f"missing datasets: {lost}")
    schema = T.StructType([T.StructField(s, c.type) for c in chosen for s in c.stored])
    raw = spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(*paths)
    named = [(c.name if rename else c.stored[0], [F.col(f"`{s}`") for s in c.stored]) for c in chosen]
    return raw.select(*[(F.coalesce(*held) if len(held) > 1 else held[0]).alias(name) for name, held in named])
