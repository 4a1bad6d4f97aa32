"""Row-aligned Parquet groups read side by side, without moving a row.

Files are paired by their path below the group, the writer's own tag in part names set
aside. A task reads one range of rows, cut at row groups of the first file, from both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import ExitStack

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.rows import MISALIGNED_SHOWN
from ..schema import column_name
from ..session import ensure_checkpoint_dir, ship_package
from .colgroup import BATCH_ROWS, SLICE_BYTES, _open
from .folders import FolderColumn, folder_columns

#: What a writer puts into the names of its part files.
_WRITER = r"-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def _row_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("rows", pa.int64()), ("bytes", pa.int64())]))
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            with _open(path) as handle:
                footer = pq.read_metadata(handle)
            groups = (footer.row_group(i) for i in range(footer.num_row_groups))
            found.append([{"rows": g.num_rows, "bytes": g.total_byte_size} for g in groups])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["path", "groups"])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The files below ``folder``: path, key that pairs them, row groups."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    shown = files.filter(~F.regexp_extract("path", r"([^/]+)$", 1).rlike(r"^[._]"))
    read = shown.mapInArrow(_row_groups, "path string, groups array<struct<rows:long,bytes:long>>")
    # The folder as the scan names it: what ends with its last part.
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    below = F.substring_index("path", f"/{name}/", -1)
    return read.select("path", F.regexp_replace(below, _WRITER, "").alias("key"), "groups")


def _cut(limit: int):
    """Row ranges of whole row groups of about ``limit`` bytes."""

    def of(groups: list[dict]) -> list[dict]:
        out, begin, end, held = [], 0, 0, 0
        for g in groups:
            if held and held + g["bytes"] > limit:
                out.append({"begin": begin, "end": end})
                begin, held = end, 0
            end += g["rows"]
            held += g["bytes"]
        return [*out, {"begin": begin, "end": end}] if end > begin else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            cuts = pa.array([of(g) for g in batch.column(2).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], cuts], names=["left", "right", "cuts"])

    return run


def _rows_of(path: str, names: Sequence[Sequence[str]], begin: int, end: int, stack: ExitStack) -> Iterator[pa.RecordBatch]:
    """Rows ``begin`` to ``end`` of a file, each column from the first of its names that is stored."""
    file = pq.ParquetFile(stack.enter_context(_open(path)))
    stored = {n.lower(): n for n in file.schema_arrow.names}
    chosen = [next((stored[n.lower()] for n in of if n.lower() in stored), None) for of in names]
    at, wanted = 0, []
    skip = 0
    for i in range(file.num_row_groups):
        rows = file.metadata.row_group(i).num_rows
        if at < end and at + rows > begin:
            if not wanted:
                skip = begin - at
            wanted.append(i)
        at += rows
    left = end - begin
    for batch in file.iter_batches(BATCH_ROWS, wanted, columns=[c for c in chosen if c]):
        before = min(skip, batch.num_rows)
        skip -= before
        batch = batch.slice(before, left)
        left -= batch.num_rows
        if batch.num_rows:
            columns = [batch.column(c) if c else pa.nulls(batch.num_rows) for c in chosen]
            yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(columns))])


def _read(sides: Sequence[Sequence[FolderColumn]]):
    names = [[c.stored for c in side] for side in sides]
    fields = [c for side in sides for c in side]
    kinds = [to_arrow_type(c.type) for c in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with ExitStack() as stack:
                    paths = (row["left"], row["right"])
                    streams = [_rows_of(p, n, row["begin"], row["end"], stack) for p, n in zip(paths, names)]
                    held = [next(s, None) for s in streams]
                    while all(h is not None for h in held):
                        n = min(h.num_rows for h in held)
                        columns = [c for h in held for c in h.slice(0, n).columns]
                        arrays = [c.cast(k) for c, k in zip(columns, kinds)]
                        yield pa.RecordBatch.from_arrays(arrays, names=[c.name for c in fields])
                        held = [h.slice(n) if h.num_rows > n else next(s, None) for h, s in zip(held, streams)]

    return run


def read_paired(
    spark: SparkSession,
    root: str,
    left: str,
    right: str,
    columns: Sequence[str] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The rows of two row-aligned groups below ``root``, the n-th of a file beside the n-th of its twin.

    ``columns`` (dataset or column names) are read, by default all of both; a column that
    both have is an error, and so are a file without a twin and twins of different length,
    which are named. No row is moved: a task reads the same rows of both files.
    """
    ship_package(spark)
    folders = [f"{root.rstrip('/')}/{g.strip('/')}" for g in (left, right)]
    found = [folder_columns(spark, f) for f in folders]
    both = {c.name.lower() for c in found[0]} & {c.name.lower() for c in found[1]}
    if columns is not None:
        wanted = {column_name(c).lower() for c in columns}
        lost = wanted - {c.name.lower() for side in found for c in side}
        if lost:
            raise ValueError(f"missing datasets: {sorted(lost)}")
        found = [[c for c in side if c.name.lower() in wanted] for side in found]
        both &= wanted
    if both:
        raise ValueError(f"columns of both groups: {sorted(both)}")
    ensure_checkpoint_dir(spark)
    rows = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, g: n + g["rows"])
    a, b = (_files(spark, f) for f in folders)
    pairs = (
        a.select("key", F.col("path").alias("left"), F.col("groups").alias("left_groups"))
        .join(b.select("key", F.col("path").alias("right"), F.col("groups").alias("right_groups")), "key", "full")
        .withColumns({"n": rows(F.col("left_groups")), "m": rows(F.col("right_groups"))})
        .checkpoint()
    )
    odd = pairs.filter(~F.col("n").eqNullSafe(F.col("m"))).select("key", "n", "m").limit(MISALIGNED_SHOWN).collect()
    if odd:
        raise ValueError(f"files are not row-aligned: {[tuple(r) for r in odd]}")
    cuts = pairs.select("left", "right", "left_groups").mapInArrow(
        _cut(slice_bytes), "left string, right string, cuts array<struct<begin:long,end:long>>"
    )
    slices = cuts.select("left", "right", F.explode("cuts").alias("c")).select("left", "right", "c.begin", "c.end").checkpoint()
    schema = T.StructType([T.StructField(c.name, c.type) for side in found for c in side])
    return slices.repartition(max(1, slices.count())).mapInArrow(_read(found), schema)
