"""Row identity: stamps from the scan, joins by row position, dense numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

FILE, ROW = "_file", "_row"
MISALIGNED_SHOWN = 5
#: Rows of a file or partition that meet their base in one task: 2 to this power.
CHUNK_BITS = 18


def _prefixes(df: DataFrame, root: str) -> list[str]:
    """How the scan may begin the paths of files below ``root``: absolute and escaped."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    scheme, host, rest = uri.getScheme(), uri.getAuthority() or "", uri.getRawPath().rstrip("/")
    # A path without a host is written with one slash or with three.
    return [f"{scheme}://{host}{rest}", *([] if host else [f"{scheme}:{rest}"])]


def stamp_rows(df: DataFrame, root: str | None = None) -> DataFrame:
    """Add the scan's own row id: file (``_file``) and position in it (``_row``).

    ``df`` must come straight from a Parquet read. The id does not depend on how
    the scan was split, so a retried task gives the same one. ``_file`` is the path
    below ``root``, with which files of two tables are told to be the same; without
    it, the whole path. Paths are escaped as the scan names them. Files outside
    ``root`` are an error.
    """
    path = file = F.col("_metadata.file_path")
    if root is not None:
        file = F.raise_error(F.concat(F.lit("not below the root: "), path)).cast("string")
        for prefix in _prefixes(df, root):
            # A root that is itself the file has an empty rest.
            below = F.startswith(path, F.lit(prefix + "/")) | (path == prefix)
            file = F.when(below, F.substr(path, F.lit(len(prefix) + 2))).otherwise(file)
    return df.select("*", file.alias(FILE), F.col("_metadata.row_index").alias(ROW))


def zip_rows(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join two stamped tables row by row.

    The row number leads the key: it tells rows apart at once when sorting,
    while the file name repeats. No key repeats, so no task is larger than another.
    """
    return left.join(right, [ROW, FILE], how).drop(ROW, FILE)


def misaligned_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files whose row counts differ between two stamped, unfiltered tables.

    An inner :func:`zip_rows` would drop such surplus rows without a word. Only
    row counts are read.
    """
    a = left.groupBy(FILE).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(FILE).agg(F.count(F.lit(1)).alias("right_rows"))
    both = a.join(b, FILE, "full").fillna(0, ["left_rows", "right_rows"])
    return both.filter("left_rows <> right_rows")


def check_aligned(left: DataFrame, right: DataFrame) -> None:
    """Raise if :func:`misaligned_files` finds any. Runs a job that counts rows by file."""
    bad = misaligned_files(left, right).limit(MISALIGNED_SHOWN).collect()
    if bad:
        raise ValueError(f"tables are not row-aligned: {[tuple(r) for r in bad]}")


def _prefix_sums(counts: DataFrame, order: str) -> DataFrame:
    # One row per file or partition, never per data row.
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(order, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), "_n")


def _add_bases(rows: DataFrame, bases: DataFrame, key: str, index: str) -> DataFrame:
    """Number the rows from their group's base. How to join is left to the engine.

    Each base has a row for each chunk of its group, so that a join that moves the rows
    does not bring a whole file or partition to one task.
    """
    chunk = F.shiftright("_pos", CHUNK_BITS)
    chunks = F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("_n") - 1, CHUNK_BITS))
    bases = bases.select(key, "_base", F.explode(chunks).alias("_chunk"))
    numbered = rows.withColumn("_chunk", chunk).join(bases, [key, "_chunk"]).withColumn(index, F.col("_base") + F.col("_pos"))
    return numbered.drop(key, "_chunk", "_pos", "_base")


def index_scan_rows(df: DataFrame, index: str = "_index") -> DataFrame:
    """Number the rows of a whole Parquet scan 0..n-1, files in path order.

    Counting reads Parquet footers only. Each row adds its position in its file
    to the rows of the files before, so retried tasks give the same numbers.
    """
    path = F.col("_metadata.file_path").alias("_path")
    counts = df.select(path).groupBy("_path").agg(F.count(F.lit(1)).alias("_n"))
    rows = df.select("*", path, F.col("_metadata.row_index").alias("_pos"))
    return _add_bases(rows, _prefix_sums(counts, "_path"), "_path", index)


def add_row_index(df: DataFrame, index: str = "_index") -> DataFrame:
    """Number the rows of any table 0..n-1. Runs a job: the input is checkpointed.

    The rows are read twice, to count and to number them, and both reads must
    see the same partitions. A checkpoint in shared storage fixes them, also
    across a lost executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    saved = df.checkpoint()
    part = F.spark_partition_id()
    rows = saved.withColumns(
        {
            "_part": part,
            "_pos": F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33),
        }
    )
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    return _add_bases(rows, _prefix_sums(counts, "_part"), "_part", index)
