"""Groups stored as Parquet: ``<root>/<group>/``, files at any depth below it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregates import column_sums
from ..operators.exact import exact_sums
from ..operators.provenance import tag_provenance
from ..operators.rows import FILE, ROW, stamp_rows
from ..schema import GROUP_FIELDS, column_name, group_schema
from .folders import folder_columns, read_folder


def _quoted(name: str):
    return F.col(f"`{name}`")


def _wanted(group: str, columns: Sequence[str] | None) -> T.StructType:
    schema = group_schema(group)
    if columns is None:
        return schema
    known = {f.name.lower(): f for f in schema}
    unknown = [c for c in columns if c.lower() not in known]
    if unknown:
        raise ValueError(f"not in group {group}: {unknown}")
    return T.StructType([known[c.lower()] for c in columns])


def _stored(found: T.StructType, wanted: T.StructType, group: str) -> T.StructType:
    """The found fields that carry ``wanted``, by name after renaming.

    Fields of event groups are stored bare or with the group's name before them.
    """
    by_name = {column_name(f.name).lower(): f for f in found}
    prefix = f"{group.strip('/').lower()}_"
    for name in list(by_name):
        if name.startswith(prefix):
            by_name.setdefault(name.removeprefix(prefix), by_name[name])
    missing = [f.name for f in wanted if f.name.lower() not in by_name]
    if missing:
        raise ValueError(f"missing datasets: {missing}")
    return T.StructType([by_name[f.name.lower()] for f in wanted])


_WIDENING = (
    T.ByteType(),
    T.ShortType(),
    T.IntegerType(),
    T.LongType(),
    T.FloatType(),
    T.DoubleType(),
)


def _wider(stored: T.DataType, wanted: T.DataType) -> T.DataType:
    if stored not in _WIDENING:
        raise ValueError(f"a dataset cannot be {stored.simpleString()}")
    if T.LongType() in (stored, wanted) and {stored, wanted} & {T.FloatType(), T.DoubleType()}:
        raise ValueError("64-bit integers and fractions have no common type")
    if {stored, wanted} == {T.FloatType(), T.IntegerType()}:
        return T.DoubleType()
    return max(stored, wanted, key=_WIDENING.index)


def bind_group(
    df: DataFrame, group: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Give ``df`` the catalogue's columns of ``group``, or those in ``columns``.

    Columns are found by name, whatever their order, and row stamps stay. A field
    gets its catalogue type, or the one it has where that is wider, so no value is
    ever cut; 64-bit integers for fractions are an error, as is a missing dataset.
    """
    wanted = _wanted(group, columns)
    cast = [
        _quoted(s.name).cast(_wider(s.dataType, w.dataType)).alias(w.name)
        for s, w in zip(_stored(df.schema, wanted, group), wanted)
    ]
    return df.select(*cast, *[c for c in (FILE, ROW) if c in df.columns])


def read_group(
    spark: SparkSession,
    root: str,
    group: str,
    columns: Sequence[str] | None = None,
    stamped: bool = False,
    partitioned: bool = False,
) -> DataFrame:
    """Load a catalogue group, bound as :func:`bind_group` does.

    ``stamped`` adds the row ids that :func:`~eventskim.operators.zip_rows` joins on:
    those stored with the group if it was written with them, else the scan's own.
    The latter pair two groups whose files have the same names.
    ``partitioned`` is for a group written with ``partition_by``: those columns are
    read from the folder names, and a filter on them leaves folders out.
    """
    path = f"{root.rstrip('/')}/{group.strip('/')}"
    nested = str(not partitioned).lower()
    raw = spark.read.option("recursiveFileLookup", nested).parquet(path)
    if not stamped:
        raw = raw.drop(FILE, ROW)
    elif FILE not in raw.columns:
        raw = stamp_rows(raw, path)
    return bind_group(raw, group, columns)


def read_dynamic(spark: SparkSession, path: str) -> DataFrame:
    """Load every column that any file below ``path`` has, renamed to the column rule.

    Files may differ: a column has the type that holds all files' values, and is NULL
    in the rows of a file without it. See :func:`~eventskim.sources.folders.read_folder`.
    """
    return read_folder(spark, path)


def read_columns(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """Load named columns (dataset or column names) from all files below ``path``.

    A file that lacks one of them is an error that names both.
    """
    return read_folder(spark, path, columns=list(columns), absent="error")


def write_group(
    df: DataFrame,
    root: str,
    group: str,
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> str:
    """Store ``df`` as a group; partitioning by run lets some runs be read alone.

    A partitioned write first brings the rows of a partition together, so that not
    every task writes a file into each. The rebalance splits a large partition
    among tasks again.
    """
    path = f"{root.rstrip('/')}/{group.strip('/')}"
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def copy_format(spark: SparkSession, source: str, target: str) -> T.StructType:
    """Make an empty group at ``target`` with the columns and types of ``source``.

    ``source`` may be a folder of files that differ; the copy has all their columns.
    """
    found = folder_columns(spark, source)
    schema = T.StructType([T.StructField(c.stored[0], c.type) for c in found])
    spark.createDataFrame([], schema).coalesce(1).write.mode("errorifexists").parquet(target)
    return schema


def _appended(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` as a group of ``schema`` stores them; a type that holds less is an error."""
    if {c.lower() for c in rows.columns} != {n.lower() for n in schema.names}:
        raise ValueError(f"columns differ: {rows.columns} and {schema.names}")
    found = {f.name.lower(): f.dataType for f in rows.schema}
    for f in schema:
        kind = found[f.name.lower()]
        if kind != f.dataType and _wider(kind, f.dataType) != f.dataType:
            raise ValueError(f"{f.name} is {kind.simpleString()}, which {f.dataType.simpleString()} would cut")
    return rows.select(*[_quoted(f.name).cast(f.dataType).alias(f.name) for f in schema])


def merge_groups(spark: SparkSession, sources: Sequence[str], target: str) -> None:
    """Append the rows of every source to the group at ``target``, bound by name.

    The columns of the target rule. They must be those of the sources, all of
    whose files are looked at, in parallel, and their types must hold all values.
    """
    schema = read_folder(spark, target, rename=False).schema
    _appended(read_folder(spark, *sources, rename=False), schema).write.mode("append").parquet(target)


def stored_groups(spark: SparkSession, root: str) -> list[str]:
    """Names of all groups that have a folder below ``root``, the catalogue's first.

    A folder outside the catalogue is a group too. It must hold files or partitions: one
    that holds only other folders, or nothing, is an error, since it may be a sample.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(context._jsc.hadoopConfiguration())

    def shown(folder) -> list:
        found = [(s.getPath().getName(), s) for s in store.listStatus(folder)]
        return [(name, s) for name, s in found if not name.startswith(("_", "."))]

    folders = {name: s.getPath() for name, s in shown(path) if s.isDirectory()}
    others = sorted(set(folders) - set(GROUP_FIELDS))
    for name in others:
        if not any(s.isFile() or "=" in inner for inner, s in shown(folders[name])):
            raise ValueError(f"no group below {root}: {name} has no files of its own")
    return [*(g for g in GROUP_FIELDS if g in folders), *others]


def _last_part(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _common_groups(spark: SparkSession, sources: Sequence[str]) -> list[str]:
    """All groups of all samples; one that a sample lacks is an error."""
    stored = {source: stored_groups(spark, source) for source in sources}
    groups = list(dict.fromkeys(g for found in stored.values() for g in found))
    missing = [f"{g} in {source}" for g in groups for source, found in stored.items() if g not in found]
    if missing:
        raise ValueError(f"missing groups: {missing}")
    return groups


def _tagged(spark: SparkSession, sources: Sequence[str], group: str, target: str, tag: str) -> list[DataFrame]:
    """The rows of ``group`` of each sample, with the tags that are stored with them."""
    if tag not in ("sample", "target"):
        raise ValueError("tag is 'sample' or 'target'")
    return [
        tag_provenance(
            read_folder(spark, f"{source.rstrip('/')}/{group}", rename=False),
            F.lit(_last_part(source if tag == "sample" else target)),
        )
        for source in sources
    ]


def merge_sample(
    spark: SparkSession, sources: Sequence[str], target: str, groups: Sequence[str] | None = None, tag: str = "sample"
) -> list[str]:
    """Merge samples, folders of groups, into a new one at ``target``; the merged groups.

    Each row is stored with the tags ``stype`` and ``snum`` of its sample's name, the
    last part of its folder, or with ``tag="target"`` of the merged folder's. All groups of
    all samples are merged, and one that a sample lacks is an error; or those in
    ``groups`` are. The first sample gives the columns, and types must hold the others'.
    A target that exists is an error; :func:`merge_sample_again` may be run twice.
    """
    groups = list(groups) if groups else _common_groups(spark, sources)
    for group in groups:
        tagged = _tagged(spark, sources, group, target, tag)
        schema = tagged[0].schema
        merged = reduce(DataFrame.unionAll, [_appended(rows, schema) for rows in tagged])
        merged.write.mode("errorifexists").parquet(f"{target.rstrip('/')}/{group}")
    return groups


#: Column that names the folders of a merged group's samples.
SAMPLE = "sample"


def merge_sample_again(
    spark: SparkSession, sources: Sequence[str], target: str, groups: Sequence[str] | None = None, tag: str = "sample"
) -> list[str]:
    """:func:`merge_sample` into a target whose groups have a folder for each sample.

    What a folder held is replaced as a whole, so merging twice, or once more after a merge
    that failed half-way, gives the same rows, and samples may be merged one after another
    or anew. The columns and types of a group are those of its first merge, and no later
    value is cut. Samples are told apart by the last part of their folders, which must
    differ. :func:`read_merged` reads a group.
    """
    names = [_last_part(source) for source in sources]
    if len(set(names)) < len(names):
        raise ValueError(f"samples of one name: {sorted(n for n in set(names) if names.count(n) > 1)}")
    groups = list(groups) if groups else _common_groups(spark, sources)
    for group in groups:
        path = f"{target.rstrip('/')}/{group}"
        tagged = _tagged(spark, sources, group, target, tag)
        schema = read_merged(spark, target, group).schema if _holds_files(spark, path) else tagged[0].schema
        for name, rows in zip(names, tagged):
            rows = _appended(rows, schema)
            # A folder of its own for each: what another sample's holds is left as it is.
            rows.write.mode("overwrite").parquet(f"{path}/{SAMPLE}={name}")
    return groups


def _holds_files(spark: SparkSession, path: str) -> bool:
    """Whether any sample's folder below ``path`` was written to its end."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(context._jsc.hadoopConfiguration())
    whole = store.globStatus(context._jvm.org.apache.hadoop.fs.Path(f"{path}/{SAMPLE}=*/_SUCCESS"))
    return bool(whole)


def read_merged(spark: SparkSession, target: str, group: str) -> DataFrame:
    """The rows of a group that :func:`merge_sample_again` stored, with dataset names and tags.

    Folders that a merge did not write to their end are left out.
    """
    context = spark.sparkContext
    path = f"{target.rstrip('/')}/{group}"
    root = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{SAMPLE}=*/_SUCCESS")
    store = root.getFileSystem(context._jsc.hadoopConfiguration())
    whole = [s.getPath().getParent().toString() for s in store.globStatus(root)]
    if not whole:
        raise ValueError(f"no sample merged at {path}")
    return read_folder(spark, *whole, rename=False)


def sum_groups(spark: SparkSession, root: str, exact: bool = True) -> DataFrame:
    """Sums of all columns of all groups below ``root``: (group, dataset, total).

    The sums do not depend on the order of the rows; those that are not ``exact`` may
    differ in their last digits, and take less time.
    """
    add = exact_sums if exact else column_sums
    sums = [add(read_dynamic(spark, f"{root.rstrip('/')}/{g}"), g) for g in stored_groups(spark, root)]
    if not sums:
        raise ValueError(f"no group below {root}")
    return reduce(DataFrame.unionAll, sums)


def write_histogram(hist: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a histogram as one CSV file in bucket order.

    It has a row per bucket. Those are brought together after the counts are
    complete, so that the counting itself stays spread over the tasks.
    """
    order = [c for c in ("column", "bucket") if c in hist.columns]
    one = hist.repartition(1).sortWithinPartitions(*order)
    one.write.mode(mode).option("header", "true").csv(path)
