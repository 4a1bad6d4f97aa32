import pytest
from pyspark.sql import functions as F

from eventskim.operators import (
    add_row_index,
    index_scan_rows,
    misaligned_files,
    stamp_rows,
    tag_provenance,
    zip_rows,
)
from eventskim.plans.fixtures import load


@pytest.fixture
def pair(spark, tmp_path):
    """Two groups with the same file names, three files each, one nested."""
    paths = [str(tmp_path / name) for name in ("left", "right")]
    for path, scale in zip(paths, (1, 10)):
        for i, sub in enumerate(("", "", "/nested")):
            rows = spark.range(i * 100, i * 100 + 50 + i, 1, 1)
            rows = rows.select((F.col("id") * scale).alias(f"v{scale}"))
            target = tmp_path / f"tmp{scale}{i}"
            rows.write.parquet(str(target))
            [part] = target.glob("part-*.parquet")
            folder = tmp_path / (path.rsplit("/", 1)[-1] + sub)
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"run{i}.parquet").write_bytes(part.read_bytes())
    return paths


def scan(spark, path):
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def test_zip(spark, pair):
    left, right = (stamp_rows(scan(spark, path), path) for path in pair)
    both = zip_rows(left, right)
    assert both.columns == ["v1", "v10"]
    assert both.count() == 153
    assert both.filter("v10 <> v1 * 10").count() == 0
    assert misaligned_files(left, right).count() == 0


def test_zip_left_and_misaligned(spark, pair):
    left, right = (stamp_rows(scan(spark, path), path) for path in pair)
    short = right.filter("NOT (_file = 'nested/run2.parquet' AND _row >= 51)")
    assert zip_rows(left, short, "left").filter("v10 IS NULL").count() == 1
    [row] = misaligned_files(left, short).collect()
    assert tuple(row) == ("nested/run2.parquet", 52, 51)


def test_filter_before_zip_keeps_positions(spark, sf_dir):
    lines = stamp_rows(load(spark, sf_dir, "lineitem"))
    left = lines.select("l_orderkey", "l_partkey", "_file", "_row").filter("l_partkey > 100")
    right = lines.select(F.col("l_partkey").alias("other"), "_file", "_row")
    both = zip_rows(left, right)
    assert both.count() == left.count()
    assert both.filter("l_partkey <> other").count() == 0


def test_scan_index_is_dense(spark, pair):
    out = index_scan_rows(scan(spark, pair[0]))
    got = sorted(r["_index"] for r in out.collect())
    assert got == list(range(153))
    again = {tuple(r) for r in index_scan_rows(scan(spark, pair[0])).collect()}
    assert again == {tuple(r) for r in out.collect()}


def test_zip_of_a_partitioned_table(spark, tmp_path):
    """Each folder's files have the same names; rows are still paired one to one."""
    path = str(tmp_path / "with space+plus")
    spark.range(60).select("id", (F.col("id") % 3).alias("part")).coalesce(1).write.partitionBy("part").parquet(path)
    for root in (None, path, f"file:{path}"):
        one = stamp_rows(spark.read.parquet(path), root)
        assert zip_rows(one, one.select(F.col("id").alias("other"), "_file", "_row")).filter("id = other").count() == 60
        assert zip_rows(one, one.select(F.col("id").alias("other"), "_file", "_row")).count() == 60
    names = {r[0] for r in stamp_rows(spark.read.parquet(path), path).select("_file").distinct().collect()}
    assert len(names) == 3 and all(n.startswith("part=") for n in names)
    with pytest.raises(Exception, match="not below the root"):
        stamp_rows(spark.read.parquet(path), str(tmp_path / "other")).collect()


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_index_of_any_table(spark, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        check_index(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def check_index(spark):
    df = spark.range(0, 1000, 1, 7).filter("id % 3 <> 0").repartition(5, "id")
    out = add_row_index(df)
    assert sorted(r["_index"] for r in out.collect()) == list(range(df.count()))
    assert sorted(r["id"] for r in out.collect()) == sorted(r["id"] for r in df.collect())


def test_a_file_is_numbered_by_several_tasks(spark, tmp_path, monkeypatch):
    """A join that moves the rows deals one file's over tasks."""
    monkeypatch.setattr("eventskim.operators.rows.CHUNK_BITS", 4)
    spark.range(1000).coalesce(1).write.parquet(path := str(tmp_path / "one"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("-1", "false")):
        spark.conf.set(name, value)
    try:
        for numbered in (index_scan_rows(spark.read.parquet(path)), add_row_index(spark.read.parquet(path))):
            rows = numbered.withColumn("task", F.spark_partition_id()).collect()
            assert sorted(r["_index"] for r in rows) == list(range(1000))
            assert len({r.task for r in rows}) > 4
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_provenance(spark, tmp_path):
    path = tmp_path / "TTJets_13TeV_all.h5"
    rows = spark.range(3)
    named = tag_provenance(rows, F.lit(path.name))
    assert {tuple(r)[1:] for r in named.collect()} == {(3550785455, 319774502)}
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    scanned = tag_provenance(spark.read.parquet(str(tmp_path / "t")))
    assert scanned.select("stype", "snum").distinct().count() == 1
