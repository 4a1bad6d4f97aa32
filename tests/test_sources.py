import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventskim.operators import stamp_rows, zip_rows
from eventskim.plans import pipelines as p
from eventskim.plans.fixtures import stored, view, write_arrays
from eventskim.schema import group_schema
from eventskim.sources import (
    copy_format,
    merge_groups,
    merge_sample,
    merge_sample_again,
    read_colgroup,
    read_columns,
    read_dynamic,
    read_group,
    read_merged,
    sum_groups,
    write_group,
    write_histogram,
)
from eventskim.sources.colgroup import common_type, cut_slices


def same(a, b):
    return a.exceptAll(b).count() == b.exceptAll(a).count() == 0


# --- Parquet groups ------------------------------------------------------------


def test_group_round_trip(spark, sf_dir, tmp_path):
    info = view(spark, sf_dir, "Info")
    write_group(info, str(tmp_path), "/Info/")
    back = read_group(spark, str(tmp_path), "Info")
    assert back.columns == info.columns
    # Wider stored values are kept as they are.
    assert back.schema["evtNum"].dataType == T.LongType()
    assert back.schema["pfMET"].dataType == T.DoubleType()
    assert same(back, info)
    slim = read_group(spark, str(tmp_path), "Info", ["EVTNUM", "pfMET"])
    assert slim.columns == ["evtNum", "pfMET"]


def test_group_binds_by_name_and_widens(spark, tmp_path):
    schema = group_schema("GenEvtInfo")
    row = {"runNum": 1, "lumiSec": 2, "evtNum": 3, "weight": 0.5, "scalePDF": 7.0}
    types = {"runNum": "smallint", "weight": "float", "scalePDF": "float"}
    stored = spark.createDataFrame([tuple(row.values())], list(row)).select(
        *[F.col(n).cast(types.get(n, "int")) for n in reversed(schema.names)]
    )
    stored.write.parquet(str(tmp_path / "GenEvtInfo" / "deep" / "er"))
    back = read_group(spark, str(tmp_path), "GenEvtInfo")
    assert back.first().asDict() == row
    assert back.schema["runNum"].dataType == T.IntegerType()
    assert back.schema["weight"].dataType == T.FloatType()


def test_group_missing_dataset(spark, tmp_path):
    spark.range(3).select(F.col("id").cast("int").alias("runNum")).write.parquet(
        str(tmp_path / "Info")
    )
    with pytest.raises(ValueError, match="missing datasets"):
        read_group(spark, str(tmp_path), "Info")
    with pytest.raises(ValueError, match="not in group"):
        read_group(spark, str(tmp_path), "Info", ["pt"])
    assert read_group(spark, str(tmp_path), "Info", ["runNum"]).count() == 3


def test_group_dotted_names_and_stamps(spark, sf_dir, tmp_path):
    tau = view(spark, sf_dir, "Tau")
    dotted = tau.toDF(*[c.replace("Tau_", "Tau.") for c in tau.columns])
    path = write_group(dotted, str(tmp_path), "Tau")
    assert same(read_group(spark, str(tmp_path), "Tau").select(*tau.columns), tau)
    assert same(read_dynamic(spark, path), tau)
    assert read_columns(spark, path, ["Tau.pt", "Tau_eta"]).columns == ["Tau_pt", "Tau_eta"]
    stamped = read_group(spark, str(tmp_path), "Tau", ["Tau_pt"], stamped=True)
    assert stamped.select("_file", "_row").distinct().count() == tau.count()


def test_partitioned_group_prunes(spark, sf_dir, tmp_path):
    tau = view(spark, sf_dir, "Tau")
    write_group(tau, str(tmp_path), "Tau", partition_by=["Tau_runNum"])
    back = read_group(spark, str(tmp_path), "Tau", partitioned=True)
    assert same(back.select(*tau.columns), tau)
    one = back.filter("Tau_runNum = 2")
    assert len(list((tmp_path / "Tau").glob("Tau_runNum=*"))) == 3
    assert "PartitionFilters: [isnotnull(Tau_runNum" in one._jdf.queryExecution().toString()
    assert one.count() == tau.filter("Tau_runNum = 2").count()


def test_merge(spark, sf_dir, tmp_path):
    gen = view(spark, sf_dir, "GenEvtInfo")
    parts = [gen.filter(F.col("runNum") == r) for r in (1, 2, 3)]
    paths = [str(tmp_path / f"in{i}") for i in range(3)]
    for part, path in zip(parts, paths):
        part.select(*reversed(gen.columns)).write.parquet(path)
    target = str(tmp_path / "TTJets_13TeV_all.h5")
    schema = copy_format(spark, paths[0], target)
    empty = spark.read.parquet(target)
    assert empty.count() == 0 and empty.schema == schema
    merge_groups(spark, paths[:1], target)
    merge_groups(spark, paths[1:], target)
    assert same(spark.read.parquet(target).select(*gen.columns), gen)
    tagged = p.merge_job(spark, paths, str(tmp_path / "again"), "TTJets_13TeV_all.h5")
    assert tagged.count() == gen.count()
    assert tagged.select("stype", "snum").distinct().collect() == [(3550785455, 319774502)]


def test_merge_refuses_other_columns(spark, tmp_path):
    a, b, t = (str(tmp_path / n) for n in "abt")
    spark.range(2).write.parquet(a)
    spark.range(2).withColumn("more", F.lit(1)).write.parquet(b)
    copy_format(spark, a, t)
    with pytest.raises(ValueError, match="columns differ"):
        merge_groups(spark, [a, b], t)
    assert spark.read.parquet(t).count() == 0


def test_histogram_file(spark, sf_dir, tmp_path):
    hist = p.electron_histograms(view(spark, sf_dir, "Electron"), view(spark, sf_dir, "Info"))
    path = tmp_path / "hist"
    write_histogram(hist, str(path))
    assert len(list(path.glob("*.csv"))) == 1
    back = spark.read.csv(str(path), header=True, schema=hist.schema)
    assert same(back, hist)
    buckets = [r["bucket"] for r in back.filter("column = 'Electron_eta'").collect()]
    assert buckets == [0, 1, 2, 3, 4]


# --- column arrays ---------------------------------------------------------------


def test_slices(spark):
    cases = [(rows, n) for rows in (0, 1, 5, 100, 101) for n in (1, 2, 3, 7, 200)]
    df = spark.createDataFrame(cases, "rows long, n int")
    for rows, n, cuts in df.select("rows", "n", cut_slices(F.col("rows"), F.col("n"))).collect():
        assert [i for a, b in cuts for i in range(a, b)] == list(range(rows))
        assert len(cuts) <= n and all(b - a == rows // n for a, b in cuts[:-1])


def save(path, **arrays):
    path.mkdir(parents=True)
    for name, values in arrays.items():
        np.save(path / f"{name.replace('__', '.')}.npy", values)


@pytest.fixture
def arrays(tmp_path):
    """Two files, one nested, and one that lacks the group."""
    for file, start, n in (("f1", 0, 10), ("sub/f2", 10, 7)):
        ids = np.arange(start, start + n)
        save(
            tmp_path / file / "Muon",
            Muon__id=ids,
            Muon__pt=(ids / 2).astype("f4"),
            Muon__w=ids / 3,
            Muon__bits=ids.astype("i4"),
            Muon__small=ids.astype("i2"),
            Muon__flag=(ids % 2).astype("i1"),
        )
        save(tmp_path / file / "Extra", Extra__sq=ids * ids)
    save(tmp_path / "f3" / "Tau", Tau__pt=np.zeros(3))
    return str(tmp_path)


def test_colgroup_types_and_rows(spark, arrays):
    df = read_colgroup(spark, arrays, "/Muon/", slices_per_file=3)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    assert kinds == {
        "Muon_id": "bigint",
        "Muon_pt": "float",
        "Muon_w": "double",
        "Muon_bits": "int",
        "Muon_small": "smallint",
        "Muon_flag": "tinyint",
    }
    assert df.rdd.getNumPartitions() == 6
    rows = {r["Muon_id"]: r for r in df.collect()}
    assert sorted(rows) == list(range(17))
    assert all(r["Muon_pt"] == i / 2 and r["Muon_w"] == i / 3 for i, r in rows.items())
    assert all((r["Muon_bits"], r["Muon_small"], r["Muon_flag"]) == (i, i, i % 2) for i, r in rows.items())


def test_colgroup_columns(spark, arrays):
    df = read_colgroup(spark, arrays, "Muon", columns=["Muon.pt", "Muon_id"])
    assert df.columns == ["Muon_pt", "Muon_id"]
    assert df.count() == 17
    with pytest.raises(Exception, match="missing datasets"):
        read_colgroup(spark, arrays, "Muon", columns=["Muon_no"])
    with pytest.raises(Exception, match="has group Kaon"):
        read_colgroup(spark, arrays, "Kaon")


def test_colgroup_slices_by_size(spark, arrays):
    read = lambda **k: read_colgroup(spark, arrays, "Muon", columns=["Muon_id"], **k)
    assert read().rdd.getNumPartitions() == 2
    assert read(slice_bytes=16).rdd.getNumPartitions() == 9
    assert sorted(r[0] for r in read(slice_bytes=16).collect()) == list(range(17))


def test_colgroup_walks_below_groups(spark, tmp_path):
    """A folder that holds the group may hold others that do."""
    save(tmp_path / "a" / "Muon", x=np.arange(3))
    save(tmp_path / "a" / "sub" / "Muon", x=np.arange(3, 5))
    assert sorted(r.x for r in read_colgroup(spark, str(tmp_path), "Muon").collect()) == list(range(5))


def test_colgroup_takes_the_wider_type(spark, tmp_path):
    save(tmp_path / "a" / "G", n=np.array([1], "i4"), x=np.array([0.1], "f4"), u=np.array([200, 255], "u1")[:1], h=np.array([1.5], "f2"))
    save(tmp_path / "b" / "G", n=np.array([2**40]), x=np.array([1e300]), u=np.array([65535], "u2"), h=np.array([2], ">i4"))
    out = read_colgroup(spark, str(tmp_path), "G")
    assert [f.dataType.simpleString() for f in out.schema] == ["double", "bigint", "int", "double"]
    rows = sorted(map(tuple, out.collect()))
    assert rows == [(1.5, 1, 200, float(np.float32(0.1))), (2.0, 2**40, 65535, 1e300)]


@pytest.mark.parametrize("kind", ["c8", "u8", "U3", "M8[s]"])
def test_colgroup_names_the_file_of_an_unknown_type(spark, tmp_path, kind):
    save(tmp_path / "a" / "G", x=np.zeros(2, kind))
    with pytest.raises(ValueError, match="G/x.npy: no column type"):
        read_colgroup(spark, str(tmp_path), "G")


def test_colgroup_refuses_what_no_type_holds(spark, tmp_path):
    save(tmp_path / "a" / "G", x=np.array([2**60]))
    save(tmp_path / "b" / "G", x=np.array([0.5]))
    with pytest.raises(ValueError, match="no common type"):
        read_colgroup(spark, str(tmp_path), "G")
    assert common_type(T.ByteType(), T.FloatType()) == T.FloatType()


def test_colgroup_refuses_arrays_of_different_length(spark, tmp_path):
    save(tmp_path / "a" / "G", x=np.arange(3), y=np.arange(5))
    with pytest.raises(ValueError, match="not row-aligned"):
        read_colgroup(spark, str(tmp_path), "G")


def test_colgroup_aligned_groups(spark, arrays, tmp_path):
    both = read_colgroup(spark, arrays, "Muon", "Extra", slices_per_file=4)
    assert both.count() == 17
    assert both.filter("Extra_sq <> Muon_id * Muon_id").count() == 0
    save(tmp_path / "f4" / "Muon", Muon__id=np.arange(5))
    save(tmp_path / "f4" / "Extra", Extra__sq=np.arange(4))
    columns = ["Muon_id", "Extra_sq"]
    with pytest.raises(Exception, match="not row-aligned"):
        read_colgroup(spark, arrays, "Muon", "Extra", columns=columns).count()


def test_colgroup_dataset_missing_in_one_file(spark, arrays, tmp_path):
    save(tmp_path / "f4" / "Muon", Muon__id=np.arange(5))
    assert read_colgroup(spark, arrays, "Muon", columns=["Muon_id"]).count() == 22
    with pytest.raises(ValueError, match="f4 are not row-aligned or not all there"):
        read_colgroup(spark, arrays, "Muon", columns=["Muon_id", "Muon_pt"])


def test_colgroup_round_trip(spark, sf_dir, tmp_path):
    electron = view(spark, sf_dir, "Electron").repartition(3)
    path = str(tmp_path / "out")
    write_arrays(electron, path, "Electron", rows_per_file=1000)
    back = read_colgroup(spark, path, "Electron", slices_per_file=2)
    assert same(back.select(*electron.columns), electron)
    lengths = [len(np.load(f)) for f in (tmp_path / "out").glob("*/Electron/Electron_pt.npy")]
    assert sum(lengths) == electron.count() and max(lengths) <= 1000 and len(lengths) > 3


def test_colgroup_routes_columns(spark, tmp_path):
    both = spark.range(10).select(F.col("id").alias("A_x"), (F.col("id") * 2).alias("B.y"))
    write_arrays(both, str(tmp_path / "ok"), "A", "B")
    back = read_colgroup(spark, str(tmp_path / "ok"), "A", "B", slices_per_file=2)
    assert {tuple(r) for r in back.select("A_x", "B_y").collect()} == {(i, 2 * i) for i in range(10)}
    with pytest.raises(Exception, match="of no group"):
        write_arrays(both.withColumn("z", F.lit(1)), str(tmp_path / "bad"), "A", "B")


def test_aligned_scan_equals_positional_join(spark, sf_dir, tmp_path):
    vjet, extra = view(spark, sf_dir, "CA15Puppi", True), view(spark, sf_dir, "AddCA15Puppi", True)
    for group, df in (("CA15Puppi", vjet), ("AddCA15Puppi", extra)):
        pdf = df.orderBy("_row").toPandas().drop(columns=["_file", "_row"])
        save(tmp_path / "f" / group, **{c: pdf[c].to_numpy() for c in pdf})
    joined = zip_rows(vjet, extra)
    scanned = read_colgroup(spark, str(tmp_path), "CA15Puppi", "AddCA15Puppi", slices_per_file=5)
    assert same(scanned.select(*joined.columns), joined)


def test_stamps_do_not_depend_on_splits(spark, sf_dir, tmp_path):
    path = str(tmp_path / "t")
    view(spark, sf_dir, "Tau").coalesce(1).write.option("parquet.block.size", "20000").parquet(path)
    whole = stamp_rows(spark.read.parquet(path)).select("_row", "Tau_pt", "Tau_evtNum")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
        cut = stamp_rows(spark.read.parquet(path)).select("_row", "Tau_pt", "Tau_evtNum")
        assert cut.rdd.getNumPartitions() > 1
        rows = {tuple(r) for r in cut.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {tuple(r) for r in whole.collect()}


@pytest.mark.parametrize("prefix", ["", "GenEvtInfo."])
def test_event_group_binds_bare_and_prefixed_names(spark, tmp_path, prefix):
    names = [f"{prefix}runNum", f"{prefix}lumisec", f"{prefix}evtNum", "weight", "scalePDF"]
    rows = spark.createDataFrame([(1, 2, 3, 0.5, 1.5)], "a int, b int, c int, d float, e float").toDF(*names)
    write_group(rows, str(tmp_path), "GenEvtInfo")
    found = read_group(spark, str(tmp_path), "GenEvtInfo")
    assert found.columns == ["runNum", "lumiSec", "evtNum", "weight", "scalePDF"]
    assert tuple(found.first()) == (1, 2, 3, 0.5, 1.5)


def test_binding_refuses_long_for_fractions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3, 2**60, 1.5)], "runNum int, lumiSec int, evtNum int, weight long, scalePDF float")
    write_group(rows, str(tmp_path), "GenEvtInfo")
    with pytest.raises(ValueError, match="no common type"):
        read_group(spark, str(tmp_path), "GenEvtInfo")


def test_merge_never_narrows(spark, tmp_path):
    spark.createDataFrame([(0.1, 1)], "x double, n int").write.parquet(str(tmp_path / "wide"))
    spark.createDataFrame([(0.5, 2)], "x float, n int").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="x is double, which float would cut"):
        merge_groups(spark, [str(tmp_path / "wide")], str(tmp_path / "t"))
    merge_groups(spark, [str(tmp_path / "t")], str(tmp_path / "wide"))
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "wide")).collect()) == [0.1, 0.5]


def test_merge_sample(spark, sf_dir, tmp_path):
    for name in ("ttbar_a", "wjets_b"):
        for group in ("Muon", "GenEvtInfo"):
            write_group(stored(spark, sf_dir, group), str(tmp_path / name), group)
    sources = [str(tmp_path / name) for name in ("ttbar_a", "wjets_b")]
    assert sorted(merge_sample(spark, sources, str(tmp_path / "m"))) == ["GenEvtInfo", "Muon"]
    merged = spark.read.parquet(str(tmp_path / "m" / "Muon"))
    tags = {tuple(r) for r in merged.select("stype", "snum").distinct().collect()}
    assert tags == {tuple(zlib.crc32(t.encode()) for t in pair) for pair in (("ttbar", "ttbar_a"), ("wjets", "wjets_b"))}
    assert merged.count() == 2 * view(spark, sf_dir, "Muon").count()
    sums = {(r.group, r.dataset): r.total for r in sum_groups(spark, str(tmp_path / "m")).collect()}
    assert sums["Muon", "snum"] == merged.agg(F.sum("snum")).first()[0]
    with pytest.raises(ValueError, match="no group below"):
        sum_groups(spark, str(tmp_path))


def test_groups_outside_the_catalogue_count(spark, tmp_path):
    """Uncatalogued groups are merged and summed; one that any sample lacks is named."""
    for name in ("ttbar_a", "wjets_b"):
        for group in ("GenEvtInfo", "Extra"):
            rows = spark.createDataFrame([(1, 0.5)], "runNum int, weight double")
            rows.write.parquet(str(tmp_path / name / group))
    sources = [str(tmp_path / name) for name in ("ttbar_a", "wjets_b")]
    assert merge_sample(spark, sources, str(tmp_path / "m")) == ["GenEvtInfo", "Extra"]
    sums = {(r.group, r.dataset): r.total for r in sum_groups(spark, str(tmp_path / "m")).collect()}
    assert sums["Extra", "weight"] == sums["GenEvtInfo", "weight"] == 1.0
    rows.write.parquet(f"{sources[1]}/Later")
    with pytest.raises(ValueError, match="Later in .*ttbar_a"):
        merge_sample(spark, sources, str(tmp_path / "n"))
    assert merge_sample(spark, sources, str(tmp_path / "o"), ["Extra"]) == ["Extra"]


def test_merging_again_gives_the_same_rows(spark, tmp_path):
    """Twice, one sample anew with fewer rows or none, and after a merge that broke off."""
    def sample(name, n, kind="int"):
        path = str(tmp_path / name)
        for group in ("GenEvtInfo", "Extra"):
            spark.range(n).select(F.col("id").cast(kind).alias("x.n")).write.mode("overwrite").parquet(f"{path}/{group}")
        return path

    a, b = sample("ttbar_a", 5), sample("wjets_b", 3, "smallint")
    target = str(tmp_path / "m")
    rows = lambda g="Extra": sorted((r["x.n"], r.snum) for r in read_merged(spark, target, g).collect())
    tags = [zlib.crc32(n.encode()) for n in ("ttbar_a", "wjets_b")]
    want = sorted([(i, tags[0]) for i in range(5)] + [(i, tags[1]) for i in range(3)])
    for sources in ([a, b], [a, b], [b], [a]):
        assert merge_sample_again(spark, sources, target) == ["GenEvtInfo", "Extra"]
        assert rows() == rows("GenEvtInfo") == want
    # A folder that was not written to its end is no sample, and is written anew.
    (tmp_path / "m" / "Extra" / "sample=wjets_b" / "_SUCCESS").unlink()
    assert rows() == [(i, tags[0]) for i in range(5)]
    merge_sample_again(spark, [a, b], target)
    assert rows() == want
    merge_sample_again(spark, [sample("ttbar_a", 0), b], target)
    assert rows() == [(i, tags[1]) for i in range(3)]
    with pytest.raises(ValueError, match="x.n is bigint, which int would cut"):
        merge_sample_again(spark, [sample("ttbar_a", 2, "bigint")], target)
    with pytest.raises(ValueError, match="samples of one name"):
        merge_sample_again(spark, [a, a], target)
    with pytest.raises(ValueError, match="tag is"):
        merge_sample(spark, [a, b], str(tmp_path / "t"), tag="none")
    with pytest.raises(ValueError, match="no sample merged"):
        read_merged(spark, target, "Muon")
