import csv

import pytest

from eventskim import job, session
from eventskim.operators import filter_muon, filter_muon_udf, zip_rows
from eventskim.plans import pipelines as p
from eventskim.plans.fixtures import view, write_arrays
from eventskim.sources import read_group, write_group
from eventskim.timing import (
    compare,
    event_count_test,
    read_and_count_test,
    timed,
    weight_sum_test,
)


def test_timing(spark, sf_dir, root):
    gen = view(spark, sf_dir, "GenEvtInfo")
    n = gen.count()
    assert [t.value for t in event_count_test(spark, root, 3)] == [n] * 3
    total = gen.selectExpr("sum(weight)").first()[0]
    assert [t.value for t in weight_sum_test(spark, root, 2)] == [(total, n)] * 2
    assert read_and_count_test(spark, f"{root}/GenEvtInfo", ["weight"]).value == n
    assert all(t.seconds > 0 for t in timed(gen, lambda df: df.count(), 2))


def test_timing_of_two_forms(spark, sf_dir):
    out = compare(view(spark, sf_dir, "Muon"), {"native": filter_muon, "udf": filter_muon_udf}, 2)
    assert len({t.value for times in out.values() for t in times}) == 1


def test_histogram_job(spark, sf_dir, root, tmp_path):
    out = tmp_path / "hist"
    job.main(["--data", root, "--out", str(out)])
    [file] = out.glob("*.csv")
    rows = list(csv.DictReader(file.open()))
    want = p.leading_electrons(view(spark, sf_dir, "Electron"), view(spark, sf_dir, "Info")).count()
    for column in ("Electron_pt", "Electron_eta"):
        assert sum(int(r["n"]) for r in rows if r["column"] == column) == want


@pytest.mark.parametrize("analysis", [a for a in job.ANALYSES if a != "histograms"])
def test_analysis_job(spark, root, tmp_path, analysis):
    job.main(["--data", root, "--out", str(tmp_path / "out"), "--analysis", analysis])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_jets_job_refuses_unpaired_files(spark, sf_dir, tmp_path):
    """Two separate writes name their files apart, so rows could not be paired."""
    for group in ("CA15Puppi", "AddCA15Puppi"):
        write_group(view(spark, sf_dir, group), str(tmp_path / "data"), group)
    with pytest.raises(ValueError, match="not row-aligned"):
        job.Groups(spark, str(tmp_path / "data")).vjets()


def test_jobs_on_column_arrays(spark, sf_dir, root, tmp_path):
    """The same results from column arrays as from Parquet, the rows paired by the scan."""
    data = str(tmp_path / "arrays")
    for group in ("Muon", "AK4Puppi", "Info"):
        write_arrays(view(spark, sf_dir, group), data, group)
    pairs = zip_rows(view(spark, sf_dir, "CA15Puppi", True), view(spark, sf_dir, "AddCA15Puppi", True))
    write_arrays(pairs, data, "CA15Puppi", "AddCA15Puppi", rows_per_file=500)
    for analysis in ("muons", "jets"):
        for source, where in (("colgroup", data), ("parquet", root)):
            argv = ["--data", where, "--source", source, "--slices-per-file", "3"]
            out = str(tmp_path / f"{analysis}-{source}")
            job.main([*argv, "--out", out, "--analysis", analysis])
        a, b = (spark.read.parquet(str(tmp_path / f"{analysis}-{s}")) for s in ("colgroup", "parquet"))
        assert a.count() > 0
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_shared_dir_follows_the_session():
    class Conf:
        def get(self, key, default):
            return {"spark.checkpoint.dir": "hdfs://shared/ckpt/"}.get(key, default)

    class Session:
        conf = Conf()

    assert session.shared_dir(Session()) == "hdfs://shared/ckpt"


def test_shuffle_follows_the_input(spark, root, monkeypatch):
    muon = read_group(spark, root, "Muon")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert session.size_shuffle(muon) == int(before)
        monkeypatch.setattr(session, "BYTES_PER_SHUFFLE_PARTITION", 1000)
        assert session.size_shuffle(muon) > 50
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert session.size_shuffle(p.leading_muons(muon)) > 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shared_dir_follows_the_context():
    class Context:
        @staticmethod
        def getCheckpointDir():
            return "hdfs://shared/ckpt/run"

    class Session:
        conf = {}
        sparkContext = Context

    assert session.shared_dir(Session()) == "hdfs://shared/ckpt/run"


def test_shared_dir_is_needed_on_a_cluster():
    class Context:
        applicationId, master = "app", "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_work_dirs_are_new(spark):
    one, two = (session.work_dir(spark, "merge") for _ in range(2))
    assert one != two and one.startswith(session.shared_dir(spark) + "/merge-")


@pytest.mark.parametrize(("analysis", "columns"), [("weights", ["sum_weight", "n_events"]), ("events", ["n_events"])])
def test_event_programs(spark, root, tmp_path, analysis, columns):
    job.main(["--data", root, "--out", str(tmp_path / "out"), "--analysis", analysis])
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == columns and out.first()["n_events"] == read_group(spark, root, "GenEvtInfo").count()


def test_sums_merge_and_copy(spark, sf_dir, tmp_path):
    for name in ("a_1", "b_2"):
        write_group(view(spark, sf_dir, "GenEvtInfo"), str(tmp_path / name), "GenEvtInfo")
    data = [str(tmp_path / name) for name in ("a_1", "b_2")]
    merged = str(tmp_path / "merged")
    job.main(["--data", *data, "--out", merged, "--analysis", "merge"])
    assert {"stype", "snum"} < set(spark.read.parquet(f"{merged}/GenEvtInfo").columns)
    job.main(["--data", merged, "--out", str(tmp_path / "sums"), "--analysis", "sums"])
    one, both = (view(spark, sf_dir, "GenEvtInfo").agg({"weight": "sum"}).first()[0] * k for k in (1, 2))
    sums = {r.dataset: r.total for r in spark.read.parquet(str(tmp_path / "sums")).collect()}
    assert sums["weight"] == both != one
    job.main(["--data", f"{merged}/GenEvtInfo", "--out", str(tmp_path / "empty"), "--analysis", "copy"])
    empty = spark.read.parquet(str(tmp_path / "empty"))
    assert empty.count() == 0 and "snum" in empty.columns
    with pytest.raises(SystemExit):
        job.main(["--data", *data, "--out", str(tmp_path / "no"), "--analysis", "count"])
