"""Column arrays through Spark's own reader."""

import re

import numpy as np
import pytest

from eventskim.sources import read_colgroup, register_arrays, scan_arrays

from .test_sources import arrays, same, save  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_and_types_are_those_of_the_reader(spark, arrays):  # noqa: F811
    a, b = scan_arrays(spark, arrays, "/Muon/", slices_per_file=3), read_colgroup(spark, arrays, "Muon")
    assert a.schema == b.schema and same(a, b) and a.rdd.getNumPartitions() == 6
    both = scan_arrays(spark, arrays, "Muon", "Extra", slices_per_file=4)
    assert both.count() == 17 and both.filter("Extra_sq <> Muon_id * Muon_id").count() == 0
    assert scan_arrays(spark, arrays, "Muon", columns=["Muon.id"], slice_bytes=16).rdd.getNumPartitions() == 13 + 12


def test_format_finds_the_schema_itself(spark, arrays):  # noqa: F811
    register_arrays(spark)
    read = lambda **k: spark.read.format("column_arrays").options(**{"groups": "Muon", **k})
    assert read().load(arrays).schema == read_colgroup(spark, arrays, "Muon").schema
    assert sorted(r.Muon_id for r in read(columns="Muon.id, Muon_w").load(arrays).collect()) == list(range(17))
    assert read().schema("Muon_small smallint").load(arrays).count() == 17
    assert read().load(f"file:{arrays}").count() == 17
    with pytest.raises(Exception, match="has group Kaon"):
        read(groups="Kaon").schema("x int").load(arrays).count()
    for options, message in (({"groups": "Kaon"}, "has group Kaon"), ({"columns": "no"}, "missing datasets"), ({"groups": ""}, "has group")):
        with pytest.raises(Exception, match=message):
            read(**options).load(arrays).count()


def test_ranges_skip_rows(spark, arrays):  # noqa: F811
    read = lambda **k: sorted(r.Muon_id for r in scan_arrays(spark, arrays, "Muon", slices_per_file=3, **k).collect())
    assert read(ranges={"Muon.id": (4, 12)}) == list(range(4, 12))
    assert read(ranges={"Muon_ID": (None, 3), "Muon_flag": (1, None)}) == [1]
    assert read(ranges={"Muon_pt": (7.5, None)}) == [15, 16]
    assert read(ranges={"Muon_bits": (100, None)}) == []
    df = scan_arrays(spark, arrays, "Muon", ranges={"Muon_id": (5, 9)})
    assert (df.filter("Muon_id = 6").count(), df.count(), df.filter("Muon_id > 6").count()) == (1, 4, 2)
    with pytest.raises(Exception, match="which is not read"):
        scan_arrays(spark, arrays, "Muon", columns=["Muon_id"], ranges={"Muon_pt": (1, 2)}).count()


@pytest.mark.parametrize(
    ("condition", "pushed"),
    [
        ("Muon_id >= 4 AND Muon_id < 12", 2), ("Muon_id = 5", 1), ("Muon_id IN (1, 3, 99)", 1), ("Muon_w > 2.5", 1),
        ("Muon_x > 1", 1), ("Muon_x <= 1", 1), ("Muon_x = 2", 1), ("Muon_id % 2 = 0 AND Muon_id > 3", 1), ("Muon_id = 1 OR Muon_w > 4", 0),
    ],
)
def test_pushed_filters(spark, arrays, tmp_path, condition, pushed):  # noqa: F811
    """The scan evaluates comparisons; NaN counts as larger than all numbers."""
    for file, n in (("f1", 10), ("sub/f2", 7)):
        x = np.arange(n, dtype="f8")
        x[::3] = np.nan
        np.save(tmp_path / file / "Muon" / "Muon.x.npy", x)
    df = scan_arrays(spark, arrays, "Muon", push_filters=True, slices_per_file=2).filter(condition)
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = re.search(r"PushedFilters: (.*)", text)
    assert len(re.findall(r"\w+\(Muon", found[1] if found else "")) == pushed
    assert ("Filter " in plan(df)) == (pushed == 0 or "%" in condition)
    want = read_colgroup(spark, arrays, "Muon").filter(condition)
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect())) != []


def test_only_named_columns_are_scanned(spark, arrays):  # noqa: F811
    assert "Muon_pt" not in plan(scan_arrays(spark, arrays, "Muon", columns=["Muon_id"]))


def test_files_that_do_not_fit(spark, arrays, tmp_path):  # noqa: F811
    save(tmp_path / "f4" / "Muon", Muon__id=np.arange(5))
    assert scan_arrays(spark, arrays, "Muon", columns=["Muon_id"]).count() == 22
    with pytest.raises(Exception, match="f4 are not all there: .*Muon_pt"):
        scan_arrays(spark, arrays, "Muon", columns=["Muon_id", "Muon_pt"]).count()
    save(tmp_path / "f5" / "Extra", Extra__sq=np.arange(4), Extra__n=np.arange(3))
    with pytest.raises(Exception, match="f5 are not row-aligned: 3 to 4 rows"):
        spark.read.format("column_arrays").option("groups", "Extra").load(f"{arrays}/f5").count()
