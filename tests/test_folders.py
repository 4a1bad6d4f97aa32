"""Folders whose files differ in columns, types and names."""

import pytest
from pyspark.sql import types as T

from eventskim.sources import (
    copy_format,
    folder_columns,
    merge_groups,
    read_columns,
    read_dynamic,
    read_folder,
    sum_groups,
)
from eventskim.sources.folders import wider_type


def write(spark, path, rows, schema, files=1):
    spark.createDataFrame(rows, schema).coalesce(files).write.parquet(str(path))


@pytest.fixture
def unlike(spark, tmp_path):
    """Files (a, b), (a, b, c) and (z) in folders of their own; one name has a dot in one file."""
    write(spark, tmp_path / "G" / "k", [(1, 0.5)], "`G.a` int, b float")
    write(spark, tmp_path / "G" / "l" / "deep", [(2, 0.1, 7), (3, None, 8)], "G_a tinyint, B double, c bigint")
    write(spark, tmp_path / "G" / "m", [("x",)], "z string")
    return str(tmp_path / "G")


def test_a_folder_is_read_whole(spark, unlike):
    out = read_dynamic(spark, unlike)
    assert {f.name: f.dataType.simpleString() for f in out.schema} == {"G_a": "int", "b": "double", "c": "bigint", "z": "string"}
    rows = sorted((tuple(r[c] for c in ("G_a", "b", "c", "z")) for r in out.collect()), key=str)
    assert rows == sorted([(1, 0.5, None, None), (2, 0.1, 7, None), (3, None, 8, None), (None, None, None, "x")], key=str)


def test_a_file_without_a_wanted_column_is_named(spark, unlike):
    with pytest.raises(ValueError, match=r"missing datasets: \['G_a in .*/m/part"):
        read_columns(spark, unlike, ["G.a"])
    with pytest.raises(ValueError, match="missing datasets: .*'no'"):
        read_columns(spark, unlike, ["no"])
    with pytest.raises(ValueError, match="'null' or 'error'"):
        read_folder(spark, unlike, absent="drop")
    assert read_columns(spark, f"{unlike}/l", ["C", "g_A"]).columns == ["c", "G_a"]
    assert sorted(r.c for r in read_folder(spark, unlike, columns=["c"]).filter("c IS NOT NULL").collect()) == [7, 8]


def test_copies_and_merges_have_all_columns(spark, unlike, tmp_path):
    schema = copy_format(spark, unlike, str(tmp_path / "copy"))
    assert [(f.name, f.dataType.simpleString()) for f in schema] == [("G.a", "int"), ("z", "string"), ("b", "double"), ("c", "bigint")]
    merge_groups(spark, [unlike], str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 4


def test_sums_take_all_files(spark, unlike, tmp_path):
    with pytest.raises(ValueError, match="G has no files of its own"):
        sum_groups(spark, str(tmp_path))
    write(spark, tmp_path / "s" / "H" / "a=1", [(1,)], "x int")
    write(spark, tmp_path / "s" / "H" / "a=2", [(2.5, 3)], "x double, y bigint")
    sums = {r.dataset: r.total for r in sum_groups(spark, str(tmp_path / "s")).collect()}
    assert sums == {"x": 3.5, "y": 3.0}


def test_no_common_type_names_column_and_files(spark, tmp_path):
    write(spark, tmp_path / "a", [(2**60,)], "x bigint")
    write(spark, tmp_path / "b", [(0.5,)], "x float")
    with pytest.raises(ValueError, match="column x: .*no common type; see .*/a/part.* and .*/b/part"):
        read_dynamic(spark, str(tmp_path))


def test_two_datasets_of_one_column(spark, tmp_path):
    write(spark, tmp_path / "a", [(1, 2)], "`M.x` int, M_x int")
    with pytest.raises(ValueError, match="/a/part.* has two datasets"):
        read_dynamic(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no file with columns"):
        read_dynamic(spark, str(tmp_path / "a" / "_SUCCESS"))


@pytest.mark.parametrize(
    ("a", "b", "wide"),
    [("tinyint", "smallint", "smallint"), ("smallint", "float", "double"), ("int", "bigint", "bigint"), ("float", "double", "double")],
)
def test_widened_values(spark, tmp_path, a, b, wide):
    write(spark, tmp_path / "a", [(7,)] if "int" in a else [(0.5,)], f"x {a}")
    write(spark, tmp_path / "b", [(9,)] if "int" in b else [(0.25,)], f"x {b}")
    out = read_dynamic(spark, str(tmp_path))
    assert out.schema["x"].dataType.simpleString() == wide
    assert sorted(r.x for r in out.collect()) == sorted([7 if "int" in a else 0.5, 9 if "int" in b else 0.25])


def test_types_without_a_wider_one():
    assert wider_type(T.StringType(), T.StringType()) == T.StringType()
    with pytest.raises(ValueError, match="no common type"):
        wider_type(T.StringType(), T.IntegerType())


def test_files_of_other_writers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"n": pa.array([1], pa.int8()), "x": pa.array([0.5], pa.float32())}), tmp_path / "one.parquet")
    write(spark, tmp_path / "two", [(2**40, "t")], "n bigint, s string")
    found = {c.name: (c.type.simpleString(), bool(c.lacking)) for c in folder_columns(spark, str(tmp_path))}
    assert found == {"n": ("bigint", False), "x": ("float", True), "s": ("string", True)}
    assert sorted(r.n for r in read_dynamic(spark, str(tmp_path)).collect()) == [1, 2**40]
