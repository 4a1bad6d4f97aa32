"""Two row-aligned groups of Parquet files, read side by side."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from eventskim.sources import read_paired


def write(path, n, row_group, start=0, **more):
    path.parent.mkdir(parents=True, exist_ok=True)
    table = pa.table({name: [f(i) for i in range(start, start + n)] for name, f in more.items()})
    pq.write_table(table, path, row_group_size=row_group)


@pytest.fixture
def root(tmp_path):
    """Files whose row groups are cut differently in the two groups; one has a writer's tag."""
    tags = ("-0a1b2c3d-0000-1111-2222-0123456789ab", "-ffffffff-9999-8888-7777-abcdefabcdef")
    for group, size, tag in (("A", 100, tags[0]), ("B", 37, tags[1])):
        f = (lambda i: i) if group == "A" else (lambda i: float(i * i))
        write(tmp_path / group / f"part-00000{tag}-c000.parquet", 1000, size, **{f"{group}.x": f})
        write(tmp_path / group / "sub" / "plain.parquet", 77, size, 1000, **{f"{group}_x": f, f"{group}_y": lambda i: i % 5})
        write(tmp_path / group / "empty.parquet", 0, size, **{f"{group}_x": f})
    return tmp_path


@pytest.mark.parametrize("slice_bytes", [1, 3000, 1 << 27])
def test_rows_stay_beside_each_other(spark, root, slice_bytes, monkeypatch):
    df = read_paired(spark, str(root), "A", "/B/", slice_bytes=slice_bytes)
    assert df.columns == ["A_x", "A_y", "B_x", "B_y"]
    rows = sorted(df.collect(), key=lambda r: r.A_x)
    assert [(r.A_x, r.B_x) for r in rows] == [(i, float(i * i)) for i in range(1077)]
    assert [r.A_y for r in rows[1000:]] == [r.B_y for r in rows[1000:]] == [i % 5 for i in range(1000, 1077)]
    assert {r.A_y for r in rows[:1000]} == {None}
    if slice_bytes == 1:
        assert df.rdd.getNumPartitions() == 11
    slim = read_paired(spark, str(root), "A", "B", columns=["B.x", "A_x"], slice_bytes=slice_bytes)
    assert slim.columns == ["A_x", "B_x"] and slim.count() == 1077


def test_batches_smaller_than_slices(spark, tmp_path):
    """More rows than a batch, whose batches end at different rows on the two sides."""
    n = (1 << 17) * 2 + 5
    write(tmp_path / "A" / "f.parquet", n, 50_000, a=lambda i: i)
    write(tmp_path / "B" / "f.parquet", n, 90_001, b=lambda i: i)
    df = read_paired(spark, str(tmp_path), "A", "B")
    assert df.count() == n and df.filter("a <> b").count() == 0


def test_files_that_do_not_pair(spark, root):
    with pytest.raises(ValueError, match="missing datasets: .*no"):
        read_paired(spark, str(root), "A", "B", columns=["no"])
    write(root / "B" / "more.parquet", 3, 2, B_x=float)
    with pytest.raises(ValueError, match="not row-aligned: .*more.parquet', None, 3"):
        read_paired(spark, str(root), "A", "B")
    write(root / "A" / "more.parquet", 4, 2, A_x=int)
    with pytest.raises(ValueError, match="not row-aligned: .*more.parquet', 4, 3"):
        read_paired(spark, str(root), "A", "B")
    with pytest.raises(ValueError, match="columns of both"):
        read_paired(spark, str(root), "A", "A")
