"""Compare a Spark result with the SQL oracle's, as sorted rows of sorted columns."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = ("orders", "lineitem")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return (0, 0)
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, float) and math.isnan(v):
        return (3, 0)
    return (2, v) if isinstance(v, str) else (1, v)


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def assert_same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    types = {c: str(t) for c, t in zip(want.columns, want.types)}
    spark = {f.name: f.dataType.simpleString() for f in df.schema}
    named = {
        "BIGINT": "bigint",
        "INTEGER": "int",
        "TINYINT": "tinyint",
        "DOUBLE": "double",
        "FLOAT": "float",
        "SMALLINT": "smallint",
        "VARCHAR": "string",
        "BOOLEAN": "boolean",
    }
    assert {c: named.get(t, t) for c, t in types.items()} == spark
    got, wanted = _rows(df.columns, df.collect()), _rows(want.columns, want.fetchall())
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted):
        assert a == b
    return len(got)
