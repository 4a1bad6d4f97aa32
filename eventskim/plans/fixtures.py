"""Stand-in groups over the star-schema tables: an order is an event, a line item a particle.

The same text is the Spark view and the oracle's, over whole tables. A tenth of the
Info rows have an event number that no particle has, so that left joins meet some
without a match; the jets of every event are its lines, narrow and wide ones alike. Event numbers stay 64-bit, as
order keys outgrow 32 bits on large inputs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stamp_rows
from ..schema import group_schema
from ..session import ship_package


def _key(prefix: str, order: str, lumi: str = "lumisec", event: str | None = None) -> str:
    return f"""
  CAST({order} % 3 + 1 AS INT) AS {prefix}runNum,
  CAST({order} % 50 AS INT) AS {prefix}{lumi},
  {event or order} AS {prefix}evtNum"""


def _object_key(group: str, lumi: str = "lumisec") -> str:
    return _key(f"{group}_", "l_orderkey", lumi)


def _direction(group: str, eta: str = "l_partkey * 7 + l_linenumber * 11", phi: str = "l_suppkey * 17 + l_linenumber * 101") -> str:
    return f"""
  CAST(({eta}) % 61 - 30 AS DOUBLE) / 10 AS {group}_eta,
  l_extendedprice / 400 AS {group}_pt,
  CAST(({phi}) % 629 - 314 AS DOUBLE) / 100 AS {group}_phi"""


def _jet(group: str, **direction: str) -> str:
    return f"""{_object_key(group)},{_direction(group, **direction)},
  CAST((l_partkey + l_suppkey) % 10 AS DOUBLE) / 10 AS {group}_chHadFrac,
  CAST(l_linenumber % 5 AS DOUBLE) / 4 AS {group}_chEmFrac,
  CAST(l_partkey % 50 AS DOUBLE) / 45 AS {group}_neuHadFrac,
  CAST(l_suppkey % 50 AS DOUBLE) / 45 AS {group}_neuEmFrac,
  l_quantity / 2 AS {group}_mass,
  CAST((l_partkey * 11) % 100 AS DOUBLE) / 100 AS {group}_csv,
  CAST(l_quantity AS INT) AS {group}_nParticles,
  CAST(l_partkey % 6 AS INT) AS {group}_nCharged"""


# group -> (columns, table, condition)
VIEWS: dict[str, tuple[str, str, str]] = {
    "Info": (
        f"""{_key("", "o_orderkey", "lumiSec", "CASE WHEN o_orderkey % 10 = 9 THEN -o_orderkey - 1 ELSE o_orderkey END")},
  CAST((o_orderkey * 7) % 400 AS DOUBLE) / 10 AS rhoIso,
  CAST(o_custkey % 8 AS INT) AS metFilterFailBits,
  o_totalprice / 1000 AS pfMET,
  CAST((o_custkey * 13) % 629 - 314 AS DOUBLE) / 100 AS pfMETphi,
  o_totalprice / 1200 AS puppET,
  CAST((o_orderkey * 37) % 629 - 314 AS DOUBLE) / 100 AS puppETphi""",
        "orders",
        "",
    ),
    "GenEvtInfo": (
        f"""{_key("", "o_orderkey", "lumiSec")},
  CAST(o_orderkey % 9 - 1 AS DOUBLE) / 2 AS weight,
  o_totalprice / 100 AS scalePDF""",
        "orders",
        "",
    ),
    "Muon": (
        f"""{_direction("Muon")},{_object_key("Muon")},
  l_quantity / 4 AS Muon_chHadIso,
  l_tax * 100 AS Muon_neuHadIso,
  CAST(l_linenumber AS DOUBLE) * 2 AS Muon_puIso,
  CAST(l_partkey % 4 AS INT) AS Muon_pogIDBits,
  l_discount * 100 AS Muon_gammaIso""",
        "lineitem",
        "",
    ),
    "Tau": (
        f"""{_direction("Tau")},{_object_key("Tau")},
  (l_partkey % 8) * 32768 AS Tau_hpsDisc,
  l_quantity / 5 AS Tau_rawIso3Hits""",
        "lineitem",
        "",
    ),
    "Photon": (
        f"""{_object_key("Photon")},{_direction("Photon")},
  l_quantity / 4 AS Photon_chHadIso,
  CAST((l_partkey * 3 + l_suppkey) % 61 - 30 AS DOUBLE) / 10 AS Photon_scEta,
  l_tax * 200 + 5 AS Photon_neuHadIso,
  l_discount * 100 + l_linenumber AS Photon_gammaIso,
  CAST(l_partkey % 40 + 5 AS DOUBLE) / 1000 AS Photon_sieie,
  CAST(l_suppkey % 60 AS DOUBLE) / 100 AS Photon_sthovere""",
        "lineitem",
        "",
    ),
    "Electron": (
        f"""{_object_key("Electron")},{_direction("Electron")},
  l_quantity / 4 AS Electron_chHadIso,
  l_tax * 100 AS Electron_neuHadIso,
  l_discount * 100 AS Electron_gammaIso,
  CAST((l_partkey * 3 + l_suppkey) % 61 - 30 AS DOUBLE) / 10 AS Electron_scEta,
  CAST(l_partkey % 40 AS DOUBLE) / 1000 AS Electron_sieie,
  CAST(l_suppkey % 60 AS DOUBLE) / 100 AS Electron_hovere,
  CAST(l_partkey % 30 AS DOUBLE) / 10 AS Electron_eoverp,
  CAST((l_partkey + l_suppkey) % 41 - 20 AS DOUBLE) / 500 AS Electron_dEtaIn,
  CAST((l_partkey * 5 + l_linenumber) % 101 - 50 AS DOUBLE) / 50 AS Electron_dPhiIn,
  l_quantity / 10 AS Electron_ecalEnergy,
  CAST((l_suppkey * 3 + l_linenumber) % 61 - 30 AS DOUBLE) / 20 AS Electron_d0,
  CAST((l_partkey + l_linenumber * 7) % 61 - 30 AS DOUBLE) / 10 AS Electron_dz,
  l_linenumber AS Electron_nMissingHits,
  CAST(CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS TINYINT) AS Electron_isConv""",
        "lineitem",
        "",
    ),
    # Narrow jets point elsewhere than the wide jet of the same line.
    "AK4Puppi": (
        _jet("AK4Puppi", eta="l_suppkey * 13 + l_linenumber * 7", phi="l_partkey * 23 + l_linenumber * 151"),
        "lineitem",
        "",
    ),
    "CA15Puppi": (_jet("CA15Puppi"), "lineitem", ""),
    "AddCA15Puppi": (
        f"""{_object_key("AddCA15Puppi", "lumiSec")},
  CAST(l_partkey % 20 AS DOUBLE) / 20 AS AddCA15Puppi_tau1,
  CAST(l_suppkey % 10 AS DOUBLE) / 10 AS AddCA15Puppi_tau2,
  CAST(l_linenumber % 3 AS DOUBLE) / 3 AS AddCA15Puppi_tau3,
  l_quantity * 3 AS AddCA15Puppi_mass_sd0,
  CAST(l_partkey % 97 AS DOUBLE) / 97 AS AddCA15Puppi_sj1_csv,
  CAST(l_suppkey % 89 AS DOUBLE) / 89 AS AddCA15Puppi_sj2_csv,
  CAST((l_partkey + l_suppkey) % 83 AS DOUBLE) / 83 AS AddCA15Puppi_sj3_csv,
  CAST((l_partkey * 3 + l_suppkey) % 79 AS DOUBLE) / 79 AS AddCA15Puppi_sj4_csv""",
        "lineitem",
        "",
    ),
}


def view_sql(group: str, table: str | None = None, extra: str = "") -> str:
    columns, source, condition = VIEWS[group]
    where = f"\nWHERE {condition}" if condition else ""
    return f"SELECT {columns}{extra}\nFROM {table or source}{where}"


# The columns the stand-ins use. With these given, no file is opened to plan.
TABLE_COLUMNS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE",
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE"
    ),
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(TABLE_COLUMNS[table]).parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, group: str, stamped: bool = False) -> DataFrame:
    """The stand-in of ``group``; ``stamped`` adds the row ids of the scan."""
    source = load(spark, sf_dir, VIEWS[group][1])
    if stamped:
        source = stamp_rows(source, f"{sf_dir}/{VIEWS[group][1]}.parquet")
    extra = ",\n  _file, _row" if stamped else ""
    return spark.sql(view_sql(group, "{source}", extra), source=source)


def stored(spark: SparkSession, sf_dir: str, group: str) -> DataFrame:
    """The stand-in as it would be stored: dataset names, and the catalogue's types.

    Event numbers keep their 64 bits. See :func:`stored_sql` for the same in SQL.
    """
    found = view(spark, sf_dir, group)
    columns = [
        F.col(f.name).cast("long" if f.name.endswith("evtNum") else f.dataType).alias(dataset_name(group, f.name))
        for f in group_schema(group)
    ]
    return found.select(*columns)


def dataset_name(group: str, column: str) -> str:
    """``Muon_eta`` is stored as ``Muon.eta``; the event key of GenEvtInfo is prefixed as well."""
    if column.startswith(f"{group}_"):
        return f"{group}.{column.removeprefix(f'{group}_')}"
    if group == "GenEvtInfo" and column.endswith(("Num", "Sec")):
        return f"{group}.{column.replace('lumiSec', 'lumisec')}"
    return column


_SQL_TYPES = {"float": "REAL", "int": "INTEGER", "bigint": "BIGINT", "tinyint": "TINYINT"}


def stored_sql(group: str) -> str:
    columns = ", ".join(
        f"CAST({f.name} AS {'BIGINT' if f.name.endswith('evtNum') else _SQL_TYPES[f.dataType.simpleString()]}) AS {f.name}"
        for f in group_schema(group)
    )
    return f"SELECT {columns} FROM ({view_sql(group)}) stand_in"


def _save(groups: dict[str, str], path: str, rows_per_file: int):
    """Writes column arrays, in the order of ``groups``; a retried task writes the same files again."""

    def save(table: pa.Table, name: str) -> None:
        for column, values in zip(groups, table.columns):
            if values.null_count:
                raise ValueError(f"column {column} has NULLs; an array cannot hold them")
            folder = f"{path}/{name}/{groups[column]}"
            filesystem.create_dir(folder, recursive=True)
            hidden = f"{folder}/.{uuid.uuid4().hex}"
            with filesystem.open_output_stream(hidden) as out:
                np.lib.format.write_array(out, values.to_numpy(), allow_pickle=False)
            filesystem.move(hidden, f"{folder}/{column}.npy")

    if "://" in path:
        filesystem, path = fs.FileSystem.from_uri(path)
    else:
        filesystem, path = fs.LocalFileSystem(), path.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, rows, saved = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, rows_per_file - rows)
                batch = batch.slice(taken.num_rows)
                waiting.append(taken)
                rows += taken.num_rows
                if rows == rows_per_file:
                    save(pa.Table.from_batches(waiting), f"part-{part:05d}-{saved}")
                    waiting, rows, saved = [], 0, saved + 1
        if rows:
            save(pa.Table.from_batches(waiting), f"part-{part:05d}-{saved}")
        yield pa.RecordBatch.from_pydict({"files": pa.array([saved + bool(rows)], pa.int64())})

    return run


def write_arrays(df: DataFrame, path: str, *groups: str, rows_per_file: int = 1 << 20) -> int:
    """Store a stand-in as column arrays, columns by the group their names begin with; number of files."""
    ship_package(df.sparkSession)
    if len(groups) == 1:
        of = dict.fromkeys(df.columns, groups[0])
    else:
        of = {c: g for c in df.columns for g in groups if c.startswith((f"{g}_", f"{g}."))}
    lost = [c for c in df.columns if c not in of]
    if lost:
        raise ValueError(f"columns of no group: {lost}")
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.mapInArrow(_save(of, path, rows_per_file), "files long").agg(F.sum("files")).first()[0]
