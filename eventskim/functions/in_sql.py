"""The cuts as SQL functions of a session, for analyses written as SQL over named views.

A function's body is the SQL of the column that the operators use, so both forms have
the same plan. Its parameters are the collection's columns in the order given here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .identification import electron_cut_flow, jet_id, muon_id, photon_id, tau_id
from .kinematics import delta_phi_or, delta_r, forward_delta_phi_or
from .lookup import ELECTRON_AREA, effective_area


@dataclass(frozen=True)
class SqlFunction:
    name: str
    #: Names and types of the parameters, as in a table's definition.
    parameters: str
    returns: str
    column: Callable[[], Column]


def _doubles(prefix: str, *names: str) -> str:
    return ", ".join(f"{prefix}_{n} DOUBLE" for n in names)


_SHAPE = _doubles("Electron", "pt", "scEta", "chHadIso", "gammaIso", "neuHadIso", "dEtaIn", "dPhiIn", "sieie")
_TRACK = _doubles("Electron", "scEta", "hovere", "eoverp", "ecalEnergy", "d0", "dz") + ", Electron_nMissingHits INT"



def _jet(prefix: str) -> SqlFunction:
    fractions = _doubles(prefix, "eta", "chHadFrac", "chEmFrac", "neuHadFrac", "neuEmFrac")
    counts = f"{prefix}_nParticles INT, {prefix}_nCharged INT"
    return SqlFunction(f"{prefix.lower()}_id", f"{fractions}, {counts}", "BOOLEAN", lambda: jet_id(prefix))


FUNCTIONS = (
    SqlFunction(
        "muon_id",
        _doubles("Muon", "pt", "chHadIso", "neuHadIso", "gammaIso", "puIso") + ", Muon_pogIDBits INT",
        "BOOLEAN",
        muon_id,
    ),
    SqlFunction("tau_id", "Tau_hpsDisc BIGINT, Tau_rawIso3Hits DOUBLE", "BOOLEAN", tau_id),
    SqlFunction(
        "photon_id",
        _doubles("Photon", "pt", "scEta", "sieie", "sthovere", "chHadIso", "neuHadIso", "gammaIso")
        + ", rhoArea0 DOUBLE, rhoArea1 DOUBLE, rhoArea2 DOUBLE",
        "BOOLEAN",
        lambda: photon_id(tuple(F.col(f"rhoArea{i}") for i in range(3))),
    ),
    SqlFunction(
        "electron_area",
        "rho DOUBLE, eta DOUBLE",
        "DOUBLE",
        lambda: effective_area(F.col("rho"), F.col("eta"), ELECTRON_AREA),
    ),
    SqlFunction("electron_shape", _SHAPE, "BOOLEAN", lambda: electron_cut_flow()[0]),
    SqlFunction(
        "electron_shape_pileup", f"{_SHAPE}, pileup DOUBLE", "BOOLEAN", lambda: electron_cut_flow(pileup=F.col("pileup"))[0]
    ),
    SqlFunction("electron_track", _TRACK, "BOOLEAN", lambda: electron_cut_flow()[1]),
    _jet("AK4Puppi"),
    _jet("CA15Puppi"),
    SqlFunction(
        "delta_r",
        "eta1 DOUBLE, phi1 DOUBLE, eta2 DOUBLE, phi2 DOUBLE",
        "DOUBLE",
        lambda: delta_r(F.col("eta1"), F.col("phi1"), F.col("eta2"), F.col("phi2")),
    ),
    SqlFunction("delta_phi_or", "met DOUBLE, phi DOUBLE", "DOUBLE", lambda: delta_phi_or(F.col("met"), F.col("phi"))),
    SqlFunction(
        "forward_delta_phi_or", "met DOUBLE, phi DOUBLE", "DOUBLE", lambda: forward_delta_phi_or(F.col("met"), F.col("phi"))
    ),
)


def sql_of(spark: SparkSession, column: Column, parameters: str) -> str:
    """SQL text of ``column`` over columns of the names and types in ``parameters``."""
    over = spark.createDataFrame([], parameters).select(column.alias("value"))
    [named] = [e for e in _expressions(over)]
    return named.child().sql()


def _expressions(df) -> list:
    found = df._jdf.queryExecution().analyzed().expressions()
    return [found.apply(i) for i in range(found.size())]


def register_functions(spark: SparkSession) -> list[str]:
    """Define :data:`FUNCTIONS` in the session, in place of any of the same names; the names."""
    for f in FUNCTIONS:
        body = sql_of(spark, f.column(), f.parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f.name}({f.parameters}) RETURNS {f.returns} RETURN {body}")
    return [f.name for f in FUNCTIONS]
