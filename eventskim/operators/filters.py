"""Selections: an identification predicate plus the kinematic window.

The kinematic window comes first and uses plain columns, so it reaches the
Parquet scan. The output has the flag columns of the selection that was made.
They are true on every row that passed, so they are constants there: computing
the predicate a second time would double the generated code.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    ELECTRON_AREA,
    PHOTON_AREAS,
    StepTable,
    bin_index,
    csv_max,
    csv_min,
    effective_area,
    electron_cut_flow,
    jet_id,
    muon_id,
    photon_id,
    ratio,
    tau_id,
    within,
)
from ..functions.identification import MUON_ISO_FRACTION, MUON_PILEUP_WEIGHT
from ..functions.lookup import check_table

# ---------------------------------------------------------------------------
# Lower pt bound and eta window of each collection.
# ---------------------------------------------------------------------------
KINEMATICS = {
    "Muon": (10, 2.4),
    "Tau": (10, 2.3),
    "Photon": (175, 1.4442),
    "Electron": (10, 2.5),
    "AK4Puppi": (30, 4.5),
    "CA15Puppi": (150, 2.5),
}
MET_THRESHOLD = 200


def _passing(df: DataFrame, *flags: str, where: Column) -> DataFrame:
    return df.filter(where).withColumns({f: F.lit(True) for f in flags})


def _kinematic(df: DataFrame, prefix: str) -> DataFrame:
    pt, eta = KINEMATICS[prefix]
    return df.filter((F.col(f"{prefix}_pt") >= F.lit(pt)) & within(F.col(f"{prefix}_eta"), eta))


def filter_muon(df: DataFrame, id_bit: int = 1) -> DataFrame:
    """Muon selection. ``id_bit`` is 1 for the loose and 2 for the tight one."""
    return _passing(_kinematic(df, "Muon"), "passfilter", where=muon_id(id_bit))


def filter_muon_udf(df: DataFrame, id_bit: int = 1) -> DataFrame:
    """:func:`filter_muon` with its predicate as an Arrow-batched Python function.

    Kept for comparing the two forms; :func:`filter_muon` is the one to use.
    """

    @F.pandas_udf("boolean")
    def passes(
        charged: pd.Series,
        neutral: pd.Series,
        gamma: pd.Series,
        pileup: pd.Series,
        known: pd.Series,
        bits: pd.Series,
        pt: pd.Series,
    ) -> pd.Series:
        corrected = (neutral + gamma - MUON_PILEUP_WEIGHT * pileup).clip(lower=0).where(known, 0.0)
        isolation = charged + corrected
        return ((bits & id_bit) != 0) & (isolation < MUON_ISO_FRACTION * pt)

    c = {n: F.col(f"Muon_{n}") for n in ("chHadIso", "neuHadIso", "gammaIso", "puIso", "pogIDBits", "pt")}
    # A NULL neutral part is floored at zero, and NULL bits pass nothing, as in the native form.
    known = c["neuHadIso"].isNotNull() & c["gammaIso"].isNotNull() & c["puIso"].isNotNull()
    where = passes(
        c["chHadIso"], c["neuHadIso"], c["gammaIso"], c["puIso"], known, F.coalesce(c["pogIDBits"], F.lit(0)), c["pt"]
    )
    return _passing(_kinematic(df, "Muon"), "passfilter", where=where)


def filter_tau(df: DataFrame) -> DataFrame:
    return _passing(_kinematic(df, "Tau"), "passfilter", where=tau_id())


def with_photon_areas(df: DataFrame) -> DataFrame:
    """Add ``rhoArea0..2``; needs ``rhoIso`` from the event table."""
    rho, eta = F.col("rhoIso"), F.col("Photon_scEta")
    return df.withColumns(
        {f"rhoArea{i}": effective_area(rho, eta, t) for i, t in enumerate(PHOTON_AREAS)}
    )


def filter_photon(df: DataFrame) -> DataFrame:
    """Photon selection on photons joined to their event.

    An unmatched photon has NULL areas; ``greatest`` then yields its floor, so
    such a photon passes the isolation cuts.
    """
    areas = tuple(F.col(f"rhoArea{i}") for i in range(3))
    return _passing(
        with_photon_areas(_kinematic(df, "Photon")), "passfilter", where=photon_id(areas)
    )


def filter_electron(
    df: DataFrame,
    veto_conversions: bool = False,
    subtract_pileup: bool = False,
    need_area: bool = False,
) -> DataFrame:
    """Electron selection on electrons joined to their event.

    The first two flags span the four known variants of the first selection: the
    conversion veto, and subtracting ``rhoEffarea`` from the neutral isolation. An
    electron without an event has no such area, which subtracts nothing; with
    ``need_area`` it fails, as it does where a function takes the area as a plain number.
    """
    area = effective_area(F.col("rhoIso"), F.col("Electron_eta"), ELECTRON_AREA)
    first, second = electron_cut_flow(
        pileup=F.col("rhoEffarea") if subtract_pileup else None,
        veto_conversions=veto_conversions,
    )
    measured = _kinematic(df, "Electron").withColumn("rhoEffarea", area)
    if need_area:
        first = F.col("rhoEffarea").isNotNull() & first
    return _passing(measured, "passfilter1", "passfilter2", where=first & second)


def _filter_jets(df: DataFrame, prefix: str) -> DataFrame:
    return _passing(_kinematic(df, prefix), "passfilter", where=jet_id(prefix))


def filter_jet(df: DataFrame) -> DataFrame:
    """Narrow-jet selection."""
    return _filter_jets(df, "AK4Puppi")


def filter_vjet(df: DataFrame) -> DataFrame:
    """Wide-jet selection."""
    return _filter_jets(df, "CA15Puppi")


def preselect_met(info: DataFrame, threshold: float = MET_THRESHOLD) -> DataFrame:
    """Events with high missing energy by either reconstruction."""
    return info.filter((F.col("pfMET") > threshold) | (F.col("puppET") > threshold))


def substructure(df: DataFrame) -> DataFrame:
    """Subjettiness ratios and b-tag extremes, in place of the columns they come from."""
    c = {n: F.col(f"AddCA15Puppi_{n}") for n in ("tau1", "tau2", "tau3")}
    sj = [f"AddCA15Puppi_sj{i}_csv" for i in range(1, 5)]
    return df.withColumns(
        {
            "tau21": ratio(c["tau1"], c["tau2"]),
            "tau32": ratio(c["tau2"], c["tau3"]),
            "mincsv": csv_min(F.col(sj[0]), F.col(sj[1])),
            "maxsubcsv": csv_max(*[F.col(s) for s in sj]),
        }
    ).drop(*[f"AddCA15Puppi_{n}" for n in c], *sj)


def step_lookup_join(df: DataFrame, on: str, table: StepTable, out: str) -> DataFrame:
    """Add the table's value at column ``on`` by joining a table of bins.

    The bin number turns the range condition into an equality, so this is a hash
    join. The bins are the literals of ``table``, some ten rows that no input can
    make more of, and are sent to every task: as a shuffle key they would be hot.
    """
    check_table(table)
    rows = ", ".join(f"({i}, DOUBLE('{float(v)!r}'))" for i, v in enumerate(table.values))
    bins = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS bins(_bin, `{out}`)")
    numbered = df.withColumn("_bin", bin_index(F.col(on), table.edges))
    return numbered.join(F.broadcast(bins), "_bin", "left").drop("_bin")
