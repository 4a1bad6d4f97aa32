"""Analyses as SQL over named views, with the cuts as functions of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.in_sql import register_functions
from .pipelines import MUON_MASS

_SHAPE = ", ".join(f"Electron_{c}" for c in "pt scEta chHadIso gammaIso neuHadIso dEtaIn dPhiIn sieie".split())
_TRACK = ", ".join(f"Electron_{c}" for c in "scEta hovere eoverp ecalEnergy d0 dz nMissingHits".split())

#: Leading electron of each event, with the pile-up of its event subtracted.
LEADING_ELECTRONS = f"""
SELECT Electron_runNum, Electron_lumisec, Electron_evtNum, top.*
FROM (
  SELECT Electron_runNum, Electron_lumisec, Electron_evtNum,
    max(struct(Electron_pt, Electron_eta, Electron_phi)) AS top
  FROM Electron LEFT JOIN Info
    ON Electron_evtNum <=> evtNum AND Electron_lumisec <=> lumiSec AND Electron_runNum <=> runNum
  WHERE Electron_pt >= 10 AND Electron_eta > -2.5D AND Electron_eta < 2.5D
    AND electron_shape_pileup({_SHAPE}, electron_area(rhoIso, Electron_eta)) AND electron_track({_TRACK})
  GROUP BY Electron_evtNum, Electron_lumisec, Electron_runNum)"""

#: Leading muon of each event.
LEADING_MUONS = f"""
SELECT Muon_runNum, Muon_lumisec, Muon_evtNum, top.*, {MUON_MASS}D AS Muon_Mass
FROM (
  SELECT Muon_runNum, Muon_lumisec, Muon_evtNum, max(struct(Muon_pt, Muon_eta, Muon_phi)) AS top
  FROM Muon
  WHERE Muon_pt >= 10 AND Muon_eta > -2.4D AND Muon_eta < 2.4D
    AND muon_id(Muon_pt, Muon_chHadIso, Muon_neuHadIso, Muon_gammaIso, Muon_puIso, Muon_pogIDBits)
  GROUP BY Muon_evtNum, Muon_lumisec, Muon_runNum)"""

#: Narrow jets that meet a condition of the jet cut.
SELECTED_JETS = """
SELECT * FROM AK4Puppi
WHERE AK4Puppi_pt >= 30 AND AK4Puppi_eta > -4.5D AND AK4Puppi_eta < 4.5D
  AND ak4puppi_id(AK4Puppi_eta, AK4Puppi_chHadFrac, AK4Puppi_chEmFrac, AK4Puppi_neuHadFrac, AK4Puppi_neuEmFrac,
    AK4Puppi_nParticles, AK4Puppi_nCharged)"""


def run_sql(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """The rows of ``text``; each of ``views`` is made known under its name, and the cuts are."""
    register_functions(spark)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)
