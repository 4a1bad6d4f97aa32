"""Particle-identification predicates as boolean columns.

Each builder takes the column prefix of the collection. The cuts are
disjunctions, and the jet one selects rows that *meet* a listed condition; both
are part of the results to match.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Identification thresholds.
# ---------------------------------------------------------------------------
MUON_ISO_FRACTION = 0.12
MUON_PILEUP_WEIGHT = 0.5

TAU_DECAY_MODE_BIT = 65536
TAU_MAX_RAW_ISO = 5

REGION_EDGE = 1.479  # barrel inside, endcap outside

PHOTON_MAX_HOVERE = 0.05

JET_MAX_FRACTION = 0.99
JET_TRACKER_ETA = 2.4


class PhotonRegion(NamedTuple):
    sieie: float
    charged: float
    neutral_base: float
    neutral_slope: float
    neutral_scale: float
    gamma_base: float
    gamma_slope: float


PHOTON_BARREL = PhotonRegion(0.0103, 2.44, 2.57, 0.0044, 0.5809, 1.92, 0.0043)
PHOTON_ENDCAP = PhotonRegion(0.0277, 1.84, 4.00, 0.0040, 0.9402, 2.15, 0.0041)


class ElectronRegion(NamedTuple):
    iso_fraction: float
    d_eta: float
    d_phi: float
    sieie: float
    hovere: float
    e_over_p: float
    d0: float
    dz: float
    missing_hits: int


ELECTRON_BARREL = ElectronRegion(
    0.126, 0.01520, 0.21600, 0.01140, 0.18100, 0.20700, 0.05640, 0.47200, 2
)
ELECTRON_ENDCAP = ElectronRegion(
    0.144, 0.01130, 0.23700, 0.03520, 0.11600, 0.17400, 0.22200, 0.92100, 3
)


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def _limits(inside: Column, barrel: tuple, endcap: tuple) -> list[Column]:
    """Each threshold as a column: the barrel's where ``inside``, else the endcap's.

    Cuts then appear once with a varying limit, rather than once per region,
    which keeps the generated code small enough for the JVM to compile.
    """
    return [F.when(inside, F.lit(b)).otherwise(F.lit(e)) for b, e in zip(barrel, endcap)]


def _getter(prefix: str):
    return lambda name: F.col(f"{prefix}_{name}")


def within(x: Column, limit: float) -> Column:
    """``-limit < x < limit``, written so that both bounds reach the scan."""
    return (x > F.lit(-limit)) & (x < F.lit(limit))


def muon_id(id_bit: int = 1, prefix: str = "Muon") -> Column:
    """Identification bit set, and pile-up corrected isolation below 12 % of pt."""
    c = _getter(prefix)
    neutral = c("neuHadIso") + c("gammaIso") - F.lit(MUON_PILEUP_WEIGHT) * c("puIso")
    isolation = c("chHadIso") + F.greatest(neutral, F.lit(0.0))
    return (c("pogIDBits").bitwiseAND(F.lit(id_bit)) != 0) & (
        isolation < F.lit(MUON_ISO_FRACTION) * c("pt")
    )


def tau_id(prefix: str = "Tau") -> Column:
    """Decay-mode bit set and raw isolation at most 5."""
    c = _getter(prefix)
    bit = F.lit(TAU_DECAY_MODE_BIT)
    return (c("hpsDisc").bitwiseAND(bit) == bit) & (c("rawIso3Hits") <= F.lit(TAU_MAX_RAW_ISO))


def photon_id(
    areas: tuple[Column, Column, Column], prefix: str = "Photon"
) -> Column:
    """Low hadronic leakage passes at once; else any of four cuts of the region.

    ``areas`` are the pile-up energies for charged, neutral and photon isolation.
    """
    c = _getter(prefix)
    charged, neutral, gamma = (
        F.greatest(c(name) - area, F.lit(0.0))
        for name, area in zip(("chHadIso", "neuHadIso", "gammaIso"), areas)
    )

    distance = F.abs(c("scEta"))
    r = PhotonRegion(*_limits(distance <= F.lit(REGION_EDGE), PHOTON_BARREL, PHOTON_ENDCAP))
    cuts = _any(
        [
            c("sieie") <= r.sieie,
            charged <= r.charged,
            neutral <= r.neutral_base + F.exp(r.neutral_slope * c("pt") * r.neutral_scale),
            gamma <= r.gamma_base + r.gamma_slope * c("pt"),
        ]
    )
    return F.when(c("sthovere") <= F.lit(PHOTON_MAX_HOVERE), F.lit(True)).otherwise(
        c("scEta").isNotNull() & cuts
    )


def electron_isolation(prefix: str = "Electron", pileup: Column | None = None) -> Column:
    """Charged isolation plus the neutral part, floored at zero.

    ``pileup`` is subtracted from the neutral part when given.
    """
    c = _getter(prefix)
    neutral = c("gammaIso") + c("neuHadIso")
    if pileup is not None:
        neutral = neutral - pileup
    return c("chHadIso") + F.greatest(F.lit(0.0), neutral.cast("double"))


def electron_cut_flow(
    prefix: str = "Electron", pileup: Column | None = None, veto_conversions: bool = False
) -> tuple[Column, Column]:
    """The two electron selections: (shower shape and isolation, track quality)."""
    c = _getter(prefix)
    inside = F.abs(c("scEta")) < F.lit(REGION_EDGE)
    r = ElectronRegion(*_limits(inside, ELECTRON_BARREL, ELECTRON_ENDCAP))
    placed = c("scEta").isNotNull()
    shape = placed & _any(
        [
            electron_isolation(prefix, pileup) < r.iso_fraction * c("pt"),
            F.abs(c("dEtaIn")) < r.d_eta,
            F.abs(c("dPhiIn")) < r.d_phi,
            c("sieie") < r.sieie,
        ]
    )
    track = placed & _any(
        [
            c("hovere") < r.hovere,
            F.abs(F.lit(1.0) - c("eoverp")) < r.e_over_p * c("ecalEnergy"),
            F.abs(c("d0")) < r.d0,
            F.abs(c("dz")) < r.dz,
            c("nMissingHits") <= r.missing_hits,
        ]
    )
    if veto_conversions:
        shape = F.when(c("isConv") == 1, F.lit(False)).otherwise(shape)
    return shape, track


def jet_id(prefix: str) -> Column:
    """Neutral-dominated, near-empty, or odd in charged content inside the tracker."""
    c = _getter(prefix)
    limit = F.lit(JET_MAX_FRACTION)
    charged = _any([c("chHadFrac") == 0, c("nCharged") == 0, c("chEmFrac") >= limit])
    return _any(
        [
            c("neuHadFrac") >= limit,
            c("neuEmFrac") >= limit,
            c("nParticles") <= 1,
            within(c("eta"), JET_TRACKER_ETA) & charged,
        ]
    )
