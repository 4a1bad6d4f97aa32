"""Schema catalogue and naming rules for the event groups.

A *group* is one table. Event groups hold one row per event, object groups hold
any number of rows per event. An event is named by the triple (run, lumi
section, event number), and each group carries that triple under its own column
names.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import types as T

# The nine groups, and the column and type of each field, in order.
GROUP_FIELDS: dict[str, tuple[tuple[str, str], ...]] = {
    "Muon": (
        ("Muon_eta", "float"),
        ("Muon_pt", "float"),
        ("Muon_phi", "float"),
        ("Muon_evtNum", "int"),
        ("Muon_runNum", "int"),
        ("Muon_lumisec", "int"),
        ("Muon_chHadIso", "float"),
        ("Muon_neuHadIso", "float"),
        ("Muon_puIso", "float"),
        ("Muon_pogIDBits", "int"),
        ("Muon_gammaIso", "float"),
    ),
    "Tau": (
        ("Tau_eta", "float"),
        ("Tau_pt", "float"),
        ("Tau_phi", "float"),
        ("Tau_evtNum", "int"),
        ("Tau_runNum", "int"),
        ("Tau_lumisec", "int"),
        ("Tau_hpsDisc", "long"),
        ("Tau_rawIso3Hits", "float"),
    ),
    "Photon": (
        ("Photon_runNum", "int"),
        ("Photon_lumisec", "int"),
        ("Photon_evtNum", "int"),
        ("Photon_eta", "float"),
        ("Photon_pt", "float"),
        ("Photon_phi", "float"),
        ("Photon_chHadIso", "float"),
        ("Photon_scEta", "float"),
        ("Photon_neuHadIso", "float"),
        ("Photon_gammaIso", "float"),
        ("Photon_sieie", "float"),
        ("Photon_sthovere", "float"),
    ),
    "Electron": (
        ("Electron_runNum", "int"),
        ("Electron_lumisec", "int"),
        ("Electron_evtNum", "int"),
        ("Electron_eta", "float"),
        ("Electron_pt", "float"),
        ("Electron_phi", "float"),
        ("Electron_chHadIso", "float"),
        ("Electron_neuHadIso", "float"),
        ("Electron_gammaIso", "float"),
        ("Electron_scEta", "float"),
        ("Electron_sieie", "float"),
        ("Electron_hovere", "float"),
        ("Electron_eoverp", "float"),
        ("Electron_dEtaIn", "float"),
        ("Electron_dPhiIn", "float"),
        ("Electron_ecalEnergy", "float"),
        ("Electron_d0", "float"),
        ("Electron_dz", "float"),
        ("Electron_nMissingHits", "int"),
        ("Electron_isConv", "byte"),
    ),
    "AK4Puppi": (
        ("AK4Puppi_runNum", "int"),
        ("AK4Puppi_lumisec", "int"),
        ("AK4Puppi_evtNum", "int"),
        ("AK4Puppi_eta", "float"),
        ("AK4Puppi_pt", "float"),
        ("AK4Puppi_phi", "float"),
        ("AK4Puppi_chHadFrac", "float"),
        ("AK4Puppi_chEmFrac", "float"),
        ("AK4Puppi_neuHadFrac", "float"),
        ("AK4Puppi_neuEmFrac", "float"),
        ("AK4Puppi_mass", "float"),
        ("AK4Puppi_csv", "float"),
        ("AK4Puppi_nParticles", "int"),
        ("AK4Puppi_nCharged", "int"),
    ),
    "CA15Puppi": (
        ("CA15Puppi_runNum", "int"),
        ("CA15Puppi_lumisec", "int"),
        ("CA15Puppi_evtNum", "int"),
        ("CA15Puppi_eta", "float"),
        ("CA15Puppi_pt", "float"),
        ("CA15Puppi_phi", "float"),
        ("CA15Puppi_chHadFrac", "float"),
        ("CA15Puppi_chEmFrac", "float"),
        ("CA15Puppi_neuHadFrac", "float"),
        ("CA15Puppi_neuEmFrac", "float"),
        ("CA15Puppi_mass", "float"),
        ("CA15Puppi_csv", "float"),
        ("CA15Puppi_nParticles", "int"),
        ("CA15Puppi_nCharged", "int"),
    ),
    "AddCA15Puppi": (
        ("AddCA15Puppi_runNum", "int"),
        ("AddCA15Puppi_lumiSec", "int"),
        ("AddCA15Puppi_evtNum", "int"),
        ("AddCA15Puppi_tau1", "float"),
        ("AddCA15Puppi_tau2", "float"),
        ("AddCA15Puppi_tau3", "float"),
        ("AddCA15Puppi_mass_sd0", "float"),
        ("AddCA15Puppi_sj1_csv", "float"),
        ("AddCA15Puppi_sj2_csv", "float"),
        ("AddCA15Puppi_sj3_csv", "float"),
        ("AddCA15Puppi_sj4_csv", "float"),
    ),
    "Info": (
        ("runNum", "int"),
        ("lumiSec", "int"),
        ("evtNum", "int"),
        ("rhoIso", "float"),
        ("metFilterFailBits", "int"),
        ("pfMET", "float"),
        ("pfMETphi", "float"),
        ("puppET", "float"),
        ("puppETphi", "float"),
    ),
    "GenEvtInfo": (
        ("runNum", "int"),
        ("lumiSec", "int"),
        ("evtNum", "int"),
        ("weight", "float"),
        ("scalePDF", "float"),
    ),
}

# Groups with one row per event; their columns carry no group prefix.
EVENT_GROUPS = ("Info", "GenEvtInfo")

_TYPES: dict[str, T.DataType] = {
    "float": T.FloatType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "byte": T.ByteType(),
}


def column_name(dataset: str) -> str:
    """Column name of a dataset: ``Muon.eta`` becomes ``Muon_eta``."""
    return dataset.replace(".", "_")


def column_names(datasets: Iterable[str]) -> list[str]:
    return [column_name(d) for d in datasets]


def _prefix(group: str) -> str:
    return "" if group in EVENT_GROUPS else group + "_"


def group_schema(group: str) -> T.StructType:
    """Catalogue schema of ``group``; surrounding slashes are accepted."""
    group = group.strip("/")
    if group not in GROUP_FIELDS:
        raise KeyError(f"unknown group {group!r}; known: {sorted(GROUP_FIELDS)}")
    return T.StructType([T.StructField(n, _TYPES[t], False) for n, t in GROUP_FIELDS[group]])


def event_key(group: str) -> tuple[str, str, str]:
    """The (run, lumi section, event) column names of ``group``."""
    by_lower = {n.lower(): n for n in group_schema(group).names}
    p = _prefix(group.strip("/"))
    run, lumi, evt = (by_lower[(p + k).lower()] for k in ("runNum", "lumiSec", "evtNum"))
    return run, lumi, evt


def split_path(path: str) -> tuple[str, str]:
    """Split a dataset path: ``/Photon/Photon.pt`` -> ``("/Photon/", "Photon.pt")``."""
    head, slash, name = path.rpartition("/")
    return head + slash, name


def schemas_from_paths(
    paths: Iterable[str],
    types: Mapping[str, T.DataType] | None = None,
    rename: bool = False,
) -> dict[str, T.StructType]:
    """One schema per group from a list of dataset paths.

    Every field is float unless ``types`` names another type for its dataset.
    ``rename`` applies :func:`column_name` to the field names.
    """
    types = types or {}
    out: dict[str, T.StructType] = {}
    for path in paths:
        group, dataset = split_path(path)
        field = T.StructField(
            column_name(dataset) if rename else dataset,
            types.get(dataset, T.FloatType()),
            False,
        )
        out[group] = T.StructType([*out.get(group, T.StructType()).fields, field])
    return out
