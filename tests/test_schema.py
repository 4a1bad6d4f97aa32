import pytest
from pyspark.sql import types as T

from eventskim.schema import (
    GROUP_FIELDS,
    column_names,
    event_key,
    group_schema,
    schemas_from_paths,
    split_path,
)


def test_catalogue_sizes():
    sizes = {g: len(group_schema(g)) for g in GROUP_FIELDS}
    assert sizes == {
        "Muon": 11,
        "Tau": 8,
        "Photon": 12,
        "Electron": 20,
        "AK4Puppi": 14,
        "CA15Puppi": 14,
        "AddCA15Puppi": 11,
        "Info": 9,
        "GenEvtInfo": 5,
    }
    assert not any(f.nullable for g in GROUP_FIELDS for f in group_schema(g))


def test_types_and_slashes():
    electron = group_schema("/Electron/")
    assert electron["Electron_isConv"].dataType == T.ByteType()
    assert electron["Electron_nMissingHits"].dataType == T.IntegerType()
    assert group_schema("Tau")["Tau_hpsDisc"].dataType == T.LongType()
    with pytest.raises(KeyError):
        group_schema("Kaon")


def test_event_keys():
    assert event_key("Info") == ("runNum", "lumiSec", "evtNum")
    assert event_key("Muon") == ("Muon_runNum", "Muon_lumisec", "Muon_evtNum")
    assert event_key("AddCA15Puppi")[1] == "AddCA15Puppi_lumiSec"


def test_paths():
    assert split_path("/run/a/Kaon.mass") == ("/run/a/", "Kaon.mass")
    assert split_path("mass") == ("", "mass")
    assert column_names(["Kaon.mass", "weight"]) == ["Kaon_mass", "weight"]


def test_schemas_from_paths():
    paths = ["/Kaon/Kaon.mass", "/Pion/Pion.charge", "/Pion/Pion.event"]
    found = schemas_from_paths(paths)
    assert list(found) == ["/Kaon/", "/Pion/"]
    assert found["/Kaon/"] == T.StructType([T.StructField("Kaon.mass", T.FloatType(), False)])
    typed = schemas_from_paths(paths, {"Pion.event": T.IntegerType()}, rename=True)
    assert typed["/Pion/"] == T.StructType(
        [T.StructField("Pion_charge", T.FloatType(), False), T.StructField("Pion_event", T.IntegerType(), False)]
    )
