"""Cuts at their thresholds, on small rows made for each."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from eventskim.functions import (
    ELECTRON_AREA,
    StepTable,
    delta_phi_or,
    delta_r,
    forward_delta_phi_or,
    jet_id,
    step_lookup,
)
from eventskim.operators import (
    filter_electron,
    filter_jet,
    filter_muon,
    filter_muon_udf,
    filter_photon,
    filter_tau,
    filter_vjet,
    preselect_met,
    step_lookup_join,
    substructure,
)
from eventskim.plans.fixtures import view


def frame(spark, base, *changes, types=""):
    """One row per change, with its number in ``id``."""
    rows = [{**base, **c, "id": i} for i, c in enumerate(changes)]
    names = list(rows[0])
    kinds = {n: "double" for n in names} | {"id": "int"}
    kinds |= dict(t.split() for t in types.split(", ") if t)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


MUON = {
    "Muon_pt": 10.0,
    "Muon_eta": 0.0,
    "Muon_chHadIso": 0.0,
    "Muon_neuHadIso": 0.0,
    "Muon_gammaIso": 0.0,
    "Muon_puIso": 0.0,
    "Muon_pogIDBits": 1,
}


@pytest.mark.parametrize("form", [filter_muon, filter_muon_udf])
def test_muon(spark, form):
    df = frame(
        spark,
        MUON,
        {},
        {"Muon_pt": 9.999},
        {"Muon_eta": 2.4},
        {"Muon_eta": 2.3999},
        {"Muon_eta": -2.4},
        {"Muon_pogIDBits": 2},
        {"Muon_pogIDBits": 3},
        {"Muon_neuHadIso": 1.0, "Muon_puIso": 4.0},  # floored at zero
        {"Muon_chHadIso": 1.2},  # equal to 12 % of pt
        {"Muon_chHadIso": 1.19},
        types="Muon_pogIDBits int",
    )
    assert ids(form(df)) == [0, 3, 6, 7, 9]
    assert ids(form(df, 2)) == [5, 6]
    assert form(df).filter("NOT passfilter").count() == 0


def test_muon_forms_agree_on_null(spark):
    """A NULL neutral part counts as nothing; NULL elsewhere fails the cut."""
    changes = [{c: None} for c in MUON] + [{}, {"Muon_neuHadIso": None, "Muon_chHadIso": 1.3}]
    df = frame(spark, MUON, *changes, types="Muon_pogIDBits int")
    native, twin = ids(filter_muon(df)), ids(filter_muon_udf(df))
    assert native == twin
    assert [list(MUON)[i] for i in native if i < len(MUON)] == ["Muon_neuHadIso", "Muon_gammaIso", "Muon_puIso"]


def test_tau(spark):
    base = {"Tau_pt": 10.0, "Tau_eta": 0.0, "Tau_hpsDisc": 65536, "Tau_rawIso3Hits": 5.0}
    df = frame(
        spark,
        base,
        {},
        {"Tau_hpsDisc": 32768},
        {"Tau_hpsDisc": 98304},
        {"Tau_rawIso3Hits": 5.001},
        {"Tau_eta": 2.3},
        {"Tau_eta": -2.2999},
        types="Tau_hpsDisc bigint",
    )
    assert ids(filter_tau(df)) == [0, 2, 5]


PHOTON = {
    "Photon_pt": 175.0,
    "Photon_eta": 0.0,
    "Photon_scEta": 0.0,
    "Photon_chHadIso": 99.0,
    "Photon_neuHadIso": 99.0,
    "Photon_gammaIso": 99.0,
    "Photon_sieie": 1.0,
    "Photon_sthovere": 1.0,
    "rhoIso": 0.0,
}


def test_photon(spark):
    df = frame(
        spark,
        PHOTON,
        {},
        {"Photon_sthovere": 0.05},
        {"Photon_sthovere": 0.05, "Photon_pt": 174.9},
        {"Photon_sieie": 0.0103},
        {"Photon_sieie": 0.02},
        {"Photon_sieie": 0.02, "Photon_scEta": -1.479},  # still the barrel
        {"Photon_sieie": 0.02, "Photon_scEta": 1.48},
        {"Photon_neuHadIso": 2.57 + math.exp(0.0044 * 175.0 * 0.5809) - 1e-9},
        {"Photon_gammaIso": 1.92 + 0.0043 * 175.0 + 1e-9},
        {"rhoIso": None},  # areas NULL: isolation counts as zero
        {"Photon_chHadIso": 2.44 + 0.0157, "rhoIso": 1.0},
        {"Photon_eta": 1.4442, "Photon_sthovere": 0.0},
        {"Photon_scEta": None},
        {"Photon_scEta": None, "Photon_sthovere": 0.01},
    )
    assert ids(filter_photon(df)) == [1, 3, 6, 7, 9, 10, 13]


ELECTRON = {
    "Electron_pt": 10.0,
    "Electron_eta": 0.0,
    "Electron_scEta": 0.0,
    "Electron_chHadIso": 9.0,
    "Electron_neuHadIso": 0.0,
    "Electron_gammaIso": 0.0,
    "Electron_dEtaIn": 1.0,
    "Electron_dPhiIn": 1.0,
    "Electron_sieie": 1.0,
    "Electron_hovere": 0.0,
    "Electron_eoverp": 9.0,
    "Electron_ecalEnergy": 0.0,
    "Electron_d0": 9.0,
    "Electron_dz": 9.0,
    "Electron_nMissingHits": 9,
    "Electron_isConv": 0,
    "rhoIso": 0.0,
}
E_TYPES = "Electron_nMissingHits int, Electron_isConv tinyint"


def test_electron_first_selection(spark):
    df = frame(
        spark,
        ELECTRON,
        {},
        {"Electron_sieie": 0.0113},
        {"Electron_sieie": 0.03},
        {"Electron_sieie": 0.03, "Electron_scEta": 1.479},  # endcap from the edge on
        {"Electron_sieie": 0.03, "Electron_scEta": -1.4789},
        {"Electron_chHadIso": 1.26},
        {"Electron_chHadIso": 1.26, "Electron_scEta": 2.0},
        {"Electron_dEtaIn": -0.0151},
        {"Electron_dPhiIn": -0.2159},
        {"Electron_chHadIso": 0.0, "Electron_neuHadIso": -5.0},  # neutral part floored
        {"Electron_sieie": 0.0, "Electron_scEta": None},
        {"Electron_sieie": 0.0, "Electron_eta": 2.5},
        types=E_TYPES,
    )
    assert ids(filter_electron(df)) == [1, 3, 6, 7, 8, 9]


def test_electron_second_selection(spark):
    base = {**ELECTRON, "Electron_sieie": 0.0, "Electron_hovere": 9.0}
    df = frame(
        spark,
        base,
        {},
        {"Electron_hovere": 0.18},
        {"Electron_hovere": 0.18, "Electron_scEta": 2.0},
        {"Electron_eoverp": 0.5, "Electron_ecalEnergy": 2.5},
        {"Electron_eoverp": 0.5, "Electron_ecalEnergy": 2.5, "Electron_scEta": 2.0},
        {"Electron_d0": -0.05},
        {"Electron_dz": 0.9, "Electron_scEta": -2.0},
        {"Electron_nMissingHits": 3},
        {"Electron_nMissingHits": 3, "Electron_scEta": 2.0},
        {"Electron_nMissingHits": 2},
        types=E_TYPES,
    )
    assert ids(filter_electron(df)) == [1, 3, 5, 6, 8, 9]


def test_electron_variants(spark):
    df = frame(
        spark,
        {**ELECTRON, "Electron_chHadIso": 0.0},
        {},
        {"Electron_isConv": 1},
        # 10 * 0.1752 taken off the neutral part brings it below 1.26
        {"Electron_neuHadIso": 2.0, "rhoIso": 10.0},
        {"Electron_neuHadIso": 2.0, "rhoIso": 10.0, "Electron_isConv": 1},
        {"Electron_neuHadIso": 2.0, "rhoIso": None},  # NULL: the floor is taken
        types=E_TYPES,
    )
    assert ids(filter_electron(df)) == [0, 1]
    assert ids(filter_electron(df, veto_conversions=True)) == [0]
    assert ids(filter_electron(df, subtract_pileup=True)) == [0, 1, 2, 3, 4]
    assert ids(filter_electron(df, True, True)) == [0, 2, 4]
    # Where the area must be known, the last one fails whatever its isolation.
    assert ids(filter_electron(df, subtract_pileup=True, need_area=True)) == [0, 1, 2, 3]


JET = {
    "pt": 150.0,
    "eta": 0.0,
    "neuHadFrac": 0.0,
    "neuEmFrac": 0.0,
    "chHadFrac": 0.5,
    "chEmFrac": 0.0,
    "nParticles": 5,
    "nCharged": 5,
}
JET_CHANGES = (
    {},
    {"nParticles": 1},
    {"chEmFrac": 0.99},
    {"chEmFrac": 0.99, "eta": 2.4},
    {"neuHadFrac": 0.99},
    {"neuEmFrac": 0.9899},
    {"chHadFrac": 0.0},
    {"nCharged": 0},
    {"nParticles": 1, "pt": 149.9},
    {"nParticles": 1, "pt": 29.9},
    {"nParticles": 1, "eta": 2.5},
    {"nParticles": 1, "eta": 4.5},
)


@pytest.mark.parametrize(
    "prefix, form, passing",
    [
        ("AK4Puppi", filter_jet, [1, 2, 4, 6, 7, 8, 10]),
        ("CA15Puppi", filter_vjet, [1, 2, 4, 6, 7]),
    ],
)
def test_jets(spark, prefix, form, passing):
    def named(row):
        return {f"{prefix}_{k}": v for k, v in row.items()}

    types = f"{prefix}_nParticles int, {prefix}_nCharged int"
    df = frame(spark, named(JET), *[named(c) for c in JET_CHANGES], types=types)
    assert ids(form(df)) == passing
    assert ids(df.filter(jet_id(prefix))) == [1, 2, 4, 6, 7, 8, 9, 10, 11]


def test_met(spark):
    df = frame(spark, {"pfMET": 200.0, "puppET": 200.0}, {}, {"pfMET": 201.0}, {"puppET": 201.0})
    assert ids(preselect_met(df)) == [1, 2]


def test_step_lookup(spark):
    values = [-5.0, 0.7999, 0.8, 1.3, 2.3999, 2.4, 99.0, math.nan, None]
    expected = [0.1752, 0.1752, 0.1862, 0.1411, 0.2243, 0.2687, 0.2687, 0.2687, None]
    df = spark.createDataFrame([Row(id=i, x=v) for i, v in enumerate(values)], "id int, x double")
    direct = df.withColumn("v", step_lookup(F.col("x"), ELECTRON_AREA))
    joined = step_lookup_join(df, "x", ELECTRON_AREA, "v")
    for out in (direct, joined):
        assert [r["v"] for r in out.orderBy("id").collect()] == expected


def test_long_step_table(spark):
    edges = tuple(float(i) for i in range(300))
    table = StepTable(edges, tuple(float(i * i) for i in range(301)))
    df = spark.range(600).select((F.col("id") / 2 - 1).alias("x"))
    expected = F.pow(F.least(F.floor("x") + 1, F.lit(300)), F.lit(2))
    out = df.select(step_lookup(F.col("x"), table).alias("v"), F.greatest(expected, F.lit(0.0)).alias("w"))
    assert out.filter("v <> w").count() == 0


def test_bad_step_table(spark):
    with pytest.raises(ValueError):
        step_lookup(F.lit(1.0), StepTable((1.0,), (1.0,)))
    with pytest.raises(ValueError):
        step_lookup(F.lit(1.0), StepTable((2.0, 1.0), (1.0, 2.0, 3.0)))


def test_angles(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 0.5), (1, -1.0, 0.5), (2, None, 0.5), (3, 3.0, -3.0)],
        "id int, met double, phi double",
    )
    met, phi = F.col("met"), F.col("phi")
    rows = df.select(
        delta_phi_or(met, phi).alias("a"), forward_delta_phi_or(met, phi).alias("b")
    ).collect()
    assert [round(r["a"], 9) for r in rows] == [0.5, 1.5, 999.99, round(2 * math.pi - 6, 9)]
    assert [round(r["b"], 9) for r in rows] == [0.5, 999.99, 999.99, round(2 * math.pi - 6, 9)]


def test_delta_r(spark):
    df = spark.createDataFrame(
        [(0.0, 3.2, 0.0, 0.0), (1.0, 0.0, 1.0, 3.2), (3.0, 1.0, 0.0, -3.0), (0.0, 0.0, None, None)],
        "a double, b double, c double, d double",
    )
    cols = [F.col(c) for c in "abcd"]
    got = [r[0] for r in df.select(delta_r(*cols)).collect()]
    assert got[0] == pytest.approx(3.2 - math.pi)
    assert got[1] == pytest.approx(3.2 - math.pi)
    assert got[2] == pytest.approx(math.hypot(3.0, 4.0 - math.pi))
    assert got[3] is None
    geometric = [r[0] for r in df.select(delta_r(*cols, wrap="2pi")).collect()]
    assert geometric[0] == pytest.approx(2 * math.pi - 3.2)
    with pytest.raises(ValueError):
        delta_r(*cols, wrap="none")


def test_substructure(spark):
    names = ["tau1", "tau2", "tau3", "mass_sd0", *[f"sj{i}_csv" for i in range(1, 5)]]
    schema = ", ".join(f"AddCA15Puppi_{n} float" for n in names)
    df = spark.createDataFrame(
        [(1.0, 2.0, 4.0, 7.0, 0.5, 0.25, 0.75, None), (1.0, 0.0, 0.0, 7.0, 0.5, 0.25, 0.0, 1.0)],
        schema,
    )
    out = substructure(df)
    assert out.columns == ["AddCA15Puppi_mass_sd0", "tau21", "tau32", "mincsv", "maxsubcsv"]
    assert [tuple(r) for r in out.collect()] == [
        (7.0, 0.5, 0.5, 0.25, 0.75),
        (7.0, None, None, 0.25, 1.0),
    ]


def test_native_and_udf_agree(spark, sf_dir):
    muon = view(spark, sf_dir, "Muon")
    a, b = filter_muon(muon), filter_muon_udf(muon)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_cuts_work_on_a_stream(spark, sf_dir, tmp_path):
    """The cuts are stateless columns, so a streaming table takes them as it is."""
    muon = view(spark, sf_dir, "Muon")
    path = str(tmp_path / "muon")
    muon.write.parquet(path)
    stream = filter_muon(spark.readStream.schema(muon.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("muons").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("muons").count() == filter_muon(muon).count()
