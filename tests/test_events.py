"""Event joins and reductions against brute force, with duplicates, NULL keys and a hot event."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eventskim.operators import (
    EventBranch,
    combine_events,
    count_under_cuts,
    filter_jet,
    join_event,
    join_event_by_id,
    join_leading,
    leading,
)
from eventskim.plans import pipelines as p
from eventskim.plans.fixtures import view
from eventskim.schema import event_key

MUON_SCHEMA = "Muon_runNum int, Muon_lumisec int, Muon_evtNum int, Muon_pt double, Muon_eta double"
INFO_SCHEMA = "runNum int, lumiSec int, evtNum int, rhoIso double, puppETphi double"


def random_key(rng):
    if rng.random() < 0.4:
        return (1, 1, 1)  # a hot event
    return (rng.choice([1, 2, None]), rng.choice([1, 2]), rng.choice([1, 2, 3, None]))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    values = [None, 1.0, 2.0, 3.0]
    muons = [(*random_key(rng), rng.choice(values), rng.choice(values)) for _ in range(300)]
    info = [(*random_key(rng), rng.choice(values), rng.choice(values)) for _ in range(12)]
    return muons, info, spark.createDataFrame(muons, MUON_SCHEMA), spark.createDataFrame(info, INFO_SCHEMA)


def null_lowest(values):
    return tuple((v is not None, v or 0.0) for v in values)


def plain(df):
    return sorted(map(tuple, df.collect()), key=null_lowest)


def test_join_is_null_safe(tables):
    muons, info, mu, inf = tables
    want = []
    for m in muons:
        found = [i for i in info if i[:3] == m[:3]] or [(None,) * 5]
        want += [(*m, *i) for i in found]
    assert plain(join_event(mu, inf, "Muon")) == sorted(want, key=null_lowest)


def test_leading(tables):
    muons, _, mu, _ = tables
    best, count = {}, defaultdict(int)
    for m in muons:
        count[m[:3]] += 1
        if m[:3] not in best or null_lowest(m[3:]) > null_lowest(best[m[:3]]):
            best[m[:3]] = m[3:]
    want = [(*k, *v, count[k]) for k, v in best.items()]
    out = leading(mu, "Muon", ["Muon_pt", "Muon_eta"], "N")
    assert out.columns == [*event_key("Muon"), "Muon_pt", "Muon_eta", "N"]
    assert plain(out) == sorted(want, key=null_lowest)


def test_leading_tie_and_null(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 5.0, 1.0), (1, 1, 1, 5.0, 2.0), (1, 1, 2, None, 9.0), (1, 1, 2, 1.0, 0.0)],
        MUON_SCHEMA,
    )
    got = plain(leading(df, "Muon", ["Muon_pt", "Muon_eta"]))
    assert got == [(1, 1, 1, 5.0, 2.0), (1, 1, 2, 1.0, 0.0)]


def test_combine_equals_join_then_reduce(tables):
    """One aggregation over stacked tables gives what joining first would."""
    _, _, mu, inf = tables
    joined = join_event(mu, inf, "Muon")
    want = joined.groupBy(*event_key("Muon")).agg(
        F.max(F.struct("Muon_pt", "Muon_eta", "puppETphi")).alias("t"), F.count("*").alias("n")
    ).select(*event_key("Muon"), "t.*", "n")
    events = combine_events(
        EventBranch("muon", mu, "Muon", ("Muon_pt", "Muon_eta")),
        EventBranch("info", inf, "Info", ("puppETphi",)),
    ).filter("muon_rows > 0")
    pairs = F.col("muon_rows") * F.greatest("info_rows", F.lit(1))
    got = events.select("runNum", "lumiSec", "evtNum", "muon.*", "info.puppETphi", pairs)
    assert plain(got) == plain(want)


def test_photons_equal_join_then_reduce(spark, tables):
    _, _, mu, inf = tables
    photon = mu.toDF(*[c.replace("Muon", "Photon") for c in mu.columns]).withColumn(
        "Photon_phi", F.col("Photon_eta") * 2
    )
    fields = ["Photon_pt", "Photon_eta", "Photon_phi"]
    want = leading(join_event(photon, inf, "Photon"), "Photon", fields, "NMedium")
    assert plain(p.leading_photons(photon, inf)) == plain(want)


def test_jets_equal_the_chain_of_joins(spark, sf_dir):
    """The single aggregation against the same analysis written as joins."""
    jet, info = view(spark, sf_dir, "AK4Puppi"), view(spark, sf_dir, "Info")
    info = info.unionAll(info.filter("evtNum < 200"))  # some events twice
    vjets = p.select_vjets(
        view(spark, sf_dir, "CA15Puppi", True), view(spark, sf_dir, "AddCA15Puppi", True)
    )
    top = leading(
        filter_jet(join_event(jet, info, "AK4Puppi")), "AK4Puppi", [*p.JET_FIELDS, "puppETphi"], "N"
    )
    chain = join_leading(top, leading(vjets, "CA15Puppi", p.VJET_FIELDS, "N"))
    got = p.jets_with_vjets(jet, info, vjets).select(*chain.columns)
    assert got.exceptAll(chain).count() == chain.exceptAll(got).count() == 0
    assert got.filter("N > 1").count() > 0


def test_counts_under_cuts(tables):
    muons, _, mu, _ = tables
    per_event = defaultdict(lambda: [0, 0])
    for m in muons:
        per_event[m[:3]][0] += m[3] is not None and m[3] > 1
        per_event[m[:3]][1] += m[4] is not None and m[4] > 2
    want = [
        (*m, *per_event[m[:3]]) for m in muons if None not in m[:3] and all(per_event[m[:3]])
    ]
    cuts = {"a": F.col("Muon_pt") > 1, "b": F.col("Muon_eta") > 2}
    assert plain(count_under_cuts(mu, "Muon", cuts)) == sorted(want, key=null_lowest)


def test_counts_of_single_rows(tables):
    _, _, mu, _ = tables
    one = leading(mu, "Muon", ["Muon_pt", "Muon_eta"])
    cuts = {"a": F.col("Muon_pt") > 1, "b": F.col("Muon_eta") > 2}
    direct = count_under_cuts(one, "Muon", cuts, one_row_per_event=True)
    assert plain(direct) == plain(count_under_cuts(one, "Muon", cuts))


def test_hot_event_is_split(spark):
    """Most objects in one event: the join's large side is cut at run time."""
    hot = F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id")).cast("int")
    mu = spark.range(0, 200_000, 1, 8).select(
        F.lit(1).alias("Muon_runNum"),
        F.lit(1).alias("Muon_lumisec"),
        hot.alias("Muon_evtNum"),
        F.col("id").cast("double").alias("Muon_pt"),
    )
    info = spark.range(200_000).select(
        F.lit(1).alias("runNum"), F.lit(1).alias("lumiSec"), F.col("id").cast("int").alias("evtNum")
    )
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = join_event(mu, info, "Muon")
        counted = leading(joined, "Muon", ["Muon_pt"], "N")
        top = counted.orderBy(F.desc("N")).first()
        plan = counted._jdf.queryExecution()
        counted.collect()
        assert top["N"] == 160_000 and top["Muon_evtNum"] == 0
        assert "skew=true" in plan.executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_counts_of_a_hot_event(spark):
    """A third of the rows in one event; its rows are dealt over parts, and the counts are whole."""
    schema = "Tau_runNum int, Tau_lumisec int, Tau_evtNum long, Tau_pt double, Tau_eta double"
    rows = [(1, 2, 7 if i % 3 == 0 else i, float(i % 50), float(i % 7) - 3) for i in range(3000)]
    rows += [(1, None, 7, 40.0, 1.0), (None, None, None, 40.0, 1.0), (1, 2, 7, 30.0, 1.0), (1, 2, 7, 30.0, 1.0)]
    df = spark.createDataFrame(rows, schema).repartition(5)
    cuts = {"n": F.col("Tau_pt") > 20, "m": (F.col("Tau_pt") > 20) & (F.col("Tau_eta") > 0)}
    got = [sorted(map(tuple, count_under_cuts(df, "Tau", cuts, salts=s).collect())) for s in (1, 2, 16)]
    by_event = {}
    for r in rows:
        if None not in r:
            n, m = by_event.get(r[:3], (0, 0))
            by_event[r[:3]] = (n + (r[3] > 20), m + (r[3] > 20 and r[4] > 0))
    want = sorted((*r, *by_event[r[:3]]) for r in rows if None not in r and all(by_event[r[:3]]))
    assert got == [want] * 3
    with pytest.raises(ValueError, match="one part"):
        count_under_cuts(df, "Tau", cuts, salts=0)


def test_join_by_id_is_the_null_safe_join(spark):
    keys = [(1, 2, 3), (1, 2, None), (None, 2, 3), (None, None, None), (1, 2, 4), (1, 2, 3)]
    objects = spark.createDataFrame([(*k, float(i)) for i, k in enumerate(keys)], "Tau_runNum int, Tau_lumisec int, Tau_evtNum long, Tau_pt double")
    info = spark.createDataFrame([(*k, float(i) / 2) for i, k in enumerate(keys[:4])], "runNum int, lumiSec int, evtNum long, rhoIso double")
    plain, by_id = join_event(objects, info, "Tau"), join_event_by_id(objects, info, "Tau")
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, by_id.drop("_hash", "_event").collect()))
    tops = [Counter(map(tuple, leading(df, "Tau", ["Tau_pt", "rhoIso"], "N").collect())) for df in (plain, by_id)]
    assert tops[0] == tops[1] and len(tops[0]) == 5
