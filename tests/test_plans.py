"""The physical plans: what reaches the scan, how often rows are shuffled, what is absent."""

import re

import pytest

from eventskim.functions import ELECTRON_AREA
from eventskim.operators import count_under_cuts, filter_muon, join_event, stamp_rows, step_lookup_join
from eventskim.plans import pipelines as p
from eventskim.plans import queries
from eventskim.plans.sql_analyses import LEADING_ELECTRONS, LEADING_MUONS, run_sql
from eventskim.schema import event_key
from eventskim.sources import read_group

PYTHON_QUERIES = {"muon_filter_udf", "scan_colgroup", "scan_colgroup_columns", "vjet_filter_aligned_scan"}
PYTHON_QUERIES |= {"scan_arrays_format", "scan_arrays_range", "scan_arrays_pushed", "vjet_filter_arrays_format"}
PYTHON_QUERIES |= {"vjet_filter_paired", "vjet_leading_paired"}
# Python rounds one total for each column.
PYTHON_QUERIES |= {"exact_sums_of_groups", "sums_of_arrays", "sums_of_root"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hashpartitioning|SinglePartition|rangepart)", plan(df)))


@pytest.fixture
def sort_merge(spark):
    """Join as on large tables: nothing is small enough to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", queries.queries())
def test_no_query_crosses_or_leaves_the_jvm(spark, sf_dir, name):
    text = plan(queries.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_QUERIES:
        assert "Python" not in text and "InPandas" not in text


def test_cut_and_columns_reach_the_scan(spark, root):
    text = plan(filter_muon(read_group(spark, root, "Muon")).select("Muon_pt"))
    assert "GreaterThanOrEqual(Muon_pt,10.0)" in text
    assert "GreaterThan(Muon_eta,-2.4)" in text and "LessThan(Muon_eta,2.4)" in text
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert "Muon_phi" not in schema and "Muon_evtNum" not in schema


def test_cut_passes_below_the_join(spark, root, sort_merge):
    joined = p.select_electrons(read_group(spark, root, "Electron"), read_group(spark, root, "Info"))
    text = plan(joined)
    assert "GreaterThanOrEqual(Electron_pt,10.0)" in text
    below = text[text.index("SortMergeJoin") :]
    assert below.count("Electron_nMissingHits") > text[: text.index("SortMergeJoin")].count(
        "Electron_nMissingHits"
    )
    assert shuffles(joined) == 2


def test_leading_electron_needs_no_event_table(spark, root, sort_merge):
    electrons, info = read_group(spark, root, "Electron"), read_group(spark, root, "Info")
    text = plan(p.leading_electrons(electrons, info))
    assert "Join" not in text and "/Info" not in text
    assert "Join" in plan(p.leading_electrons(electrons, info, subtract_pileup=True))


def test_one_shuffle_combines_the_event(spark, root, sort_merge):
    info = read_group(spark, root, "Info")
    assert shuffles(p.leading_photons(read_group(spark, root, "Photon"), info)) == 1
    assert shuffles(p.leading_jets(read_group(spark, root, "AK4Puppi"), info)) == 1
    vjets = p.select_vjets(
        read_group(spark, root, "CA15Puppi", stamped=True),
        read_group(spark, root, "AddCA15Puppi", stamped=True),
    )
    jets = p.jets(read_group(spark, root, "AK4Puppi"), info, vjets)
    # Two bring the aligned rows together, one the events.
    assert shuffles(vjets) == 2
    assert shuffles(jets) == 3


def test_reductions_combine_before_the_shuffle(spark, root):
    text = plan(p.leading_muons(read_group(spark, root, "Muon")))
    assert "partial_max" in text and shuffles(p.leading_muons(read_group(spark, root, "Muon"))) == 1


def test_null_safe_join_is_an_equi_join(spark, root, sort_merge):
    joined = join_event(read_group(spark, root, "Tau"), read_group(spark, root, "Info"), "Tau")
    assert "SortMergeJoin [coalesce(Tau_evtNum" in plan(joined)


def test_stamps_leave_pruning_intact(spark, root):
    tau = stamp_rows(spark.read.parquet(f"{root}/Tau")).select("Tau_pt", "_row")
    assert "ReadSchema: struct<Tau_pt:double,_tmp_metadata_row_index:bigint>" in plan(tau)


def test_aggregation_leads_with_the_event_number(spark, root):
    run, lumi, evt = event_key("Muon")
    text = re.sub(r"#\d+L?", "", plan(p.leading_muons(read_group(spark, root, "Muon"))))
    assert f"hashpartitioning({evt}, {lumi}, {run}" in text


def test_lookup_by_join_moves_no_row(spark, root, sort_merge):
    """Its bins are literals of known size, sent to the tasks even where broadcasts are off."""
    electrons = read_group(spark, root, "Electron").select("Electron_evtNum", "Electron_eta")
    looked_up = step_lookup_join(electrons, "Electron_eta", ELECTRON_AREA, "area")
    looked_up.collect()
    assert shuffles(looked_up) == 0


@pytest.fixture
def static(spark, sort_merge):
    """Plans as they are before the run, with exchanges that are used twice."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_counts_move_the_rows_once(spark, root, static):
    tau = read_group(spark, root, "Tau")
    cuts = {"a": tau["Tau_pt"] > 10, "b": (tau["Tau_pt"] > 10) & (tau["Tau_eta"] > 0)}
    counted = count_under_cuts(tau, "Tau", cuts)
    # The rows, the counts by event, the counts by part; a use of the first again names it.
    assert plan(counted).count("ReusedExchange") == 1 and shuffles(counted) - 1 == 3
    assert plan(counted).count("FileScan") == 1
    assert shuffles(count_under_cuts(tau, "Tau", cuts, salts=1)) == 1


def test_counts_of_reduced_jets_need_no_exchange(spark, root, sf_dir, static):
    counted = queries.queries()["jet_counts_joined"](spark, sf_dir)
    assert shuffles(counted) == 3 and plan(counted).count("SortMergeJoin") == 1 and plan(counted).count("FileScan") == 4


def test_pileup_moves_each_electron_once(spark, root, static):
    electrons, info = read_group(spark, root, "Electron"), read_group(spark, root, "Info")
    assert shuffles(p.leading_electrons(electrons, info, subtract_pileup=True, by_id=True)) == 2
    assert shuffles(p.leading_electrons(electrons, info, subtract_pileup=True)) == 3


def test_paired_files_move_no_row(spark, sf_dir, static):
    """Only slices, of a file each, are dealt out; then rows by event."""
    dealt = lambda name: plan(queries.queries()[name](spark, sf_dir)).count("Exchange hashpartitioning")
    assert dealt("vjet_filter_paired") == 0 and dealt("vjet_leading_paired") <= 1
    assert "Join" not in plan(queries.queries()["vjet_leading_paired"](spark, sf_dir))


def test_sql_has_the_plan_of_the_columns(spark, root, static):
    """Functions of the session become the expressions that the operators use."""
    def shape(df):
        text = re.sub(r"#\d+L?|_pre_\w+|plan_id=\d+", "", plan(df))
        return sorted(re.findall(r"(?:Join|Exchange hashpartitioning|FileScan parquet|PushedFilters: \[[^\]]*\]|Aggregate)", text))

    groups = {g: read_group(spark, root, g) for g in ("Electron", "Info", "Muon")}
    sql = run_sql(spark, LEADING_ELECTRONS, **groups)
    assert shape(sql) == shape(p.leading_electrons(groups["Electron"], groups["Info"], subtract_pileup=True))
    assert shape(run_sql(spark, LEADING_MUONS, **groups)) == shape(p.leading_muons(groups["Muon"]))
    assert "Python" not in plan(sql)
