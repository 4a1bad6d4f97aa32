"""Every operator as a query over the stand-in groups, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ELECTRON_AREA, step_lookup
from ..operators import (
    add_row_index,
    column_sums,
    count_rows,
    count_under_cuts,
    exact_sums,
    filter_jet,
    filter_muon,
    filter_muon_udf,
    filter_photon,
    filter_tau,
    filter_vjet,
    histogram,
    index_scan_rows,
    join_event,
    join_leading,
    preselect_met,
    step_lookup_join,
    substructure,
    sum_weights,
    tag_provenance,
    value_range,
    zip_rows,
)
from ..schema import column_names, event_key, schemas_from_paths, split_path
from ..session import work_dir
from ..sources import (
    bind_group,
    copy_format,
    merge_groups,
    merge_sample,
    merge_sample_again,
    read_colgroup,
    read_columns,
    read_dynamic,
    read_group,
    read_merged,
    read_paired,
    register_arrays,
    scan_arrays,
    sum_arrays,
    sum_groups,
    write_group,
    write_histogram,
)
from . import pipelines as p
from .sql_analyses import LEADING_ELECTRONS, LEADING_MUONS, SELECTED_JETS, run_sql
from .fixtures import VIEWS, load, stored, view, write_arrays

Query = Callable[[SparkSession, str], DataFrame]

# Angles go through trigonometric functions, whose last bits differ by library;
# those of a sum differ with the order of its terms.
ANGLE_DIGITS = 6
SUM_DIGITS = 6
MERGED_NAME = "ttbar_13TeV_all.parquet"
SAMPLES = ("wjets_13TeV_low", "zjets_13TeV_high")
#: Event numbers from the first on and below the second.
EVENT_RANGE = (1000, 3000)
TAU_PT, TAU_ETA = 100, 1.5
SAMPLE_GROUPS = ("Muon", "GenEvtInfo")

_QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def _register_scans() -> None:
    names = {
        "scan_muon": "Muon",
        "scan_tau": "Tau",
        "scan_photon": "Photon",
        "scan_electron": "Electron",
        "scan_info": "Info",
        "scan_genevt": "GenEvtInfo",
        "scan_jet": "AK4Puppi",
        "scan_vjet": "CA15Puppi",
        "scan_addvjet": "AddCA15Puppi",
    }
    for name, group in names.items():
        _QUERIES[name] = lambda spark, d, g=group: bind_group(view(spark, d, g), g)


_register_scans()


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, ANGLE_DIGITS) for c in columns})


def _dotted(df: DataFrame, group: str) -> DataFrame:
    """Column names as datasets are named: ``Muon.eta``."""
    return df.toDF(*[c.replace(f"{group}_", f"{group}.", 1) for c in df.columns])


def _selected_vjets(spark: SparkSession, d: str) -> DataFrame:
    return p.select_vjets(
        view(spark, d, "CA15Puppi", stamped=True), view(spark, d, "AddCA15Puppi", stamped=True)
    )


# --- sources -----------------------------------------------------------------


@_query
def read_group_by_run(spark: SparkSession, d: str) -> DataFrame:
    root = work_dir(spark, "group")
    write_group(view(spark, d, "Electron"), root, "Electron", partition_by=["Electron_runNum"])
    columns = [*event_key("Electron"), "Electron_pt", "Electron_isConv"]
    return read_group(spark, root, "Electron", columns, partitioned=True)


@_query
def scan_dynamic_group(spark: SparkSession, d: str) -> DataFrame:
    path = write_group(_dotted(view(spark, d, "Tau"), "Tau"), work_dir(spark, "group"), "Tau")
    return read_dynamic(spark, path)


@_query
def read_columns_of_group(spark: SparkSession, d: str) -> DataFrame:
    path = write_group(_dotted(view(spark, d, "Photon"), "Photon"), work_dir(spark, "group"), "Photon")
    return read_columns(spark, path, ["Photon.evtNum", "Photon.pt", "Photon.eta"])


def _unlike_files(spark: SparkSession, d: str) -> str:
    """Muons in files of three formats: a column missing, others narrower, other names and order."""
    root = work_dir(spark, "unlike")
    muons, key = view(spark, d, "Muon"), F.col("Muon_evtNum") % 3
    dotted = _dotted(muons, "Muon")
    older = muons.drop("Muon_gammaIso").withColumn("Muon_eta", F.col("Muon_eta").cast("float"))
    narrow = dotted.withColumn("Muon.pogIDBits", F.col("`Muon.pogIDBits`").cast("byte"))
    write_group(dotted.filter(F.col("`Muon.evtNum`") % 3 == 0), root, "Muon/new")
    write_group(older.filter(key == 1), root, "Muon/old/a")
    reverse = [F.col(f"`{c}`") for c in reversed(dotted.columns)]
    write_group(narrow.filter(F.col("`Muon.evtNum`") % 3 == 2).select(*reverse), root, "Muon/old/b")
    return root


@_query
def scan_unlike_files(spark: SparkSession, d: str) -> DataFrame:
    """All files of a folder whose columns and types differ; what a file lacks is NULL."""
    return read_dynamic(spark, f"{_unlike_files(spark, d)}/Muon")


@_query
def read_columns_of_unlike_files(spark: SparkSession, d: str) -> DataFrame:
    return read_columns(spark, f"{_unlike_files(spark, d)}/Muon", ["Muon.evtNum", "Muon.eta", "Muon_pogIDBits"])


@_query
def sums_of_unlike_files(spark: SparkSession, d: str) -> DataFrame:
    sums = column_sums(read_dynamic(spark, f"{_unlike_files(spark, d)}/Muon"), "Muon")
    return sums.withColumn("total", F.round("total", SUM_DIGITS))


def _register_stored() -> None:
    for group in VIEWS:
        _QUERIES[f"read_group_{group.lower()}"] = lambda spark, d, g=group: _read_stored(spark, d, g)


def _read_stored(spark: SparkSession, d: str, *groups: str) -> DataFrame | list[DataFrame]:
    """Groups stored with dataset names and the catalogue's types, and loaded again."""
    root = work_dir(spark, "stored")
    for group in groups:
        write_group(stored(spark, d, group), root, group)
    found = [read_group(spark, root, group) for group in groups]
    return found[0] if len(found) == 1 else found


_register_stored()


@_query
def float_muon_filter(spark: SparkSession, d: str) -> DataFrame:
    return filter_muon(_read_stored(spark, d, "Muon"))


@_query
def float_tau_filter(spark: SparkSession, d: str) -> DataFrame:
    return filter_tau(_read_stored(spark, d, "Tau"))


@_query
def float_photon_filter(spark: SparkSession, d: str) -> DataFrame:
    photon, info = _read_stored(spark, d, "Photon", "Info")
    return filter_photon(join_event(photon, info, "Photon"))


@_query
def float_electron_filter(spark: SparkSession, d: str) -> DataFrame:
    return p.select_electrons(*_read_stored(spark, d, "Electron", "Info"))


@_query
def float_jet_filter(spark: SparkSession, d: str) -> DataFrame:
    jet, info = _read_stored(spark, d, "AK4Puppi", "Info")
    return filter_jet(join_event(jet, info, "AK4Puppi"))


@_query
def float_vjet_cut(spark: SparkSession, d: str) -> DataFrame:
    return filter_vjet(_read_stored(spark, d, "CA15Puppi"))


@_query
def schemas_of_paths(spark: SparkSession, d: str) -> DataFrame:
    """A stored group read with the schema that its dataset paths give."""
    root = work_dir(spark, "stored")
    write_group(stored(spark, d, "Photon"), root, "Photon")
    paths = ["/Photon/Photon.evtNum", "/Photon/Photon.pt", "/Photon/Photon.eta"]
    schema = schemas_from_paths(paths, {"Photon.evtNum": T.LongType()})["/Photon/"]
    found = spark.read.schema(schema).parquet(root + split_path(paths[0])[0])
    return found.toDF(*column_names(found.columns))


@_query
def histogram_file(spark: SparkSession, d: str) -> DataFrame:
    """The histograms written as one file, read back."""
    path = work_dir(spark, "histogram")
    write_histogram(electron_histograms(spark, d), path)
    schema = "column string, bucket int, bucket_lo double, bucket_hi double, n long"
    return spark.read.schema(schema).option("header", "true").csv(path)


@_query
def scan_colgroup(spark: SparkSession, d: str) -> DataFrame:
    """Arrays in nested folders whose types differ by file."""
    path = work_dir(spark, "colgroup")
    muons = _dotted(view(spark, d, "Muon"), "Muon")
    narrow, key = F.col("`Muon.pogIDBits`").cast("byte"), F.col("`Muon.evtNum`")
    write_arrays(muons.filter(key % 3 == 0), path, "Muon")
    write_arrays(muons.filter(key % 3 != 0).withColumn("Muon.pogIDBits", narrow), f"{path}/part-00000-0/deeper", "Muon")
    return read_colgroup(spark, path, "Muon", slices_per_file=4)


@_query
def scan_colgroup_columns(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark, "colgroup")
    write_arrays(view(spark, d, "Electron"), path, "Electron")
    columns = ["Electron_evtNum", "Electron_pt", "Electron_isConv"]
    return read_colgroup(spark, path, "Electron", columns=columns)


def _electron_arrays(spark: SparkSession, d: str) -> str:
    path = work_dir(spark, "colgroup")
    write_arrays(view(spark, d, "Electron"), path, "Electron")
    return path


@_query
def scan_arrays_format(spark: SparkSession, d: str) -> DataFrame:
    """Column arrays by ``spark.read``; the types come from their headers."""
    register_arrays(spark)
    return spark.read.format("column_arrays").option("groups", "Electron").load(_electron_arrays(spark, d))


@_query
def scan_arrays_range(spark: SparkSession, d: str) -> DataFrame:
    """Events of a range of numbers; of arrays other than the key only such stretches are read."""
    columns, ranges = ["Electron_evtNum", "Electron_pt", "Electron_eta"], {"Electron_evtNum": EVENT_RANGE}
    return scan_arrays(spark, _electron_arrays(spark, d), "Electron", columns=columns, ranges=ranges)


@_query
def scan_arrays_pushed(spark: SparkSession, d: str) -> DataFrame:
    columns = ["Electron_evtNum", "Electron_pt", "Electron_eta"]
    found = scan_arrays(spark, _electron_arrays(spark, d), "Electron", columns=columns, push_filters=True)
    return found.filter((F.col("Electron_evtNum") >= EVENT_RANGE[0]) & (F.col("Electron_evtNum") < EVENT_RANGE[1]))


@_query
def vjet_filter_arrays_format(spark: SparkSession, d: str) -> DataFrame:
    """Both groups of wide jets paired by one scan of the format."""
    path, groups = work_dir(spark, "colgroup"), ("CA15Puppi", "AddCA15Puppi")
    write_arrays(_zipped(spark, d, "inner"), path, *groups)
    return p.select_paired_vjets(scan_arrays(spark, path, *groups))


def _paired_vjets(spark: SparkSession, d: str) -> DataFrame:
    """Both groups of wide jets as files of their own, read side by side and selected."""
    root, groups = work_dir(spark, "paired"), ("CA15Puppi", "AddCA15Puppi")
    for group in groups:
        write_group(_dotted(view(spark, d, group), group), root, group)
    return p.select_paired_vjets(read_paired(spark, root, *groups))


@_query
def vjet_filter_paired(spark: SparkSession, d: str) -> DataFrame:
    return _paired_vjets(spark, d)


@_query
def vjet_leading_paired(spark: SparkSession, d: str) -> DataFrame:
    """Leading wide jets from paired files: the only exchange is that by event."""
    return p.leading_paired_vjets(_paired_vjets(spark, d))


def _samples(spark: SparkSession, d: str, root: str, group: str) -> list[str]:
    """``group`` stored as a folder for each run; the folders."""
    rows = view(spark, d, group).withColumn("sample", F.col("runNum"))
    path = write_group(rows, root, "samples", partition_by=["sample"])
    runs = spark.read.parquet(path).select("sample").distinct().orderBy("sample").collect()
    return [f"{path}/sample={r['sample']}" for r in runs]


@_query
def merge_groups_by_run(spark: SparkSession, d: str) -> DataFrame:
    root = work_dir(spark, "merge")
    sources = _samples(spark, d, root, "GenEvtInfo")
    target = f"{root}/GenEvtInfo"
    copy_format(spark, sources[0], target)
    merge_groups(spark, sources, target)
    return read_dynamic(spark, target)


@_query
def merge_job(spark: SparkSession, d: str) -> DataFrame:
    root = work_dir(spark, "merge")
    return p.merge_job(spark, _samples(spark, d, root, "Info"), f"{root}/Info", MERGED_NAME)


def _merged_sample(spark: SparkSession, d: str) -> str:
    """All groups of two samples, merged."""
    root, sources = _two_samples(spark, d)
    merge_sample(spark, sources, f"{root}/merged")
    return f"{root}/merged"


def _two_samples(spark: SparkSession, d: str) -> tuple[str, list[str]]:
    """A work folder with both samples, of low and of high event numbers."""
    root = work_dir(spark, "merge")
    sources = [f"{root}/{name}" for name in SAMPLES]
    for group in SAMPLE_GROUPS:
        low = F.col(event_key(group)[2]) % 2 == 0
        for source, kept in zip(sources, (low, ~low)):
            write_group(view(spark, d, group).filter(kept), source, group)
    return root, sources


@_query
def merge_sample_twice(spark: SparkSession, d: str) -> DataFrame:
    """Samples merged one after another, and once more both: each row is there once."""
    root, sources = _two_samples(spark, d)
    for some in (sources[1:], sources[:1], sources):
        merge_sample_again(spark, some, f"{root}/merged")
    return read_merged(spark, f"{root}/merged", "GenEvtInfo")


@_query
def merge_sample_target_tags(spark: SparkSession, d: str) -> DataFrame:
    """Rows tagged with the name of the merged sample, whichever they come from."""
    root, sources = _two_samples(spark, d)
    merge_sample(spark, sources, f"{root}/{MERGED_NAME}", ["Muon"], tag="target")
    return spark.read.parquet(f"{root}/{MERGED_NAME}/Muon").select("Muon_evtNum", "Muon_pt", "stype", "snum")


@_query
def merge_sample_tags(spark: SparkSession, d: str) -> DataFrame:
    """Events and muons of the merged sample by the tags stored with them."""
    root = _merged_sample(spark, d)
    counts = [
        spark.read.parquet(f"{root}/{g}").groupBy("stype", "snum").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.lit(g))
        for g in SAMPLE_GROUPS
    ]
    return reduce(DataFrame.unionByName, counts)


@_query
def merge_sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{_merged_sample(spark, d)}/GenEvtInfo")


@_query
def sums_of_root(spark: SparkSession, d: str) -> DataFrame:
    """Sums of all columns of all groups that a folder holds."""
    root = work_dir(spark, "stored")
    for group in SAMPLE_GROUPS:
        write_group(view(spark, d, group), root, group)
    return sum_groups(spark, root).withColumn("total", F.round("total", SUM_DIGITS))


@_query
def provenance_tags(spark: SparkSession, d: str) -> DataFrame:
    # The table's name, whether it is one file or a folder of them.
    table = F.regexp_extract("_metadata.file_path", r"([^/]+)\.parquet", 1)
    return tag_provenance(load(spark, d, "orders"), table).select("o_orderkey", "stype", "snum")


# --- muons and taus ------------------------------------------------------------


@_query
def muon_filter(spark: SparkSession, d: str) -> DataFrame:
    return filter_muon(view(spark, d, "Muon"))


@_query
def muon_filter_tight(spark: SparkSession, d: str) -> DataFrame:
    return filter_muon(view(spark, d, "Muon"), id_bit=2)


@_query
def muon_filter_udf(spark: SparkSession, d: str) -> DataFrame:
    return filter_muon_udf(view(spark, d, "Muon"))


@_query
def muon_leading(spark: SparkSession, d: str) -> DataFrame:
    return p.leading_muons(view(spark, d, "Muon"))


@_query
def tau_filter(spark: SparkSession, d: str) -> DataFrame:
    return filter_tau(view(spark, d, "Tau"))


@_query
def tau_leading(spark: SparkSession, d: str) -> DataFrame:
    return p.leading_taus(view(spark, d, "Tau"))


# --- electrons -----------------------------------------------------------------


def _electrons(spark: SparkSession, d: str, **flags: bool) -> DataFrame:
    return p.select_electrons(view(spark, d, "Electron"), view(spark, d, "Info"), **flags)


@_query
def electron_filter(spark: SparkSession, d: str) -> DataFrame:
    return _electrons(spark, d)


@_query
def electron_filter_udf_form(spark: SparkSession, d: str) -> DataFrame:
    """The area is a plain number to the function, so electrons without an event fail."""
    return _electrons(spark, d, subtract_pileup=True, need_area=True)


@_query
def electron_filter_pandas_form(spark: SparkSession, d: str) -> DataFrame:
    """The selection of that form; ``rhoEffarea`` follows the SQL rule at the edges of its bins."""
    return _electrons(spark, d, veto_conversions=True)


@_query
def electron_filter_pandas_sql_form(spark: SparkSession, d: str) -> DataFrame:
    return _electrons(spark, d, veto_conversions=True, subtract_pileup=True)


@_query
def electron_leading(spark: SparkSession, d: str) -> DataFrame:
    return p.leading_electrons(view(spark, d, "Electron"), view(spark, d, "Info"))


@_query
def electron_leading_pileup(spark: SparkSession, d: str) -> DataFrame:
    """Each electron is moved once; ``electron_leading_pileup_split`` is the form for hot events."""
    electron, info = view(spark, d, "Electron"), view(spark, d, "Info")
    return p.leading_electrons(electron, info, subtract_pileup=True, by_id=True)


@_query
def electron_leading_pileup_split(spark: SparkSession, d: str) -> DataFrame:
    return p.leading_electrons(view(spark, d, "Electron"), view(spark, d, "Info"), subtract_pileup=True)


@_query
def electron_count(spark: SparkSession, d: str) -> DataFrame:
    return p.electron_count(view(spark, d, "Electron"), view(spark, d, "Info"))


@_query
def electron_pt_range(spark: SparkSession, d: str) -> DataFrame:
    return value_range(electron_leading(spark, d), "Electron_pt")


@_query
def hist_electron_pt(spark: SparkSession, d: str) -> DataFrame:
    return histogram(electron_leading(spark, d), "Electron_pt", 1000)


@_query
def hist_electron_eta(spark: SparkSession, d: str) -> DataFrame:
    return histogram(electron_leading(spark, d), "Electron_eta", 5)


@_query
def hist_electron_pt_dense(spark: SparkSession, d: str) -> DataFrame:
    return histogram(electron_leading(spark, d), "Electron_pt", 1000, dense=True)


@_query
def electron_histograms(spark: SparkSession, d: str) -> DataFrame:
    return p.electron_histograms(view(spark, d, "Electron"), view(spark, d, "Info"))


@_query
def effective_area_lookup(spark: SparkSession, d: str) -> DataFrame:
    value = step_lookup(F.col("Electron_eta"), ELECTRON_AREA).alias("area")
    return view(spark, d, "Electron").select("Electron_evtNum", "Electron_eta", value)


@_query
def step_lookup_range_join(spark: SparkSession, d: str) -> DataFrame:
    electrons = view(spark, d, "Electron").select("Electron_evtNum", "Electron_eta")
    return step_lookup_join(electrons, "Electron_eta", ELECTRON_AREA, "area")


@_query
def electron_leading_sql(spark: SparkSession, d: str) -> DataFrame:
    """The electron analysis as one SQL text over named views."""
    groups = {g: view(spark, d, g) for g in ("Electron", "Info")}
    return run_sql(spark, LEADING_ELECTRONS, **groups)


@_query
def muon_leading_sql(spark: SparkSession, d: str) -> DataFrame:
    return run_sql(spark, LEADING_MUONS, Muon=view(spark, d, "Muon"))


@_query
def jet_selection_sql(spark: SparkSession, d: str) -> DataFrame:
    return run_sql(spark, SELECTED_JETS, AK4Puppi=view(spark, d, "AK4Puppi"))


# --- photons ---------------------------------------------------------------------


@_query
def photon_filter(spark: SparkSession, d: str) -> DataFrame:
    return filter_photon(join_event(view(spark, d, "Photon"), view(spark, d, "Info"), "Photon"))


@_query
def photon_leading(spark: SparkSession, d: str) -> DataFrame:
    return p.leading_photons(view(spark, d, "Photon"), view(spark, d, "Info"))


@_query
def photon_leading_filtered(spark: SparkSession, d: str) -> DataFrame:
    return p.leading_photons(view(spark, d, "Photon"), view(spark, d, "Info"), apply_filter=True)


# --- jets ------------------------------------------------------------------------


@_query
def jet_filter(spark: SparkSession, d: str) -> DataFrame:
    joined = join_event(view(spark, d, "AK4Puppi"), view(spark, d, "Info"), "AK4Puppi")
    spent = ("passfilter", "AK4Puppi_nParticles", "AK4Puppi_nCharged", "AK4Puppi_chEmFrac")
    return filter_jet(joined).drop(*spent)


@_query
def jet_leading(spark: SparkSession, d: str) -> DataFrame:
    return p.leading_jets(view(spark, d, "AK4Puppi"), view(spark, d, "Info"))


@_query
def addvjet_derived(spark: SparkSession, d: str) -> DataFrame:
    return substructure(view(spark, d, "AddCA15Puppi"))


def _zipped(spark: SparkSession, d: str, how: str) -> DataFrame:
    vjet = view(spark, d, "CA15Puppi", stamped=True)
    return zip_rows(vjet, view(spark, d, "AddCA15Puppi", stamped=True), how)


@_query
def vjet_zip(spark: SparkSession, d: str) -> DataFrame:
    return _zipped(spark, d, "inner")


@_query
def vjet_zip_left(spark: SparkSession, d: str) -> DataFrame:
    return _zipped(spark, d, "left")


@_query
def vjet_cut(spark: SparkSession, d: str) -> DataFrame:
    """The selection alone, without the substructure."""
    return filter_vjet(view(spark, d, "CA15Puppi"))


@_query
def vjet_filter(spark: SparkSession, d: str) -> DataFrame:
    return _selected_vjets(spark, d)


@_query
def vjet_filter_aligned_scan(spark: SparkSession, d: str) -> DataFrame:
    """The rows paired by one scan of both groups, instead of a join."""
    path, groups = work_dir(spark, "colgroup"), ("CA15Puppi", "AddCA15Puppi")
    write_arrays(_zipped(spark, d, "inner"), path, *groups)
    return p.select_paired_vjets(read_colgroup(spark, path, *groups))


@_query
def vjet_leading(spark: SparkSession, d: str) -> DataFrame:
    return p.leading_vjets(
        view(spark, d, "CA15Puppi", stamped=True), view(spark, d, "AddCA15Puppi", stamped=True)
    )


@_query
def jet_vjet_join(spark: SparkSession, d: str) -> DataFrame:
    return join_leading(jet_leading(spark, d), vjet_leading(spark, d))


def _jets_with_vjets(spark: SparkSession, d: str, wrap: str = "pi") -> DataFrame:
    return p.jets_with_vjets(
        view(spark, d, "AK4Puppi"), view(spark, d, "Info"), _selected_vjets(spark, d), wrap
    )


@_query
def jet_vjet_deltar(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_jets_with_vjets(spark, d), "mindPhi", "mindFPhi", "deltaR")


@_query
def jet_vjet_deltar_2pi(spark: SparkSession, d: str) -> DataFrame:
    wide = _jets_with_vjets(spark, d, wrap="2pi")
    return _rounded(wide.select(*event_key("AK4Puppi"), "deltaR"), "deltaR")


@_query
def jet_counts(spark: SparkSession, d: str) -> DataFrame:
    found = p.jets(view(spark, d, "AK4Puppi"), view(spark, d, "Info"), _selected_vjets(spark, d))
    return _rounded(found, "mindPhi", "mindFPhi", "deltaR")


@_query
def jet_counts_joined(spark: SparkSession, d: str) -> DataFrame:
    # These rows are one an event, and dealt by event.
    counted = count_under_cuts(_jets_with_vjets(spark, d), "AK4Puppi", p.jet_count_cuts(), salts=1)
    return _rounded(counted, "mindPhi", "mindFPhi", "deltaR")


@_query
def tau_counts(spark: SparkSession, d: str) -> DataFrame:
    """Taus of events with one of high momentum and one of them in the barrel, with both counts."""
    high = F.col("Tau_pt") > TAU_PT
    cuts = {"n_high": high, "n_barrel": high & (F.abs("Tau_eta") < TAU_ETA)}
    return count_under_cuts(view(spark, d, "Tau"), "Tau", cuts)


# --- whole-table aggregates --------------------------------------------------------


@_query
def row_index(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return index_scan_rows(lines)


@_query
def row_index_of_any_table(spark: SparkSession, d: str) -> DataFrame:
    """What the numbers of any table's rows are: each once, from 0 on without gaps."""
    numbered = add_row_index(load(spark, d, "orders").repartition(5, "o_orderkey"))
    return numbered.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_index").alias("least"),
        F.max("_index").alias("largest"),
        F.sum("_index").cast("double").alias("total"),
        F.count_distinct("_index").alias("distinct_numbers"),
    )


@_query
def row_index_of_all_orders(spark: SparkSession, d: str) -> DataFrame:
    """All orders, and whether each has a number of its own from 0 to their count less one."""
    orders = load(spark, d, "orders")
    numbered = add_row_index(orders.repartition(5, "o_orderkey"))
    index, n = F.col("_index"), orders.agg(F.count(F.lit(1))).scalar()
    own = F.count(F.lit(1)).over(Window.partitionBy("_index")) == 1
    return numbered.select("o_orderkey", "o_custkey", ((index >= 0) & (index < n) & own).alias("numbered"))


@_query
def event_count(spark: SparkSession, d: str) -> DataFrame:
    return count_rows(view(spark, d, "GenEvtInfo"), "n_events")


@_query
def sum_of_weights(spark: SparkSession, d: str) -> DataFrame:
    return sum_weights(view(spark, d, "GenEvtInfo"))


@_query
def column_sums_of_groups(spark: SparkSession, d: str) -> DataFrame:
    sums = [column_sums(view(spark, d, g), g) for g in VIEWS]
    return reduce(DataFrame.unionAll, sums).withColumn("total", F.round("total", SUM_DIGITS))


@_query
def exact_sums_of_groups(spark: SparkSession, d: str) -> DataFrame:
    """The doubles nearest to the sums, to the last bit, in whatever order rows are added."""
    return reduce(DataFrame.unionAll, [exact_sums(view(spark, d, g), g) for g in VIEWS])


@_query
def sums_of_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Sums of all datasets of all groups that a folder of column arrays holds."""
    path = work_dir(spark, "colgroup")
    for group in SAMPLE_GROUPS:
        write_arrays(view(spark, d, group), f"{path}/{group.lower()}", group)
    return sum_arrays(spark, path)


@_query
def exact_weight_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums in fixed point, the same in whatever order the tasks finish.

    Values of more than four decimals would be an error.
    """
    return column_sums(view(spark, d, "GenEvtInfo"), "GenEvtInfo", decimals=4)


@_query
def met_preselect(spark: SparkSession, d: str) -> DataFrame:
    return preselect_met(view(spark, d, "Info"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
