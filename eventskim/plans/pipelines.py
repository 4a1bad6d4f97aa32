"""The analyses: from loaded groups to reduced, per-event results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import delta_phi_or, delta_r, forward_delta_phi_or, within
from ..operators import (
    EventBranch,
    combine_events,
    count_rows,
    count_under_cuts,
    filter_electron,
    filter_jet,
    filter_muon,
    filter_photon,
    filter_tau,
    filter_vjet,
    histograms,
    join_event,
    join_event_by_id,
    leading,
    substructure,
    tag_provenance,
    zip_rows,
)
from ..schema import event_key
from ..sources import copy_format, merge_groups, read_dynamic

# ---------------------------------------------------------------------------
# The fields that rank the objects of an event, in order; the muon
# mass; and the cuts of the jet counts.
# ---------------------------------------------------------------------------
MUON_MASS = 0.105658369
JET_FIELDS = ("AK4Puppi_pt", "AK4Puppi_eta", "AK4Puppi_phi", "AK4Puppi_csv")
VJET_FIELDS = (
    "CA15Puppi_pt",
    "CA15Puppi_eta",
    "CA15Puppi_phi",
    "CA15Puppi_mass",
    "CA15Puppi_csv",
    "CA15Puppi_chHadFrac",
    "CA15Puppi_neuHadFrac",
    "CA15Puppi_neuEmFrac",
    "tau21",
    "tau32",
    "mincsv",
    "maxsubcsv",
    "AddCA15Puppi_mass_sd0",
)
MIN_DELTA_R = 1.5
BTAG_ETA = 2.5
BTAG_MIN_CSV = 0.605
ELECTRON_HISTOGRAMS = {"Electron_pt": 1000, "Electron_eta": 5}


def _kinematics(group: str) -> tuple[str, str, str]:
    return f"{group}_pt", f"{group}_eta", f"{group}_phi"


def leading_muons(muon: DataFrame, id_bit: int = 1) -> DataFrame:
    top = leading(filter_muon(muon, id_bit), "Muon", _kinematics("Muon"))
    return top.withColumn("Muon_Mass", F.lit(MUON_MASS))


def leading_taus(tau: DataFrame) -> DataFrame:
    return leading(filter_tau(tau), "Tau", _kinematics("Tau"))


def select_electrons(
    electron: DataFrame,
    info: DataFrame,
    veto_conversions: bool = False,
    subtract_pileup: bool = False,
    need_area: bool = False,
    by_id: bool = False,
) -> DataFrame:
    """Electrons with their event's row, selected; ``by_id`` as in :func:`leading_electrons`."""
    joined = (join_event_by_id if by_id else join_event)(electron, info, "Electron")
    return filter_electron(joined, veto_conversions, subtract_pileup, need_area)


def leading_electrons(electron: DataFrame, info: DataFrame, **flags: bool) -> DataFrame:
    """Leading selected electron of each event.

    Unless pile-up is subtracted nothing here depends on the event table, and a
    maximum is blind to repeats, so Catalyst drops the join. With pile-up, ``by_id``
    moves each electron once, for the join and the reduction, where no event is hot.
    """
    return leading(select_electrons(electron, info, **flags), "Electron", _kinematics("Electron"))


def leading_photons(photon: DataFrame, info: DataFrame, apply_filter: bool = False) -> DataFrame:
    """Leading photon of each event and the number of photons, ``NMedium``.

    The number is of photon-event pairs, as left after a left join, and by
    default of *all* photons. ``apply_filter`` selects photons first.
    """
    fields = _kinematics("Photon")
    if apply_filter:
        selected = filter_photon(join_event(photon, info, "Photon"))
        return leading(selected, "Photon", fields, "NMedium")
    events = combine_events(
        EventBranch("photon", photon, "Photon", fields),
        EventBranch("info", info, "Info", ("evtNum",)),
    ).filter("photon_rows > 0")
    return events.select(*_named_key("Photon"), "photon.*", _pairs("photon").alias("NMedium"))


def _named_key(group: str) -> list:
    return [F.col(e).alias(k) for e, k in zip(event_key("Info"), event_key(group))]


def _pairs(name: str):
    # Rows a left join with the event table yields for the event.
    return F.col(f"{name}_rows") * F.greatest(F.col("info_rows"), F.lit(1))


def select_vjets(vjet: DataFrame, addvjet: DataFrame) -> DataFrame:
    """Wide jets with their substructure row, selected. Both inputs carry row stamps.

    The selection concerns wide jets only, so it acts before the join.
    """
    extra = substructure(addvjet).drop(*event_key("AddCA15Puppi"))
    return filter_vjet(zip_rows(vjet, extra))


def select_paired_vjets(pairs: DataFrame) -> DataFrame:
    """:func:`select_vjets` on rows that a scan of both groups has paired already."""
    return filter_vjet(substructure(pairs)).drop(*event_key("AddCA15Puppi"))


def leading_vjets(vjet: DataFrame, addvjet: DataFrame) -> DataFrame:
    return leading_paired_vjets(select_vjets(vjet, addvjet))


def leading_paired_vjets(selected: DataFrame) -> DataFrame:
    """Leading jet of each event, of those that :func:`select_paired_vjets` gives."""
    return leading(selected, "CA15Puppi", VJET_FIELDS, "N")


def leading_jets(jet: DataFrame, info: DataFrame) -> DataFrame:
    """Leading selected narrow jet of each event, with the direction of its missing energy."""
    events = combine_events(*_jet_branches(jet, info)).filter("jet_rows > 0")
    return events.select(*_named_key("AK4Puppi"), *_jet_columns())


def _jet_branches(jet: DataFrame, info: DataFrame) -> list[EventBranch]:
    return [
        EventBranch("jet", filter_jet(jet), "AK4Puppi", JET_FIELDS),
        EventBranch("info", info, "Info", ("puppETphi",)),
    ]


def _jet_columns() -> list:
    return [F.col("jet.*"), F.col("info.puppETphi"), _pairs("jet").alias("N")]


def jets_with_vjets(
    jet: DataFrame, info: DataFrame, selected_vjets: DataFrame, wrap: str = "pi"
) -> DataFrame:
    """Leading narrow and wide jet of each event, the angle to the missing energy,
    and the distance between the two. Events without a narrow jet are left out.

    ``selected_vjets`` are all of :func:`select_vjets`; they are reduced here, in
    the one aggregation that also reduces the narrow jets and brings in the event.
    """
    events = combine_events(
        *_jet_branches(jet, info),
        EventBranch("vjet", selected_vjets, "CA15Puppi", VJET_FIELDS),
    ).filter("jet_rows > 0")
    found = F.col("vjet_rows") > 0
    vjet_key = [
        F.when(found, F.col(e)).alias(k)
        for e, k in zip(event_key("Info"), event_key("CA15Puppi"))
    ]
    joined = events.select(
        *_named_key("AK4Puppi"),
        *_jet_columns(),
        *vjet_key,
        F.col("vjet.*"),
        F.when(found, F.col("vjet_rows")).alias("N_vjet"),
    )
    met, phi = F.col("puppETphi"), F.col("AK4Puppi_phi")
    return joined.withColumns(
        {
            "mindPhi": delta_phi_or(met, phi),
            "mindFPhi": forward_delta_phi_or(met, phi),
            "deltaR": delta_r(
                F.col("AK4Puppi_eta"), phi, F.col("CA15Puppi_eta"), F.col("CA15Puppi_phi"), wrap
            ),
        }
    )


def jet_count_cuts() -> dict:
    """Cuts counted per event: far from the wide jet; and b-tagged as well."""
    far = F.col("deltaR") > MIN_DELTA_R
    tagged = within(F.col("AK4Puppi_eta"), BTAG_ETA) & (F.col("AK4Puppi_csv") > BTAG_MIN_CSV)
    return {"NdR15": far, "NbtagLdR15": far & tagged}


def jets(jet: DataFrame, info: DataFrame, selected_vjets: DataFrame) -> DataFrame:
    """The full jet analysis: :func:`jets_with_vjets`, then the counts per event.

    The counts are taken after the reduction to one row per event, so they are 1.
    """
    reduced = jets_with_vjets(jet, info, selected_vjets)
    return count_under_cuts(reduced, "AK4Puppi", jet_count_cuts(), one_row_per_event=True)


def electron_count(electron: DataFrame, info: DataFrame) -> DataFrame:
    return count_rows(leading_electrons(electron, info))


def electron_histograms(electron: DataFrame, info: DataFrame) -> DataFrame:
    """Histograms of pt and eta of the leading electrons, both in one pass."""
    return histograms(leading_electrons(electron, info), ELECTRON_HISTOGRAMS)


def merge_job(spark: SparkSession, sources: Sequence[str], target: str, name: str) -> DataFrame:
    """Merge groups into a new one at ``target``; its rows, tagged with the sample name."""
    copy_format(spark, sources[0], target)
    merge_groups(spark, sources, target)
    return tag_provenance(read_dynamic(spark, target), F.lit(name))
