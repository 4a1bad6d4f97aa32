"""DataFrame-to-DataFrame operators. All are lazy unless their docstring says so."""

from .aggregates import (
    column_sums,
    count_rows,
    histogram,
    histograms,
    sum_weights,
    value_range,
)
from .events import (
    EventBranch,
    combine_events,
    count_under_cuts,
    join_event,
    join_event_by_id,
    join_leading,
    leading,
)
from .exact import exact_sums
from .filters import (
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
    with_photon_areas,
)
from .provenance import tag_provenance
from .rows import (
    add_row_index,
    check_aligned,
    index_scan_rows,
    misaligned_files,
    stamp_rows,
    zip_rows,
)

__all__ = [
    "EventBranch",
    "add_row_index",
    "check_aligned",
    "column_sums",
    "combine_events",
    "count_rows",
    "count_under_cuts",
    "exact_sums",
    "filter_electron",
    "filter_jet",
    "filter_muon",
    "filter_muon_udf",
    "filter_photon",
    "filter_tau",
    "filter_vjet",
    "histogram",
    "histograms",
    "index_scan_rows",
    "join_event",
    "join_event_by_id",
    "join_leading",
    "leading",
    "misaligned_files",
    "preselect_met",
    "stamp_rows",
    "step_lookup_join",
    "substructure",
    "sum_weights",
    "tag_provenance",
    "value_range",
    "with_photon_areas",
    "zip_rows",
]
