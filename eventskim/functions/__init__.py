"""Column builders. Everything here is a native expression: no Python per row."""

from .identification import (
    electron_cut_flow,
    electron_isolation,
    jet_id,
    muon_id,
    photon_id,
    tau_id,
    within,
)
from .kinematics import (
    csv_max,
    csv_min,
    delta_phi,
    delta_phi_or,
    delta_r,
    forward_delta_phi_or,
    ratio,
)
from .lookup import (
    ELECTRON_AREA,
    PHOTON_AREAS,
    StepTable,
    bin_index,
    effective_area,
    step_lookup,
)

__all__ = [
    "ELECTRON_AREA",
    "PHOTON_AREAS",
    "StepTable",
    "bin_index",
    "csv_max",
    "csv_min",
    "delta_phi",
    "delta_phi_or",
    "delta_r",
    "effective_area",
    "electron_cut_flow",
    "electron_isolation",
    "forward_delta_phi_or",
    "jet_id",
    "muon_id",
    "photon_id",
    "ratio",
    "step_lookup",
    "tau_id",
    "within",
]
