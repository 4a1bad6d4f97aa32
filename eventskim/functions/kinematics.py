"""Angles, distances and substructure ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: stands for "no angle".
NO_ANGLE = 999.99


def delta_phi(phi1: Column, phi2: Column) -> Column:
    """Angle between two azimuths, folded into [0, pi]."""
    return F.acos(F.cos(phi1 - phi2))


def delta_phi_or(met_phi: Column, phi: Column, sentinel: float = NO_ANGLE) -> Column:
    """:func:`delta_phi`, or ``sentinel`` where it is NULL or not below it."""
    angle = delta_phi(met_phi, phi)
    return F.when(angle < F.lit(sentinel), angle).otherwise(F.lit(sentinel))


def forward_delta_phi_or(met_phi: Column, phi: Column, sentinel: float = NO_ANGLE) -> Column:
    """:func:`delta_phi_or` for positive ``met_phi`` only, else ``sentinel``."""
    angle = delta_phi(met_phi, phi)
    return F.when((met_phi > 0) & (angle < F.lit(sentinel)), angle).otherwise(F.lit(sentinel))


def delta_r(
    eta1: Column, phi1: Column, eta2: Column, phi2: Column, wrap: str = "pi"
) -> Column:
    """Distance in the eta-phi plane.

    ``wrap="pi"`` moves an azimuth difference outside [-pi, pi) back by pi, which
    is the rule the results to match were made with. ``wrap="2pi"`` is the
    geometric one.
    """
    if wrap not in ("pi", "2pi"):
        raise ValueError("wrap must be 'pi' or '2pi'")
    step = F.lit(math.pi if wrap == "pi" else 2 * math.pi)
    deta, dphi = eta1 - eta2, phi1 - phi2
    wrapped = (
        F.when(dphi >= F.lit(math.pi), dphi - step)
        .when(dphi < F.lit(-math.pi), dphi + step)
        .otherwise(dphi)
    )
    return F.sqrt(deta * deta + wrapped * wrapped)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def csv_min(first: Column, second: Column) -> Column:
    """Lower b-tag score of the two leading subjets."""
    return F.least(first, second)


def csv_max(*scores: Column) -> Column:
    """Highest b-tag score of the subjets."""
    return F.greatest(*scores)
