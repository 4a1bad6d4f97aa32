"""Step-function lookups of a correction factor by pseudorapidity."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class StepTable(NamedTuple):
    """``values[0]`` below ``edges[0]``, ``values[i]`` on ``[edges[i-1], edges[i])``,
    the last value from the last edge up."""

    edges: tuple[float, ...]
    values: tuple[float, ...]


# ---------------------------------------------------------------------------
# Effective areas by signed pseudorapidity.
# ---------------------------------------------------------------------------
ELECTRON_AREA = StepTable(
    (0.8, 1.3, 2.0, 2.2, 2.3, 2.4),
    (0.1752, 0.1862, 0.1411, 0.1534, 0.1903, 0.2243, 0.2687),
)
# charged hadron, neutral hadron, photon
PHOTON_AREAS = (
    StepTable(
        (1.0, 1.479, 2.0, 2.2, 2.3, 2.4),
        (0.0157, 0.0143, 0.0115, 0.0094, 0.0095, 0.0068, 0.0053),
    ),
    StepTable(
        (1.0, 1.479, 2.0, 2.2, 2.3, 2.4),
        (0.0143, 0.0210, 0.0147, 0.0082, 0.0124, 0.0186, 0.0320),
    ),
    StepTable(
        (1.0, 1.479, 2.0, 2.2, 2.3, 2.4),
        (0.0725, 0.0604, 0.0320, 0.0512, 0.0766, 0.0949, 0.1160),
    ),
)


def check_table(table: StepTable) -> None:
    edges, values = table
    if len(values) != len(edges) + 1:
        raise ValueError(f"{len(edges)} edges need {len(edges) + 1} values, got {len(values)}")
    if any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must increase")


def _tree(x: Column, edges: tuple[float, ...], leaves: list[Column]) -> Column:
    # Halve at the middle edge, so a row makes log2(n) comparisons.
    if not edges:
        return leaves[0]
    mid = len(edges) // 2
    return F.when(x < F.lit(edges[mid]), _tree(x, edges[:mid], leaves[: mid + 1])).otherwise(
        _tree(x, edges[mid + 1 :], leaves[mid + 1 :])
    )


def step_lookup(x: Column, table: StepTable) -> Column:
    """The table's value at ``x``; NULL where ``x`` is NULL."""
    check_table(table)
    leaves = [F.lit(float(v)) for v in table.values]
    return F.when(x.isNotNull(), _tree(x, tuple(table.edges), leaves))


def bin_index(x: Column, edges: tuple[float, ...]) -> Column:
    """Number of edges at or below ``x``, that is the index into the values."""
    return reduce(lambda a, b: a + b, [(x >= F.lit(e)).cast("int") for e in edges])


def effective_area(rho: Column, eta: Column, table: StepTable) -> Column:
    """Pile-up energy expected in the cone: density times effective area."""
    return rho * step_lookup(eta, table)
