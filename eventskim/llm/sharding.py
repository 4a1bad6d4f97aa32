"""Contiguous shards of near-equal size by the smallest feasible capacity.

Rows of one group stay together. The groups are put in a fixed order, packed into
at most ``2**16`` atomic units plus the few heavy groups, and the smallest capacity
for which a greedy pass needs no more than the wanted shards is found by bisection.
Only the units' sizes, a bounded list, come to the driver.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fixed

UNIT_BITS = 16
HEAVY_PARTS = 8  # a group of at least this part of a fair shard is a unit of its own


def smallest_capacity(sizes: Sequence[int], shards: int) -> int:
    """The least capacity at which the ordered ``sizes`` fit into ``shards`` runs."""
    ends = list(accumulate(sizes, initial=0))

    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = bisect_right(ends, ends[at] + capacity) - 1
            if at == len(sizes):
                return True
        return False

    low = max([0, *sizes, -(-ends[-1] // shards)])
    high = max(low, ends[-1])
    while low < high:
        middle = (low + high) // 2
        if fits(middle):
            high = middle
        else:
            low = middle + 1
    return low


def cut(sizes: Sequence[int], shards: int) -> list[int]:
    """First index of each shard after the first, no shard above the least capacity.

    Among the cuts that the capacity allows, each comes as near as it can to its
    equal part, so that the last shards do not run short.
    """
    capacity, n = smallest_capacity(sizes, shards), len(sizes)
    ends = list(accumulate(sizes, initial=0))
    least = [n]  # the earliest cut after which the rest still fits, from the back
    for _ in range(shards - 1):
        goal = ends[least[-1]] - capacity
        at = bisect_right(ends, goal - 1)
        least.append(at)
    cuts, at = [], 0
    for k in range(1, shards):
        reach = bisect_right(ends, ends[at] + capacity) - 1
        ideal = ends[-1] * k / shards
        near = min(bisect_right(ends, ideal), n)
        if near and ideal - ends[near - 1] <= ends[near] - ideal:
            near -= 1
        at = max(at, least[shards - k], min(near, reach))
        cuts.append(at)
    return cuts


def plan(heavy: Sequence[int], light: Sequence[int], shards: int) -> tuple[list[int], list[int]]:
    """Shard of each heavy group (largest first) and first light unit of each later shard.

    A group as large as what a shard can fairly hold has a shard of its own; the
    others, in order, share the shards that are left.
    """
    alone, rest = 0, sum(heavy) + sum(light)
    while alone < len(heavy) and shards - alone > 1 and heavy[alone] * (shards - alone) >= rest:
        rest -= heavy[alone]
        alone += 1
    others = [*heavy[alone:], *light]
    cuts = cut(others, shards - alone)
    kept = len(heavy) - alone
    of_heavy = [*range(alone), *(alone + bisect_right(cuts, i) for i in range(kept))]
    # Cuts inside the heavy groups come before all light units.
    first = [0] * alone + [max(0, c - kept) for c in cuts]
    return of_heavy, first


def minimax_shards(
    rows: DataFrame, size: Column, group: Sequence[str], order: Sequence[str], shards: int = 40
) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in each).

    Rows that agree in the columns ``group``, NULL being a value like others, share a
    shard. ``size`` must not be negative; NULL counts as 0. Slots follow ``order``
    within hashed parts of a shard. Columns ``shard`` and ``slot`` of the input are
    replaced. An empty input gives no rows. ``rows`` is stored once: pass the columns
    that are needed, without the texts.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    rows = fixed(
        rows.select(
            *kept,
            F.coalesce(size, F.lit(0)).cast("long").alias("__size"),
            F.xxhash64(*group).alias("__group"),
        )
    )
    groups = fixed(rows.groupBy("__group").agg(F.sum("__size").alias("__size"), F.count("*").alias("__rows")))
    total, n = groups.agg(F.sum("__size"), F.sum("__rows")).first()
    total, n = total or 0, n or 0
    # Groups of at least this size: at most shards * HEAVY_PARTS of them.
    least = max(1, -(-total // (shards * HEAVY_PARTS)))
    heavy = groups.filter(F.col("__size") >= least).orderBy(F.desc("__size"), "__group").collect()
    unit = F.shiftrightunsigned("__group", 64 - UNIT_BITS).cast("int")
    light = (
        groups.filter(F.col("__size") < least)
        .groupBy(unit.alias("__unit"))
        .agg(F.sum("__size").alias("__size"))
        .orderBy("__unit")
        .collect()
    )
    of_heavy, first = plan([r["__size"] for r in heavy], [r["__size"] for r in light], shards)
    # The light unit from which each later shard starts; past the last one there is none.
    starts = [light[i]["__unit"] if i < len(light) else 1 << UNIT_BITS for i in first]
    shard = reduce(add, [(unit >= s).cast("int") for s in starts], F.lit(0))
    if heavy:
        known = rows.sparkSession.createDataFrame(
            [(r["__group"], s) for r, s in zip(heavy, of_heavy, strict=True)], "__group long, __heavy int"
        )
        rows = rows.join(F.broadcast(known), "__group", "left")
        shard = F.coalesce("__heavy", shard)
    # The stored rows do not move, so their running number is the same at every reading.
    parts = math.isqrt(n // shards) + 1
    rows = rows.withColumn("__id", F.monotonically_increasing_id()).select(
        *kept, "__id", shard.alias("shard"), F.pmod(F.xxhash64("__id"), F.lit(parts)).alias("__part")
    )
    offsets = (
        rows.groupBy("shard", "__part")
        .count()
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("count").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("count")
    )
    place = F.row_number().over(Window.partitionBy("shard", "__part").orderBy(*order, "__id"))
    return (
        rows.withColumn("__place", place)
        .join(offsets, ["shard", "__part"])
        .select(*kept, "shard", (F.col("__before") + F.col("__place") - 1).alias("slot"))
    )


def op3_sharding(docs: DataFrame, shards: int = 40) -> DataFrame:
    """All documents in shards of near-equal bytes; equal texts share a shard.

    NULL texts have no bytes and are one group. Repeated rows keep a slot each.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        # Two hashes of the text stand for it: equal texts agree in both.
        F.xxhash64("text").alias("text_hash"),
        F.hash("text").alias("text_hash2"),
    )
    placed = minimax_shards(rows, F.col("size"), ["text_hash", "text_hash2"], ["doc_id"], shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
