"""Joins and reductions by event.

Two ways to bring the tables of an event together are given. :func:`join_event`
and :func:`join_leading` are plain joins, for when the joined rows are the
result. :func:`combine_events` is for when every table is reduced per event
anyway: it stacks the tables and aggregates once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import event_key

EVENT = event_key("Info")


def _same_event(left: Sequence[str], right: Sequence[str]) -> Column:
    pairs = list(zip(left, right))
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in reversed(pairs)])


def _by_event(df: DataFrame, keys: Sequence[str]):
    # Event number first: sorting compares by the first key before all else, and
    # runs and lumi sections repeat.
    return df.groupBy(*reversed(keys))


def join_event(objects: DataFrame, info: DataFrame, group: str, how: str = "left") -> DataFrame:
    """Attach the event row to each object; NULL keys match NULL keys.

    A hot event only makes the object side large, and that side of a left join
    may be split at run time, which adaptive execution does.
    """
    return objects.join(info, _same_event(event_key(group), EVENT), how)


#: An event as one value, which is never NULL, and a number to deal and sort it by first.
EVENT_ID = ("_hash", "_event")


def with_event_id(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with :data:`EVENT_ID` from its key columns. Ids with NULLs at the same places are equal."""
    event = F.struct(*[F.col(k).alias(e) for k, e in zip(keys, EVENT)])
    return df.withColumns(dict(zip(EVENT_ID, (F.xxhash64(*keys), event))))


def join_event_by_id(objects: DataFrame, info: DataFrame, group: str) -> DataFrame:
    """:func:`join_event` that keeps the id it joins by, so that :func:`leading` need not move rows again.

    The id of a pair is one value that may be compared as it is; null-safe keys are
    compared by two expressions each, which no grouping is dealt by. In return the rows of
    an event meet in one task, where :func:`join_event` lets a hot event be split.
    """
    there = with_event_id(info, EVENT).withColumnsRenamed({c: f"{c}_of_info" for c in EVENT_ID})
    on = reduce(and_, [F.col(c) == F.col(f"{c}_of_info") for c in EVENT_ID])
    return with_event_id(objects, event_key(group)).join(there, on, "left").drop(*[f"{c}_of_info" for c in EVENT_ID])


def leading(
    df: DataFrame, group: str, fields: Sequence[str], count: str | None = None
) -> DataFrame:
    """The object of each event that is greatest by ``fields``, in their order.

    ``count`` names an extra column with the number of objects. The maximum of a
    struct combines before the shuffle, so one row per event and task is sent. Rows of
    :func:`join_event_by_id` are dealt by event already and are not moved.
    """
    keys = event_key(group)
    aggs = [F.max(F.struct(*fields)).alias("_top")]
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    if set(EVENT_ID) <= set(df.columns):
        out = df.groupBy(*EVENT_ID).agg(*aggs)
        named = [F.col(f"_event.{e}").alias(k) for e, k in zip(EVENT, keys)]
    else:
        out, named = _by_event(df, keys).agg(*aggs), list(keys)
    return out.select(*named, "_top.*", *([count] if count else []))


def join_leading(jets: DataFrame, vjets: DataFrame) -> DataFrame:
    """Leading narrow jet with the leading wide jet of its event, if any.

    Both inputs count objects as ``N``; the wide jets' becomes ``N_vjet``.
    """
    vjets = vjets.withColumnRenamed("N", "N_vjet")
    return jets.join(vjets, _same_event(event_key("AK4Puppi"), event_key("CA15Puppi")), "left")


@dataclass(frozen=True)
class EventBranch:
    """One table for :func:`combine_events`: its group and the fields that rank its rows."""

    name: str
    df: DataFrame
    group: str
    fields: tuple[str, ...]


def combine_events(*branches: EventBranch) -> DataFrame:
    """Reduce several tables to one row per event in a single aggregation.

    Output: the event key, and for each branch a struct ``<name>`` holding its
    greatest row by ``fields`` (NULL if it has none) and ``<name>_rows``. Grouping
    treats NULL keys as equal, so this agrees with reducing each table and
    joining the results on null-safe keys. It needs one shuffle where the joins
    need two each. Rows combine before it, hence an event that holds most of the
    rows costs no more than another.
    """
    stacked = [
        b.df.select(
            *[F.col(k).alias(e) for k, e in zip(event_key(b.group), EVENT)],
            F.struct(*b.fields).alias(b.name),
            F.lit(1).cast("long").alias(f"{b.name}_rows"),
        )
        for b in branches
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    aggs = []
    for b in branches:
        aggs.append(F.max(b.name).alias(b.name))
        aggs.append(F.coalesce(F.sum(f"{b.name}_rows"), F.lit(0)).cast("long").alias(f"{b.name}_rows"))
    return _by_event(rows, EVENT).agg(*aggs)


#: Parts that an event's rows are dealt over while they are counted.
SALTS = 16


def count_under_cuts(
    df: DataFrame, group: str, cuts: Mapping[str, Column], one_row_per_event: bool = False, salts: int = SALTS
) -> DataFrame:
    """Count each event's rows under every cut, and attach the counts to its rows.

    Only events with a row under *each* cut remain, and events with a NULL key
    never match. With ``one_row_per_event`` the counts are known from the row itself.

    Otherwise the rows are moved once, by event and one of ``salts`` parts, so that no
    task gets a whole hot event. Both uses of them read that exchange: the counts of the
    parts are added by event, and sent to each part again. Where events are known to be
    small, ``salts=1`` counts in a window, which needs no exchange at all if ``df`` is
    already dealt by event.
    """
    keys = event_key(group)
    known = df.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    if one_row_per_event:
        kept = known.filter(reduce(and_, list(cuts.values())))
        return kept.withColumns({n: F.lit(1).cast("long") for n in cuts})
    if salts < 1:
        raise ValueError("an event has one part at least")
    some = reduce(and_, [F.col(n) > 0 for n in cuts])
    if salts == 1:
        event = Window.partitionBy(*reversed(keys))
        return known.withColumns({n: F.count_if(c).over(event) for n, c in cuts.items()}).filter(some)
    # The part depends on all columns, and so does something that the counts are filtered
    # by: else columns would be pruned from that use's exchange, and it would be another one.
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    salt = F.coalesce(F.pmod(whole, F.lit(salts)).cast("int"), F.lit(0))  # never NULL, or joining would filter it
    dealt = known.withColumn("_salt", salt).repartition(*reversed(keys), "_salt")
    renamed = [F.col(k).alias(f"_{e}") for k, e in zip(keys, EVENT)]
    part = dealt.groupBy(*renamed, "_salt").agg(
        *[F.count_if(c).alias(n) for n, c in cuts.items()], F.max(whole).alias("_whole")
    )
    names = [f"_{e}" for e in EVENT]
    counts = part.groupBy(*reversed(names)).agg(*[F.sum(n).alias(n) for n in cuts], F.max("_whole").alias("_whole"))
    counts = counts.filter(some & F.col("_whole").isNotNull()).drop("_whole")
    counts = counts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = reduce(and_, [F.col(k) == F.col(f"_{e}") for k, e in zip(keys, EVENT)]) & (F.col("_salt") == F.col("_part"))
    return dealt.join(counts, on).drop(*names, "_salt", "_part")
