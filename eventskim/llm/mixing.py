"""Mixing of sources to target weights by pivotal dependent rounding.

Each row is wanted ``target / source size`` times. The whole part is certain; the
fraction is rounded by pairing rows of a source: mass (fraction times size) moves
from one to the other, in a direction drawn so that no expectation changes, until one
of the two is 0 or 1. The other goes on. Rows are folded in chunks, the residuals of
chunks in chunks again, up a tree, until one residual a source is left. A source's
total mass never changes but for that last one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fixed, let, row_hash, uniform

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
CHUNK = 64
#: Equal rows that one task makes of one.
STEP = 1024


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """Target of each source: ``sizes(source, source_size, rows)`` with ``target`` added.

    Sources in code point order, NULL last, weigh ``weights`` in turn. ``share`` times
    all sizes is dealt out by weight; no source gets over ``most`` times its size, and
    what is above goes to the others by weight. One row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * most)
    # Sources are full in the order of cap over weight. With those before a row full,
    # the rest has this level for each unit of weight; it holds if the row is not full.
    full_at = F.col("cap") / F.col("weight")
    by_full = Window.orderBy(full_at, F.col("source").asc_nulls_last())
    ahead = by_full.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_full.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    levels = weighed.select(
        F.row_number().over(by_full).alias("at"),
        ((total * share - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / F.sum("weight").over(behind)).alias("level"),
        full_at.alias("full_at"),
    )
    level = levels.filter(F.col("level") <= F.col("full_at")).agg(F.min_by("level", "at")).first()[0]
    target = F.least("cap", F.col("weight") * float(level)) if level is not None else F.col("cap")
    return weighed.withColumn("target", target.cast("double"))


def _step(state: Column, unit: Column, seed: int) -> Column:
    """Move mass between the residual ``state.cur`` and ``unit`` until one is settled."""

    def moves(a: Column, b: Column) -> Column:
        up = F.least((1 - a["p"]) * a["mass"], b["p"] * b["mass"])
        down = F.least(a["p"] * a["mass"], (1 - b["p"]) * b["mass"])
        return F.struct(up.alias("up"), down.alias("down"), uniform(a["key"], b["key"], F.lit(seed)).alias("u"))

    def settle(a: Column, b: Column, m: Column) -> Column:
        up = F.when(m["up"] >= (1 - a["p"]) * a["mass"], 1.0).otherwise(a["p"] + m["up"] / a["mass"])
        down = F.when(m["down"] >= a["p"] * a["mass"], 0.0).otherwise(a["p"] - m["down"] / a["mass"])
        up_b = F.when(m["up"] >= b["p"] * b["mass"], 0.0).otherwise(b["p"] - m["up"] / b["mass"])
        down_b = F.when(m["down"] >= (1 - b["p"]) * b["mass"], 1.0).otherwise(b["p"] + m["down"] / b["mass"])
        rises = m["u"] * (m["up"] + m["down"]) < m["down"]
        return F.struct(
            F.when(rises, up).otherwise(down).alias("a"), F.when(rises, up_b).otherwise(down_b).alias("b")
        )

    a = state["cur"]

    def finish(p: Column) -> Column:
        done_a = (p["a"] == 0.0) | (p["a"] == 1.0)
        new_a, new_b = a.withField("p", p["a"]), unit.withField("p", p["b"])
        return F.struct(
            F.when(done_a, new_b).otherwise(new_a).alias("cur"),
            F.concat(state["done"], F.array(F.when(done_a, new_a).otherwise(new_b))).alias("done"),
        )

    return let(moves(a, unit), lambda m: let(settle(a, unit, m), finish))


def pivotal_copies(rows: DataFrame, targets: DataFrame, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Copies of ``rows(key, source, size)``: key, source, size, source_size, target, copies, n.

    ``targets`` is the result of :func:`source_targets`. ``n`` rows of equal key, source
    and size have ``copies`` each, the floor or the ceiling of ``target / source_size``;
    such rows are in one or two rows of the result. Each source's ``n * copies * size`` sum
    to its target but for at most half of one row's size. Draws depend on the keys and
    ``seed``, so a rerun agrees.

    Of k equal rows that are wanted p times more, as many as k p has wholes are certain.
    What is left of k p is one row's probability, so that no unit has more mass than a row.
    """
    wanted = (
        rows.groupBy("key", "source", "size")
        .agg(F.count("*").alias("times"))
        .join(
            targets.select(F.col("source").alias("__source"), "source_size", "target", F.col("rows").alias("__rows")),
            F.col("source").eqNullSafe(F.col("__source")),
        )
        .drop("__source")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = wanted.withColumn("base", F.floor(rate))
    more = (rate - F.col("base")) * F.col("times")
    wanted = fixed(wanted.withColumn("certain", F.floor(more)).withColumn("__p", more - F.col("certain")))
    open_ = (F.col("__p") > 0) & (F.col("size") > 0)
    carried = ("key", "size", "times", "source_size", "target", "base", "certain")
    unit = F.struct(
        F.xxhash64("key", F.lit(seed)).alias("draw"),
        F.col("size").cast("double").alias("mass"),
        F.col("__p").alias("p"),
        *carried,
    )
    level = wanted.filter(open_).select(
        "source",
        F.pmod(F.xxhash64("key", "size", F.lit(seed + 1)), F.ceil(F.col("__rows") / chunk)).alias("node"),
        unit.alias("unit"),
    )
    settled = [wanted.filter(~open_).select("source", *carried, F.col("certain").alias("more"))]

    def decided(df: DataFrame, u: str) -> DataFrame:
        more = F.col(f"{u}.certain") + F.col(f"{u}.p").cast("long")
        return df.select("source", *[F.col(f"{u}.{c}").alias(c) for c in carried], more.alias("more"))

    most = targets.agg(F.max("rows")).first()[0] or 0
    nodes = max(1, -(-most // chunk))
    depth = 0
    while True:
        units = F.array_sort(F.collect_list("unit"))
        step_seed = seed + 2 + depth
        done_type = level.schema["unit"].dataType.simpleString()
        folded = level.groupBy("source", "node").agg(units.alias("units")).select(
            "source",
            "node",
            F.aggregate(
                F.slice("units", 2, F.greatest(F.size("units") - 1, F.lit(0))),
                F.struct(F.col("units")[0].alias("cur"), F.array().cast(f"array<{done_type}>").alias("done")),
                lambda state, u: _step(state, u, step_seed),
            ).alias("state"),
        )
        folded = fixed(folded)
        settled.append(decided(folded.select("source", F.explode("state.done").alias("unit")), "unit"))
        if nodes <= 1:
            break
        # The residuals of `chunk` nodes meet in one node of the next level.
        level = folded.select("source", F.floor(F.col("node") / chunk).alias("node"), F.col("state.cur").alias("unit"))
        nodes = -(-nodes // chunk)
        depth += 1
    last = folded.select("source", F.col("state.cur").alias("unit"))
    # The last residual of a source goes to its nearer side.
    last = last.withColumn(
        "unit", F.col("unit").withField("p", (F.col("unit.p") >= 0.5).cast("double"))
    )
    settled.append(decided(last, "unit"))
    every = reduce(DataFrame.unionByName, settled)
    parts = F.array(
        F.struct((F.col("base") + 1).alias("copies"), F.col("more").alias("n")),
        F.struct(F.col("base").alias("copies"), (F.col("times") - F.col("more")).alias("n")),
    )
    kept = ("key", "source", "size", "source_size", "target")
    return every.select(*kept, F.inline(parts)).filter("n > 0")


def repeated(df: DataFrame, n: str, step: int = STEP) -> DataFrame:
    """Each row of ``df`` as often as its column ``n`` says, without that column.

    A row that is wanted more than ``step`` times is dealt out in portions of so many.
    """
    few = df.filter(F.col(n) <= step)
    portions = F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / step))
    many = df.filter(F.col(n) > step).withColumn("__portion", F.explode(portions))
    left = F.least(F.lit(step), F.col(n) - F.col("__portion") * step)
    many = many.withColumn(n, left.cast("long")).repartition("__portion").drop("__portion")
    return reduce(
        DataFrame.unionByName, [part.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))) for part in (few.filter(F.col(n) > 0), many)]
    ).drop(n)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mixed_copies(docs: DataFrame, key: Column, seed: int = 0) -> DataFrame:
    """:func:`pivotal_copies` of ``docs`` (source, text) whose rows ``key`` tells apart.

    Rows of equal key, source and size in words share a row or two of the result.
    """
    rows = fixed(docs.select(key.alias("key"), "source", word_count(F.col("text")).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = fixed(source_targets(fixed(sizes)))
    return pivotal_copies(rows, targets, seed)


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Per document: doc_id, source, size in words, source_size, target and copies.

    Documents are told apart by doc_id and text, also those whose doc_id is NULL or
    another's too; rows that agree in both are rounded one by one all the same. NULL texts
    have size 0; documents of size 0 get the whole part of their source's rate as copies,
    which take no words, or one more. An empty table gives no row.
    """
    key = F.struct("doc_id", row_hash("text").alias("text"))
    found = repeated(mixed_copies(docs.select("doc_id", "source", "text"), key, seed), "n")
    return found.select(F.col("key.doc_id").alias("doc_id"), "source", "size", "source_size", "target", "copies")


def op4_mixing(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of each document; see :func:`mix`."""
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )
