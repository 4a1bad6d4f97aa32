"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fixed

MOST_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(links: DataFrame) -> DataFrame:
    """The smallest neighbour ``__m`` of each ``a``; stored, so that joins can split hot ones."""
    return fixed(links.groupBy("a").agg(F.min("b").alias("__m")).withColumnRenamed("a", "__a"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked to, for all but the roots.

    ``links`` has long columns ``a`` and ``b``; repeated links, links to oneself and
    NULLs have no effect. Alternates large and small stars: each node's larger, then
    smaller, neighbours are linked to the smallest, until only stars are left. The
    number of links never grows, and no node's neighbours are gathered.
    """
    links = fixed(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(links)
    for _ in range(MOST_ROUNDS if state[0] else 0):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        # Large star: the larger neighbours of a node go to the smallest of all, itself included.
        large = (
            both.join(least, F.col("a") == F.col("__a"))
            .filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "__m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        large = fixed(large)
        # Small star: a node and its smaller neighbours go to the smallest of these.
        least = _least(large)
        small = large.join(least, F.col("a") == F.col("__a")).select(
            F.explode(F.array(F.struct("a", F.col("__m").alias("b")), F.struct(F.col("b").alias("a"), F.col("__m").alias("b")))).alias("l")
        )
        links = fixed(small.select("l.a", "l.b").filter("a <> b").distinct())
        before, state = state, _state(links)
        if before == state:
            break
    else:
        if state[0]:
            raise RuntimeError(f"links did not become stars in {MOST_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
