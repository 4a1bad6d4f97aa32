"""Repeated timing of an action, with or without the input kept in memory."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import count_rows, sum_weights
from .sources import read_columns, read_group


class Timing(NamedTuple):
    seconds: float
    value: Any


def timed(df: DataFrame, action: Callable[[DataFrame], Any], repeats: int, persist: bool = False):
    """Run ``action`` on ``df`` ``repeats`` times.

    With ``persist`` the first run also pays for reading and storing, and the
    others measure the stored data.
    """
    if persist:
        df = df.persist()
    try:
        out = []
        for _ in range(repeats):
            start = time.perf_counter()
            value = action(df)
            out.append(Timing(time.perf_counter() - start, value))
        return out
    finally:
        if persist:
            df.unpersist()


def compare(
    df: DataFrame, forms: dict[str, Callable[[DataFrame], DataFrame]], repeats: int = 1
) -> dict[str, list[Timing]]:
    """Time several forms of one operator by the rows they return."""
    return {name: timed(form(df), DataFrame.count, repeats) for name, form in forms.items()}


def event_count_test(spark: SparkSession, root: str, repeats: int = 10) -> list[Timing]:
    """Repeated count of the generator events, kept in memory."""
    gen = read_group(spark, root, "GenEvtInfo")
    return timed(gen, lambda df: count_rows(df).first()["n"], repeats, persist=True)


def weight_sum_test(spark: SparkSession, root: str, repeats: int = 5) -> list[Timing]:
    """Repeated sum of the generator weights, kept in memory: (sum, events)."""
    gen = read_group(spark, root, "GenEvtInfo")
    return timed(gen, lambda df: tuple(sum_weights(df).first()), repeats, persist=True)


def read_and_count_test(spark: SparkSession, path: str, columns: list[str]) -> Timing:
    """Time to read named columns of a group, all values of them, and count the rows."""

    def read(df: DataFrame) -> int:
        seen = Observation()
        observed = df.observe(seen, F.count(F.lit(1)).alias("n"))
        observed.write.format("noop").mode("overwrite").save()
        return seen.get["n"]

    return timed(read_columns(spark, path, columns), read, 1)[0]
