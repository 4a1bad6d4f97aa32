"""Time the headline queries; prints one JSON line.

Each query is run to a sink that discards its rows, so every row and column is
computed. The first run of a query warms it up; the best of the others counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame

from eventskim.plans.queries import queries
from eventskim.session import build_session

HEADLINE = (
    "electron_filter",
    "electron_leading",
    "electron_leading_pileup",
    "muon_filter",
    "muon_filter_udf",
    "muon_leading",
    "tau_filter",
    "tau_leading",
    "photon_filter",
    "photon_leading",
    "jet_filter",
    "jet_leading",
    "vjet_cut",
    "vjet_zip",
    "vjet_filter",
    "vjet_leading",
    "jet_vjet_deltar",
    "jet_counts",
    "hist_electron_pt",
    "electron_histograms",
    "sum_of_weights",
    "event_count",
    "column_sums_of_groups",
    "row_index",
    "step_lookup_range_join",
)
REPEATS = 3


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__driver__memory="8g",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = queries()
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        run(found[name](spark, sf_dir))
        took = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            run(found[name](spark, sf_dir))
            took.append(time.perf_counter() - start)
        times[name] = round(min(took), 4)
    print(
        json.dumps(
            {
                "metric": "total best time of headline queries",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
