"""Batch entry: ``spark-submit eventskim/job.py --data DIR [DIR ...] --out DIR``.

``merge`` takes the folders of several samples and ``copy`` the folder of one group;
the other analyses take the folder of a sample.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from eventskim.operators import check_aligned, count_rows, sum_weights
from eventskim.plans import pipelines as p
from eventskim.schema import group_schema
from eventskim.session import build_session, size_shuffle
from eventskim.sources import copy_format, merge_sample, read_colgroup, read_group, sum_arrays, sum_groups, write_histogram


class Groups:
    """The groups below a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def load(self, group: str) -> DataFrame:
        return read_group(self.spark, self.root, group)

    def sums(self) -> DataFrame:
        return sum_groups(self.spark, self.root)

    def vjets(self) -> DataFrame:
        vjet, extra = (
            read_group(self.spark, self.root, g, stamped=True)
            for g in ("CA15Puppi", "AddCA15Puppi")
        )
        check_aligned(vjet, extra)
        return p.select_vjets(vjet, extra)


class ColumnArrays(Groups):
    """The groups below a folder of column arrays."""

    def __init__(self, spark: SparkSession, root: str, slices_per_file: int | None = None):
        super().__init__(spark, root)
        self.slices_per_file = slices_per_file

    def _read(self, *groups: str) -> DataFrame:
        # This source reads all columns of its schema, so name the wanted ones.
        columns = [c for g in groups for c in group_schema(g).names]
        return read_colgroup(
            self.spark, self.root, *groups, columns=columns, slices_per_file=self.slices_per_file
        )

    def load(self, group: str) -> DataFrame:
        return self._read(group)

    def sums(self) -> DataFrame:
        return sum_arrays(self.spark, self.root)

    def vjets(self) -> DataFrame:
        return p.select_paired_vjets(self._read("CA15Puppi", "AddCA15Puppi"))


def _electrons(groups: Groups) -> tuple[DataFrame, DataFrame]:
    return groups.load("Electron"), groups.load("Info")


ANALYSES: dict[str, Callable[[Groups], DataFrame]] = {
    "histograms": lambda g: p.electron_histograms(*_electrons(g)),
    "count": lambda g: p.electron_count(*_electrons(g)),
    "electrons": lambda g: p.leading_electrons(*_electrons(g)),
    "muons": lambda g: p.leading_muons(g.load("Muon")),
    "taus": lambda g: p.leading_taus(g.load("Tau")),
    "photons": lambda g: p.leading_photons(g.load("Photon"), g.load("Info")),
    "jets": lambda g: p.jets(g.load("AK4Puppi"), g.load("Info"), g.vjets()),
    "weights": lambda g: sum_weights(g.load("GenEvtInfo")),
    "events": lambda g: count_rows(g.load("GenEvtInfo"), "n_events"),
    "sums": lambda g: g.sums(),
}


def main(argv: Sequence[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--data", required=True, nargs="+", help="folder with one folder per group")
    args.add_argument("--out", required=True, help="folder to create for the result")
    args.add_argument("--analysis", choices=[*ANALYSES, "merge", "copy"], default="histograms")
    args.add_argument("--source", choices=("parquet", "colgroup"), default="parquet")
    args.add_argument("--slices-per-file", type=int, help="for colgroup")
    opt = args.parse_args(argv)
    spark = build_session("eventskim")
    if opt.analysis == "merge":
        merge_sample(spark, opt.data, opt.out)
        return
    if len(opt.data) > 1:
        args.error("only a merge takes several folders")
    [data] = opt.data
    if opt.analysis == "copy":
        copy_format(spark, data, opt.out)
        return
    if opt.source == "parquet":
        groups = Groups(spark, data)
    else:
        groups = ColumnArrays(spark, data, opt.slices_per_file)
    result = ANALYSES[opt.analysis](groups)
    size_shuffle(result)
    if opt.analysis == "histograms":
        write_histogram(result, opt.out)
    else:
        result.write.parquet(opt.out)


if __name__ == "__main__":
    main()
