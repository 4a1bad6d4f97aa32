"""Vectors of a table as packed doubles, and helpers for searches by inner product."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VECTOR_SCHEMA = "vec_id long, vector binary, dim int, square double"


def _pack(scale: float | None, drop_zero: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed, dims, squares = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not len(x) or not np.isfinite(x).all():
                    continue
                if scale is not None:
                    x = np.floor(x * scale)
                    if not np.isfinite(x).all():
                        continue
                if drop_zero and not x.any():
                    continue
                ids.append(i)
                packed.append(x.tobytes())
                dims.append(len(x))
                squares.append(float(x @ x))
            columns = [pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(dims, pa.int32()), pa.array(squares, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "dim", "square"])

    return run


def packed_vectors(df: DataFrame, scale: float | None = None, drop_zero: bool = False) -> DataFrame:
    """``vec_id``, ``vector`` (little-endian doubles), ``dim`` and ``square`` (squared length).

    ``scale`` turns each component x into floor(scale * x). Rows without an id, without
    a vector or components, with NULL or non-finite components (also after scaling), and,
    with ``drop_zero``, without any other component than zero are left out. Rows that agree
    in id and vector are one; different vectors of one id are all kept.
    """
    rows = df.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_pack(scale, drop_zero), VECTOR_SCHEMA)
    return rows.groupBy("vec_id", "vector").agg(F.min("dim").alias("dim"), F.min("square").alias("square"))


def each_length(
    vectors: DataFrame, queries: DataFrame, search: Callable[[DataFrame, DataFrame, int, int, float], DataFrame], schema: str
) -> DataFrame:
    """``search(vectors, queries, dim, rows, largest square)`` for every length of queries, together.

    Vectors are searched among those of their own length.
    """
    asked = {r["dim"] for r in queries.select("dim").distinct().collect()}
    known = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max("square").alias("most")).orderBy("dim").collect()
    parts = [
        search(vectors.filter(F.col("dim") == r["dim"]), queries.filter(F.col("dim") == r["dim"]), r["dim"], r["n"], r["most"])
        for r in known
        if r["dim"] in asked and r["n"] > 1
    ]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], schema)


def unpacked(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """``x`` with a component that gives all vectors the squared length ``most``.

    Distances to a query with a zero there then order the vectors by inner product.
    """
    rest = np.maximum(0.0, most - np.einsum("ij,ij->i", x, x))
    return np.column_stack([x, np.sqrt(rest)])


def ranked(found: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The ``k`` best of each query by the column ``by``, ties to the smaller vec_id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every(n: int) -> Column:
    return F.col("vec_id") % n == 0
