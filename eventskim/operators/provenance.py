"""Tags that say which sample a row came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_provenance(df: DataFrame, name: Column | None = None) -> DataFrame:
    """Add ``stype`` and ``snum``: CRC-32 of the sample type and of the whole name.

    ``name`` defaults to the name of the file a scanned row came from; the sample
    type is its part before the first underscore.
    """
    name = F.col("_metadata.file_name") if name is None else name
    return df.select(
        "*",
        F.crc32(F.substring_index(name, "_", 1).cast("binary")).alias("stype"),
        F.crc32(name.cast("binary")).alias("snum"),
    )
