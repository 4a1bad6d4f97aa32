"""Session settings and shared working storage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale. Adaptive execution merges shuffle partitions to
# the advisory size and splits hot ones. The JVM leaves methods above 8000 bytes
# of bytecode uncompiled, so larger fused stages are better split by Spark.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Columns are built by many small calls; do not look up the caller of each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str, **conf: str) -> SparkSession:
    """A session with :data:`SCALE_CONF`; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


BYTES_PER_SHUFFLE_PARTITION = 256 << 20


def size_shuffle(df: DataFrame) -> int:
    """Set the number of shuffle partitions by what ``df`` reads; returns it.

    Adaptive execution merges partitions that turn out small, but never makes
    more than it is given, and the default of 200 would be far too few for a large
    input. A higher number already set is kept.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    # Sizes are the planner's, after leaving out partitions the filters rule out.
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    wanted = read // BYTES_PER_SHUFFLE_PARTITION + 1
    chosen = max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.shuffle.partitions", str(chosen))
    return chosen


_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Where none is set and all runs on one machine, as in tests, a temporary folder
    stands in. On a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _fallback.get(app) or tempfile.mkdtemp(prefix="eventskim-")
        _fallback[app] = folder
    return folder.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name of its own below :func:`shared_dir`, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="eventskim-")) / package.name
    context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    _shipped.add(context.applicationId)
