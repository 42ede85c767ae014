"""Session construction and lineage cutting.

Library code never creates its own session; it takes the caller's.  The
helpers here are for tests, the bench and command-line use, plus one rule
that every operator follows when it must materialise an intermediate
result: cut lineage with a *reliable* checkpoint into the directory the
cluster names in ``spark.checkpoint.dir`` (never ``localCheckpoint``, never
a machine-local folder on a real cluster).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
# fixed value of the workload: the widest pivot it allows
PIVOT_MAX_VALUES = 1_000_000


def build_session(
    master: str | None = None,
    app_name: str = "cartlens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session for tests / bench / scripts.

    On a cluster, ``spark-submit`` supplies master, memory and the shared
    checkpoint directory; only the SQL knobs below are set here.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app_name)
        .master(master or f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.pivotMaxValues", str(PIVOT_MAX_VALUES))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2))
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, wiring it into the context.

    Order: the context's directory if already set; else the session's
    ``spark.checkpoint.dir``; else — only in local mode, as in tests — a
    fresh temporary directory.  On a cluster with nothing configured we
    refuse rather than write to a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(_CHECKPOINT_CONF, None) or sc.getConf().get(_CHECKPOINT_CONF)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared, fault-tolerant "
                "folder (HDFS/object store) before running cartlens jobs on a cluster"
            )
        configured = tempfile.mkdtemp(prefix="cartlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, for files that are read back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: the result survives executor loss and its
    lineage (including any non-deterministic row numbering) is frozen."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read
    back.  Unlike a checkpoint it is columnar, so later reads prune columns and,
    with ``partition_by``, whole folders; the planner knows its real size."""
    spark = df.sparkSession
    path = scratch_path(spark, "stored")
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def discard(stored: DataFrame) -> None:
    """Delete the folder of a stored table that nothing reads any more."""
    spark = stored.sparkSession
    for folder in {f[: f.index("/", f.rindex("/stored-") + 1)] for f in stored.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_unused(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of results that nobody holds.  It does so when the
    driver collects them, which by itself may be long after the disks are full."""
    spark._jvm.System.gc()
