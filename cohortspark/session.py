"""Session helpers: a configured SparkSession, sizing, and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "cohortspark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE stays on (runtime broadcast of sides that turn out small, skew-join
    splitting, partition coalescing).  The master, the number of shuffle
    partitions and the driver's memory are set only if they are given, here or
    in COHORTSPARK_MASTER and COHORTSPARK_DRIVER_MEMORY, so that what
    spark-submit was told stands.  ``scale_settings`` gives an ``extra`` sized
    for the data.  ``spark.checkpoint.dir`` is never touched.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         # Python call sites in the errors of columns cost more than the plans themselves
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if master := master or os.environ.get("COHORTSPARK_MASTER"):
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory := os.environ.get("COHORTSPARK_DRIVER_MEMORY"):
        b = b.config("spark.driver.memory", memory)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    The context's own folder, or the one that ``spark.checkpoint.dir`` names.
    Where neither is set, a local master (one machine) gets a new temporary
    folder; on a cluster there is no folder that all machines are known to
    share, so that is an error.
    """
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not folder:
        if not is_one_machine(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all "
                             "executors share")
        folder = tempfile.mkdtemp(prefix="cohortspark-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def is_one_machine(master: str) -> bool:
    """Whether driver and executors are one process (local-cluster is not)."""
    return master == "local" or master.startswith("local[")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint into the session's checkpoint folder.

    Used where one intermediate result is read by several branches of a plan
    and all must see the same rows, and to cut long lineages so that lost
    executors do not replay the whole job.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


MAX_REDUCERS = 20_000  # times the map tasks: the driver tracks each pair


def scale_settings(shuffled_bytes: int, total_cores: int,
                   target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Spark settings sized for ``shuffled_bytes``: what is left of the input
    after column pruning and partial aggregation, not the raw files.

    Shuffle partitions stay near ``target_partition_bytes`` (fits in an
    executor slot without spilling much), are at least three waves of the
    cluster's cores and at most MAX_REDUCERS, beyond which partitions grow and
    spill instead; AQE then coalesces small ones and splits skewed ones.
    Input splits are of the same size.
    """
    parts = max(total_cores * 3, -(-shuffled_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(min(parts, max(MAX_REDUCERS, total_cores))),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
