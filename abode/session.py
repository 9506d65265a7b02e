"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings the library relies on. AQE re-plans joins from measured sizes (a
# sort-merge join whose small side turns out under the threshold becomes a broadcast
# join) and splits skewed shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


# Target bytes per shuffle partition and per scan split on a cluster.
PARTITION_BYTES = 128 * 1024 * 1024


def scale_settings(input_bytes: int, total_cores: int) -> dict:
    """Partition sizing for a run over ``input_bytes`` of parquet on ``total_cores`` cores.

    * Scans are cut into ``PARTITION_BYTES`` splits.
    * Shuffles start from about one partition per ``PARTITION_BYTES`` of input, and at least
      three waves of the cores. AQE then merges small neighbours to the advisory size and
      splits skewed join partitions.
    * Range exchanges (ordered statistics, exact splits) take no fixed count, so they start
      from the same number. At 100 TB that is ~800k partitions of ~128 MB each, so no range
      partition outgrows a task's memory.

    Apply with ``spark.conf.set`` before building the queries; a cluster's own settings win
    where it already sets them.
    """
    n = max(3 * total_cores, -(-int(input_bytes) // PARTITION_BYTES))
    return {
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * PARTITION_BYTES),
    }


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "abode") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's own builder."""
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("ABODE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A directory is only chosen here when the session has none at all (local tests);
    on a cluster the setting must point at shared storage and is taken as is.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="abode-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


_PATHS: list[str] = []  # scratch paths that this driver has given out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    _PATHS.append(f"{base}/abode-{name}-{uuid.uuid4().hex[:12]}")
    return _PATHS[-1]


def release_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables that this driver has written so far; returns how many there were.

    For the end of a job: results that are still to be computed read those tables, so write them first.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    deleted = 0
    while _PATHS:
        path = jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        deleted += bool(path.getFileSystem(conf).delete(path, True))
    return deleted


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint (written to the shared checkpoint folder, survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def materialize(df, name: str, partition_by=None):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Used where several statistics are fitted from one intermediate table: every later
    scan reads the written files (column pruning, ``split`` partition pruning) instead of
    recomputing the joins above it, and the lineage is cut, so a lost executor re-reads
    files rather than re-running the upstream stages.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    writer.parquet(path)
    return spark.read.parquet(path)
