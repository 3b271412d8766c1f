"""Session settings the library relies on, and the shared scratch root.

Every operator also passes the options it needs on the reader/writer itself (explicit
schemas, ``partitionOverwriteMode=dynamic``), so it behaves the same inside a session
built by someone else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that make the change-propagation semantics hold on any cluster size.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # partition values are strings in our datasets: never let '007' become 7
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", app: str = "latecomer",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared file system). Only when it is
    unset, as in local tests, do we pick a fresh local folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="latecomer-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_root(spark: SparkSession, label: str = "lake") -> str:
    """A fresh, unique folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{label}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str:
    """``file:/x`` -> ``/x`` (for tests that inspect files)."""
    if uri.startswith("file:"):
        p = uri[len("file:"):]
        while p.startswith("//"):
            p = p[1:]
        return p
    return uri


def stage(df, label: str = "staged", compression: str | None = None):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back:
    lineage is cut (later stages and retries after a lost executor read exactly these
    rows), in one pass, columnar, so later reads still prune columns.
    Returns ``(frame, path)``; the caller may remove ``path`` once done with the frame. ``compression`` names another codec
    than the session's, e.g. ``zstd`` for long texts."""
    spark = df.sparkSession
    path = scratch_root(spark, label)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


def fixed(df):
    """:func:`stage` without the path (the folder lives as long as the checkpoint dir)."""
    return stage(df)[0]


def release(path: str | None, spark) -> None:
    """Remove a staged folder."""
    if path:
        from . import fs
        fs.delete(spark, path)


def scale_conf(input_bytes: int, total_cores: int, executor_memory_gb: float = 16.0,
               cores_per_executor: int = 4, target_partition_mb: int = 256) -> dict:
    """Shuffle and scan sizing for a cluster and an input size.

    * scan splits of ``target_partition_mb`` (fewer, larger tasks at 100 TB);
    * shuffle partitions: enough that each holds about one split, never fewer than twice
      the cores; AQE coalesces down at run time, so this is the upper bound;
    * a partition must fit the execution memory one core gets (about half the heap split
      across the executor's cores), so the target shrinks on small executors;
    * skew: a partition five times the median and above the target is split by AQE.
    """
    per_core_mb = max(32, int(executor_memory_gb * 1024 * 0.5 / max(1, cores_per_executor)))
    part_mb = max(32, min(target_partition_mb, per_core_mb // 2))
    part_bytes = part_mb * 1024 * 1024
    shuffle = max(2 * total_cores, -(-int(input_bytes) // part_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": f"{part_mb}m",
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{part_mb}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{part_mb}m",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
