"""Session configuration shared by the library, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library's semantics rely on.  ANSI mode makes casts and division
# strict; UTC keeps timestamp_ntz buckets stable; AQE re-plans joins, coalesces
# small shuffles and splits skewed join partitions at runtime.
DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime broadcast decision for joins against measured aggregate stages.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",
    # Merge session windows inside each task before the shuffle, so one run
    # with a huge number of events does not reach a single reducer unmerged.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def scale_conf(input_bytes: int, partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Shuffle sizing for an input of ``input_bytes``.

    The initial shuffle partition count is chosen so a partition of the
    largest shuffle holds about ``partition_bytes`` (one input split's worth);
    AQE then coalesces small partitions to the advisory size at run time and
    splits skewed ones, so over-provisioning the count is cheap while
    under-provisioning spills.  ``build_session(input_bytes=...)`` applies it.
    """
    parts = max(1, -(-int(input_bytes) // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }


def build_session(
    master: str = "local[*]",
    app_name: str = "planwise",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
    input_bytes: int | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library defaults applied;
    ``input_bytes`` sizes its shuffles for the largest input."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    if input_bytes is not None:
        conf.update(scale_conf(input_bytes))
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    The directory is taken from ``spark.checkpoint.dir`` (or the context's
    checkpoint dir).  Only when neither is set and the master is local is a
    private folder created, as tests do; on a cluster that is an error because
    a machine-local folder is not visible to executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        base = tempfile.mkdtemp(prefix="planwise-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
    base = base.rstrip("/")
    # Spark creates the folder on writing, in whatever file system it is.
    return f"{base}/planwise/{name or 'scratch'}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable: reuse the session's setting."""
    if spark.sparkContext.getCheckpointDir():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = scratch_dir(spark, "checkpoints")
    spark.sparkContext.setCheckpointDir(base)
