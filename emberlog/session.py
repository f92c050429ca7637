"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings every emberlog job needs (time zone: buckets and ISO text are UTC).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with a repeated key keep the last value, as JavaScript does.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Defaults for a good plan at scale; a cluster may override them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}

# Shuffled bytes that one task reads, where the session names no size. A request of some 60 shuffled bytes costs a tenth of a
# millisecond, so Spark's 64 MB would be more than a minute of work, in fewer tasks than cores.
TASK_BYTES_CONF = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
TASK_BYTES = "8m"


def configure(spark: SparkSession) -> SparkSession:
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    if spark.conf.get(TASK_BYTES_CONF, None) is None:
        spark.conf.set(TASK_BYTES_CONF, TASK_BYTES)
    return spark


def build_session(master: str | None = None, app_name: str = "emberlog",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session for tests and local runs (UI off; a cluster passes its own master)."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {**DEFAULT_CONF, **REQUIRED_CONF, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a folder made here; on a
    cluster a folder of the driver's own disk would be invisible to the executors.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="emberlog-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 * 1024**2) -> dict[str, str]:
    """Settings sized for a job reading ``input_bytes``: scan splits and shuffle
    partitions near ``target_partition_bytes`` each (AQE coalesces shuffle
    partitions that turn out small; explicit range exchanges such as the rank
    and page index use ``spark.sql.shuffle.partitions`` as their count).

    For 100 TB this gives 409,600 shuffle partitions of 256 MiB.
    """
    parts = max(200, -(-int(input_bytes) // int(target_partition_bytes)))
    size = str(int(target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.shuffle.partitions": str(parts),
    }
