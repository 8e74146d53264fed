"""Session settings the operators are tuned for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Most keys here are wide and nearly distinct; the small first-level map only adds work to them.
    "spark.sql.codegen.aggregate.map.twolevel.enabled": "false",
    # Merge the events of a busy vault before they are shuffled, as a batch aggregation does.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Many small shuffle partitions, which are joined to the advised size at run time: enough for 100 TB, and few for little.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(app_name: str = "noteskein", master: str | None = None, **extra: str) -> SparkSession:
    """Create a session; on a cluster leave ``master`` unset and let spark-submit decide."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    local = (master or "").startswith("local")
    for key, value in {**SETTINGS, **({} if local else CLUSTER_SETTINGS), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | None = None, **extra: str) -> SparkSession:
    """Single-machine session for tests and the bench."""
    cores = cores or os.cpu_count() or 4
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # A table of one file has one map task, and a local reader would keep all work in few tasks.
        "spark.sql.adaptive.localShuffleReader.enabled": "false",
        **extra,
    }
    return build_session(master=f"local[{cores}]", **settings)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the one the cluster names, else (local only) a new temp folder."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="noteskein-checkpoint-")
    context.setCheckpointDir(folder)
    return folder
