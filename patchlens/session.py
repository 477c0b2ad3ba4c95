"""Session helpers: one place for the configs the engine relies on."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # text stages are CPU-heavy per byte (parsing, tokenising): never let AQE merge a
    # few MB of text into a single task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # source files vary from a few lines to many thousands; keep Arrow batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # conditions on project and bug reach the checkout tree's data source
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "patchlens", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster's ``spark.checkpoint.dir``. On a cluster there is no fallback: a folder
    of one machine would lose checkpoints with its executors. Only where driver and executors are one process
    (master ``local``) a scratch folder is made, and removed when the process ends."""
    d = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("no checkpoint folder: set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="patchlens-scratch-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d
