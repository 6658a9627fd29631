"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. Broadcasts stay under Spark's own size threshold: no
# operator forces one. AQE coalesces small shuffles and splits skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Do not record the Python line of every column expression: it costs driver time only.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Tasks that call a model must not be run twice on purpose.
    "spark.speculation": "false",
}


def build_session(app_name: str = "gradeloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables, below the cluster's `spark.checkpoint.dir`.

    On a local master without that setting (tests), a temporary folder is used and
    remembered in the session. On a cluster a missing setting is an error, because a
    machine-local folder would not be seen by the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="gradeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
