"""Session helpers.

Cluster settings (shuffle partitions, checkpoint folder, memory) belong to
whoever submits the job; these helpers only fill in what is unset, so the
same code runs in tests on ``local[*]`` and on a cluster unchanged.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on; applied only when the session leaves them unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "shelfwise", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_CHECKPOINT_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A folder the program has set on the context is kept.  Only when neither is
    set and the master is local (tests) do we create a private scratch folder;
    on a cluster that is an error, since executors could not share it.
    """
    app = spark.sparkContext.applicationId
    if app in _CHECKPOINT_DIRS:
        return _CHECKPOINT_DIRS[app]
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        path = configured
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    elif not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    else:
        path = tempfile.mkdtemp(prefix="shelfwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(path)
    _CHECKPOINT_DIRS[app] = path
    return path
