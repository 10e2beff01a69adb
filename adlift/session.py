"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "adlift") -> SparkSession:
    """Session tuned for the engine.

    On a cluster ``master`` is left to spark-submit; AQE re-plans joins and
    coalesces small shuffle partitions at run time, and skew-join splitting is
    on so one hot key cannot pin a single task.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("ADLIFT_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_FALLBACK_DIRS: dict = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the platform and only read here; without it
    this raises.  On a local master the SparkContext's checkpoint folder is used, or
    a private temporary folder is created once per application; the setting itself is
    never modified (Spark rejects runtime changes of it).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        app = sc.applicationId
        if app not in _FALLBACK_DIRS:
            have = sc.getCheckpointDir()
            if not have and not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            _FALLBACK_DIRS[app] = have or tempfile.mkdtemp(prefix="adlift-ckpt-")
        d = _FALLBACK_DIRS[app]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written table."""
    return os.path.join(ensure_checkpoint_dir(spark), name)
