"""Versioned model registry at rest.

A registered version is one Parquet row (version, model, path, metrics, parameters) in
a folder of its own, ``<root>/registry/version=<n>``.  A model's files are written once,
before its row, and never change.  Readers take the highest version whose folder carries
the writer's ``_SUCCESS`` mark, so a promotion that is cut short leaves the champion as it
was, and its number is not used again.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlift.operators.tuning import Fitted, load_fitted
from adlift.sources.results import MissingInput

SCHEMA = "version int, model string, path string, metrics string, params string"


def _folders(spark: SparkSession, root: str) -> dict[int, bool]:
    """Versions under ``root`` and whether their row was committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/registry")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    out = {}
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if name.startswith("version=") and name[8:].isdigit():
            mark = spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")
            out[int(name[8:])] = bool(fs.exists(mark))
    return out


def promote(spark: SparkSession, root: str, fitted: Fitted, metrics: dict) -> int:
    """Make a saved model the champion: one new row; returns its version.  Of two promotions
    that meet at one number the later takes the next."""
    while True:
        version = max(_folders(spark, root), default=0) + 1
        row = spark.createDataFrame([(version, fitted.name, fitted.path, json.dumps(metrics, sort_keys=True),
                                      json.dumps(fitted.info["best_params"], sort_keys=True))], SCHEMA)
        try:
            row.coalesce(1).write.mode("errorifexists").parquet(f"{root.rstrip('/')}/registry/version={version}")
            return version
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise


def history(spark: SparkSession, root: str) -> DataFrame:
    """All committed versions."""
    done = [f"{root.rstrip('/')}/registry/version={v}" for v, ok in _folders(spark, root).items() if ok]
    return spark.read.schema(SCHEMA).parquet(*done) if done else spark.createDataFrame([], SCHEMA)


def newest(spark: SparkSession, root: str) -> int:
    """The champion's version, 0 without one."""
    return max((v for v, ok in _folders(spark, root).items() if ok), default=0)


def champion(spark: SparkSession, root: str, version: int | None = None) -> tuple[dict, Fitted]:
    """The champion's row (or that of ``version``), metrics parsed, and its model."""
    v = newest(spark, root) if version is None else version
    if not _folders(spark, root).get(v):
        raise MissingInput(f"no committed model version {v or ''} under {root}/registry (promote one first)")
    row = spark.read.schema(SCHEMA).parquet(f"{root.rstrip('/')}/registry/version={v}").where(F.col("version") == v).first().asDict()
    row["metrics"], row["params"] = json.loads(row["metrics"]), json.loads(row["params"])
    return row, load_fitted(spark, row["path"])
