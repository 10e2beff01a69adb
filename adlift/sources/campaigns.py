"""Campaign tables: the fixture bridge over the driver tables and raw loads.

Every query starts from one campaign row per order.  The bridge aggregates
``lineitem`` per order in exact decimals (so sums do not depend on task
order), joins ``orders`` and injects nulls by key modulus.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlift.constants import CATEGORIES, KEY, TARGET

CAMPAIGN_SCHEMA = T.StructType([
    T.StructField(KEY, T.LongType(), True),
    T.StructField("tv", T.DoubleType(), True),
    T.StructField("radio", T.DoubleType(), True),
    T.StructField("social_media", T.DoubleType(), True),
    T.StructField("influencer", T.StringType(), True),
    T.StructField(TARGET, T.DoubleType(), True),
])

# Fixed null-injection moduli of the fixture bridge (one per column).
NULL_MOD = {"tv": 113, "radio": 211, "social_media": 307, "influencer": 401, "sales": 503}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null_every(key: Column, mod: int, value: Column) -> Column:
    return F.when(key % mod == 0, F.lit(None)).otherwise(value)


_MATERIALIZED: dict = {}
# re-entrant: building the split table materializes the campaign table first
_LOCK = threading.RLock()


def materialized(spark: SparkSession, name: str, source: str, build, partition_by: list[str] | None = None
                 ) -> DataFrame:
    """Write ``build()`` once per session as Parquet under the shared
    checkpoint folder and read it back (lineage cut, column pruning and
    predicate / partition pushdown for every later scan).  Set
    ``adlift.materialize=false`` to always recompute."""
    if spark.conf.get("adlift.materialize", "true") != "true":
        return build()
    key = (spark.sparkContext.applicationId, name, source)
    with _LOCK:  # concurrent callers in one driver build the table once
        return spark.read.parquet(_materialize(spark, key, name, source, build, partition_by))


def _materialize(spark, key, name, source, build, partition_by) -> str:
    from adlift.session import shared_path
    if key not in _MATERIALIZED:
        tag = hashlib.md5(f"{source}|{spark.sparkContext.applicationId}".encode()).hexdigest()[:16]
        path = shared_path(spark, f"tables/{name}-{tag}")
        w = build().write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        _MATERIALIZED[key] = path
    return _MATERIALIZED[key]


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The campaign table of ``sf_dir`` (built by ``build_campaigns``, materialized once per session)."""
    df = materialized(spark, "campaigns", sf_dir, lambda: build_campaigns(spark, sf_dir))
    return df.select(*CAMPAIGN_SCHEMA.fieldNames())


def build_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One campaign per order: ``campaign_id, tv, radio, social_media, influencer, sales``.

    Plan: column-pruned scan of lineitem -> partial + final hash aggregate on
    ``l_orderkey`` -> join orders on the same key.  The aggregate output is
    already hash-partitioned by order key, so only ``orders`` is shuffled for
    the join (or broadcast when AQE sees it small).
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("p"),
        F.col("l_discount").cast("decimal(4,2)").alias("d"),
        F.col("l_tax").cast("decimal(4,2)").alias("t"),
        F.col("l_quantity").cast("decimal(8,2)").alias("q"),
    )
    per_order = li.groupBy("k").agg(
        F.sum("p").alias("tv_sum"),
        F.sum("q").alias("radio_sum"),
        F.sum(F.col("p") * F.col("d")).alias("sm_sum"),
        F.sum(F.col("p") * (F.lit(1) - F.col("d")) * (F.lit(1) + F.col("t"))).alias("s_sum"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = orders.join(per_order, orders.o_orderkey == per_order.k, "inner")
    key = F.col("o_orderkey")
    cust = F.col("o_custkey") % 4
    category = (F.when(cust == 0, F.lit(CATEGORIES[0]))
                .when(cust == 1, F.lit(CATEGORIES[1]))
                .when(cust == 2, F.lit(CATEGORIES[2]))
                .otherwise(F.lit(CATEGORIES[3])))
    return j.select(
        key.alias(KEY),
        _null_every(key, NULL_MOD["tv"], F.col("tv_sum").cast("double") / 1000).alias("tv"),
        _null_every(key, NULL_MOD["radio"], F.col("radio_sum").cast("double")).alias("radio"),
        _null_every(key, NULL_MOD["social_media"], F.col("sm_sum").cast("double") / 1000)
        .alias("social_media"),
        _null_every(key, NULL_MOD["influencer"], category).alias("influencer"),
        _null_every(key, NULL_MOD["sales"], F.col("s_sum").cast("double") / 1000).alias(TARGET),
    )


def load_raw(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Load a raw campaign table with the explicit campaign schema (no inference).

    CSV headers use the campaign column names; ``NaN`` text becomes NULL.
    """
    reader = spark.read.schema(CAMPAIGN_SCHEMA)
    if fmt == "csv":
        df = reader.option("header", True).option("nanValue", "NaN").csv(path)
    else:
        df = reader.format(fmt).load(path)
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c)
                       if isinstance(CAMPAIGN_SCHEMA[c].dataType, T.DoubleType) else F.col(c)
                       for c in CAMPAIGN_SCHEMA.fieldNames()])
