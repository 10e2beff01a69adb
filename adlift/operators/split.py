"""Deterministic splits, folds and samples driven by a key hash.

The global order of rows is ``(md5(key || salt), key)``.  An exact-size cut
of that order (test share, fold blocks) needs the rank of a row only when
the cut passes through its hash bucket:

1. ``bucket`` = first ``prefix`` hex digits of the hash (16^prefix ordered
   buckets; 65,536 by default — a bound set by the parameter, not the data).
2. One aggregate counts rows per bucket (partial aggregation: each task
   ships at most one row per bucket).  A running sum over the bucket table
   gives each bucket's first global rank.
3. The bucket table is broadcast (size bounded by 16^prefix rows) and
   joined to the rows.  Buckets lying entirely on one side of every cut get
   their label directly; only rows of buckets that straddle a cut are
   shuffled and ranked inside their bucket.

The result equals ``row_number() over (order by hash, key)`` cut at the same
ranks (the DuckDB oracle), without a global sort or a single-task window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlift.constants import KEY, N_FOLDS, SEED, TEST_SIZE
from adlift.functions.scalar import hash_unit, key_hash_hex

SPLIT_SALT = f"#{SEED}"
FOLD_SALT = f"#fold{SEED}"


def _idiv(a: Column, b: Column) -> Column:
    """Integer division of non-negative longs."""
    return ((a - a % b) / b).cast("long")


def test_rank_label(rank: Column, n: Column, test_size: float = TEST_SIZE) -> Column:
    """'test' for the first ceil(test_size * n) ranks, else 'train'."""
    return F.when(rank <= F.ceil(F.lit(test_size) * n), "test").otherwise("train")


def fold_of_rank(rank: Column, n: Column, k: int = N_FOLDS) -> Column:
    """Fold id of a 1-based rank: k contiguous blocks, the first n % k one row larger."""
    r0 = rank - 1
    q = _idiv(n, F.lit(k))
    rem = n % k
    big = rem * (q + 1)
    return F.when(r0 < big, _idiv(r0, q + 1)).otherwise(rem + _idiv(r0 - big, F.greatest(q, F.lit(1)))) \
        .cast("int")


def hash_cut(df: DataFrame, label: Callable[[Column, Column], Column], out: str,
             key: str = KEY, salt: str = SPLIT_SALT, prefix: int = 4) -> DataFrame:
    """Add ``out`` = ``label(rank, n)`` for the hash order; ``label`` must be
    piecewise constant in rank (a cut).  See the module docstring."""
    h = key_hash_hex(F.col(key), salt)
    hashed = df.withColumn("__h", h).withColumn(
        "__b", F.conv(F.substring("__h", 1, prefix), 16, 10).cast("long"))
    counts = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (counts
               .withColumn("__start", F.coalesce(F.sum("__c").over(before), F.lit(0)).cast("long"))
               .withColumn("__n", F.sum("__c").over(Window.partitionBy()).cast("long")))
    buckets = (buckets
               .withColumn("__first", label(F.col("__start") + 1, F.col("__n")))
               .withColumn("__pure", label(F.col("__start") + F.col("__c"), F.col("__n"))
                           == F.col("__first")))
    # bucket table: at most 16^prefix rows, so the broadcast is bounded by the parameter
    joined = hashed.join(F.broadcast(buckets), "__b")
    pure = joined.where(F.col("__pure")).withColumn(out, F.col("__first"))
    in_bucket = Window.partitionBy("__b").orderBy("__h", key)
    edge = (joined.where(~F.col("__pure"))
            .withColumn(out, label(F.col("__start") + F.row_number().over(in_bucket), F.col("__n"))))
    cols = df.columns + [out]
    return pure.select(*cols).unionByName(edge.select(*cols))


def hash_rank(df: DataFrame, key: str = KEY, salt: str = SPLIT_SALT, prefix: int = 4,
              out: str = "rank") -> DataFrame:
    """Full 1-based rank in hash order (every row ranked inside its bucket,
    plus the bucket's start offset).  Used where the rank itself is data,
    e.g. pairing rows of two independent permutations."""
    h = key_hash_hex(F.col(key), salt)
    hashed = df.withColumn("__h", h).withColumn(
        "__b", F.conv(F.substring("__h", 1, prefix), 16, 10).cast("long"))
    counts = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).cast("long").alias("__start"))
    in_bucket = Window.partitionBy("__b").orderBy("__h", key)
    ranked = hashed.withColumn("__r", F.row_number().over(in_bucket))
    return (ranked.join(F.broadcast(starts), "__b")
            .withColumn(out, F.col("__start") + F.col("__r"))
            .select(*df.columns, out))


def train_test_split(df: DataFrame, test_size: float = TEST_SIZE, key: str = KEY,
                     salt: str = SPLIT_SALT) -> DataFrame:
    """Exact-size seeded split: the first ceil(test_size * n) rows of the hash
    order are 'test'.  Adds ``split``."""
    return hash_cut(df, lambda r, n: test_rank_label(r, n, test_size), "split", key, salt)


def kfold(df: DataFrame, k: int = N_FOLDS, key: str = KEY, salt: str = FOLD_SALT) -> DataFrame:
    """Seeded k-fold assignment of the rows of ``df`` (contiguous blocks of the
    hash order, the first n % k folds one row larger).  Adds ``fold``."""
    return hash_cut(df, lambda r, n: fold_of_rank(r, n, k), "fold", key, salt)


def hash_split(df: DataFrame, test_per_mille: int = int(TEST_SIZE * 1000), key: str = KEY,
               salt: str = SPLIT_SALT) -> DataFrame:
    """Approximate split with no aggregate at all: a row is 'test' when its
    hash mod 1000 is below the threshold.  Stable when rows are added."""
    u = hash_unit(F.col(key), salt, 8) % 1000
    return df.withColumn("split", F.when(u < test_per_mille, "test").otherwise("train"))


def hash_sample(df: DataFrame, n: int, key: str = KEY, salt: str = SPLIT_SALT) -> DataFrame:
    """Seeded fixed-size sample of min(n, rows): the n smallest keys in hash
    order (a top-k, planned as TakeOrderedAndProject — no full sort)."""
    return df.orderBy(key_hash_hex(F.col(key), salt), F.col(key)).limit(n)
