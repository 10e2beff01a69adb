"""Quantile aggregates with an explicit accuracy choice.

``method="select"`` (the default, ``grouped_quantiles``) is exact and bounded at
every size: a distributed selection per (group, rank) in which no task holds more
than ``SELECT_SMALL`` values of one group.
``method="exact"`` is Spark's ``percentile`` (the same linear interpolation); its
buffers keep one entry per distinct value, so it is for tables known to be small.
``method="approx"`` is ``percentile_approx`` (bounded sketch, rank error
<= n / accuracy), chosen explicitly only.

All methods ignore NULL and NaN values, treat a NULL group as a group, order
infinities as the extremes they are, and give a row with NULL quantiles for a
group without values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sub-ranges counted per selection round, and the window size ranked exactly.
SELECT_BINS = 4096
SELECT_SMALL = 4096


def default_method() -> str:
    """Session-wide choice: ``adlift.quantile.method`` = select (default) | exact | approx."""
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    return s.conf.get("adlift.quantile.method", "select") if s is not None else "select"


def quantile(col: str | Column, p, method: str | None = "exact", accuracy: int = 100000) -> Column:
    """One-aggregate quantile; for the bounded method see ``grouped_with_quantiles``."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    c = F.when(~F.isnan(c), c)
    if method == "approx":
        return F.percentile_approx(c, p, accuracy)
    return F.percentile(c, p)


def median(col: str | Column, method: str = "exact") -> Column:
    return quantile(col, 0.5, method)


def exact_quantiles(df: DataFrame, col: str, probs: list[float], bins: int = SELECT_BINS,
                    small: int = SELECT_SMALL) -> list[float | None]:
    """Exact quantiles of one column as Python floats (a bounded result),
    computed by the distributed selection of ``grouped_quantiles``."""
    rows = {r["p"]: r["q"] for r in grouped_quantiles(df, col, probs, [], bins=bins, small=small).collect()}
    return [rows.get(float(p)) for p in probs]


def scalars(one_row: DataFrame) -> dict:
    """The columns of a one-row aggregate as typed literal Columns.

    One action computes the row (a fixed-size statistic); every later use is
    a literal.  A scalar-subquery Column would instead be planned as a new
    subquery — a new pass over the data — at each place it is referenced."""
    row = one_row.first()
    types = dict(one_row.dtypes)
    return {c: F.lit(row[c]).cast(types[c]) for c in one_row.columns}


def _place(v: str) -> Column:
    """Monotone place of ``v`` in [0, 1] of its target's range: by magnitude while the
    range holds a sign change, zero, or magnitudes 16 apart, then linear; so a few rounds
    reach neighbouring doubles however the values are spread."""
    def clip(c: str) -> Column:
        return F.greatest(F.least(F.col(c), F.lit(1.7e308)), F.lit(-1.7e308)) / 2

    def magnitude(x: Column) -> Column:
        return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + 746))
    lo, hi, x = clip("__lo"), clip("__hi"), clip(v)
    wide = ((lo <= 0) & (hi >= 0)) | (hi > 16 * lo) & (lo > 0) | (lo < 16 * hi) & (hi < 0)
    linear = (x - lo) / (hi - lo)
    return F.when(wide, (magnitude(x) - magnitude(lo)) / (magnitude(hi) - magnitude(lo))).otherwise(linear)


def grouped_quantiles(df: DataFrame, value: str, probs: list[float], groups: list[str] | None = None,
                      bins: int = SELECT_BINS, small: int = SELECT_SMALL) -> DataFrame:
    """Exact linear-interpolation quantiles per group with values: ``(groups..., p, q)``.

    Equal to Spark's ``percentile`` (same interpolation formula) but no task ever
    holds more than ``small`` values of one group.  Each (group, p) needs the order
    statistics at ranks floor((n-1)p) and the next one.  Per round:

    * targets whose range holds <= ``small`` values are ranked exactly in a window
      partitioned by target;
    * for the others the rows of the range are counted per ``bins`` sub-ranges
      (``_place``; infinities in sub-ranges of their own), and a window over that count
      table picks the sub-range that holds the rank; one distinct value there answers
      at once.

    Ranges shrink strictly, so the rounds end by themselves.  Groups are compared as
    structs, so NULL groups match.  The loop state (one row per target) is
    checkpointed each round.
    """
    from adlift.operators.joins import join_small
    from adlift.session import ensure_checkpoint_dir
    from pyspark.sql import Window

    ensure_checkpoint_dir(df.sparkSession)
    groups = list(groups or [])
    g = F.struct(*[F.col(c) for c in groups]) if groups else F.struct(F.lit(0).alias("all"))
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull() & ~F.isnan(v)).select(g.alias("__g"), v.alias("__v"))
    stats = base.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    targets = (stats.select("__g", "__n", "__lo", "__hi", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
               .withColumn("__pos", (F.col("__n") - 1).cast("double") * F.col("p"))
               .withColumn("__k0", F.floor("__pos").cast("long"))
               .withColumn("__k1", F.ceil("__pos").cast("long"))).checkpoint(eager=True)
    fields = ["__g", "__k", "__lo", "__hi", "__below", "__c"]
    solved = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).alias("__val")
    state = targets.select("__g", F.explode(F.array_distinct(F.array("__k0", "__k1"))).alias("__k"), "__lo", "__hi",
                           F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__c")).distinct()
    state = state.select(*fields, solved).checkpoint(eager=True)
    in_range = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
    inf = float("inf")
    while True:
        todo = state.where(F.col("__val").isNull()).select(*fields)
        left = {r["few"]: r["n"] for r in todo.groupBy((F.col("__c") <= small).alias("few")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if not left:
            break
        done = state.where(F.col("__val").isNotNull())
        if left.get(True):
            few = join_small(base, todo.where(F.col("__c") <= small), "__g").where(in_range)
            rank = Window.partitionBy("__g", "__k").orderBy("__v")
            few = few.withColumn("__r", F.row_number().over(rank) - 1 + F.col("__below")).where(F.col("__r") == F.col("__k"))
            done = done.unionByName(few.select(*fields, F.col("__v").alias("__val")))
        if left.get(False):
            rows = join_small(base, todo.where(F.col("__c") > small), "__g").where(in_range)
            b = (F.when(F.col("__v") == -inf, -1).when(F.col("__v") == inf, bins)
                 .otherwise(F.least(_place("__v") * bins, F.lit(float(bins - 1))))).cast("long")
            cnt = rows.groupBy("__g", "__k", "__below", b.alias("__b")).agg(
                F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__mn"), F.max("__v").alias("__mx"))
            w = Window.partitionBy("__g", "__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
            cnt = cnt.withColumn("__before", F.col("__below") + F.coalesce(F.sum("__n").over(w), F.lit(0)))
            pick = cnt.where((F.col("__before") <= F.col("__k")) & (F.col("__k") < F.col("__before") + F.col("__n")))
            pick = pick.select("__g", "__k", F.col("__mn").alias("__lo"), F.col("__mx").alias("__hi"),
                               F.col("__before").alias("__below"), F.col("__n").alias("__c"))
            done = done.unionByName(pick.select(*fields, solved))
        state = done.checkpoint(eager=True)
    vals = state.select("__g", "__k", "__val")
    t = targets.join(vals.select("__g", F.col("__k").alias("__k0"), F.col("__val").alias("__v0")), ["__g", "__k0"]) \
        .join(vals.select("__g", F.col("__k").alias("__k1"), F.col("__val").alias("__v1")), ["__g", "__k1"])
    # Spark's percentile interpolation: (hi - pos) * v0 + (pos - lo) * v1
    q = F.when((F.col("__k0") == F.col("__k1")) | (F.col("__v0") == F.col("__v1")), F.col("__v0")).otherwise(
        (F.col("__k1").cast("double") - F.col("__pos")) * F.col("__v0")
        + (F.col("__pos") - F.col("__k0").cast("double")) * F.col("__v1"))
    return t.select(*[F.col(f"__g.{c}").alias(c) for c in groups], "p", q.alias("q"))


def grouped_with_quantiles(df: DataFrame, groups: list[str], value, named_probs: dict, others: list,
                           method: str | None = None) -> DataFrame:
    """``groupBy(groups).agg(*others, quantiles...)`` with the quantiles named by
    ``named_probs`` ({alias: p}).  exact / approx: one aggregate; select: the
    other aggregates plus ``grouped_quantiles`` joined on the group, null-safe (both one
    row per group)."""
    method = default_method() if method in (None, "session") else method
    if method != "select":
        aggs = [*others, *[quantile(value, p, method).alias(n) for n, p in named_probs.items()]]
        return df.groupBy(*groups).agg(*aggs)
    vname = value if isinstance(value, str) else "__qv"
    src = df if isinstance(value, str) else df.withColumn("__qv", value)
    qt = grouped_quantiles(src, vname, list(named_probs.values()), groups)
    wide = qt.groupBy(*groups).agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(n) for n, p in named_probs.items()])
    if not groups:
        return src.agg(*others, F.count(F.lit(1)).alias("__rows")).join(F.broadcast(wide)).drop("__rows")  # two one-row tables
    agg = src.groupBy(*groups).agg(*others, F.count(F.lit(1)).alias("__rows")).drop("__rows")
    same = F.lit(True)
    for i, c in enumerate(groups):
        wide = wide.withColumnRenamed(c, f"__w{i}")
        same = same & F.col(c).eqNullSafe(F.col(f"__w{i}"))
    return agg.join(wide, same, "left").drop(*[f"__w{i}" for i in range(len(groups))])
