"""Data profiling operators: nulls, duplicates, describe, moments, shares,
group statistics, histograms, density, box plots and quantile bands.

All statistics are one or two aggregate passes.  Per-feature statistics use
a long ``(feature, value)`` view built in-stage by ``unpivot``, so grouping is
on a handful of feature names and map-side partial aggregation leaves only
one row per feature per task to shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlift.constants import CATEGORIES, IQR_FACTOR, KEY, TARGET
from adlift.operators.joins import join_bounded, join_small
from adlift.operators.quantiles import grouped_with_quantiles, quantile, scalars


# ---------------------------------------------------------------- row filters
def clean_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows whose target is present (the target is never imputed)."""
    return df.where(F.col(target).isNotNull())


def target_drop_report(df: DataFrame, target: str = TARGET) -> DataFrame:
    """One row: rows read, rows dropped for a missing target, rows kept."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.col(target).isNull()).alias("n_dropped"),
                  F.count(F.col(target)).alias("n_kept"))


def complete_cases(df: DataFrame) -> DataFrame:
    return df.na.drop(how="any")


def long_view(df: DataFrame, cols: list[str], ids: list[str] | None = None) -> DataFrame:
    """``(ids..., feature, value)`` — one row per input row and feature."""
    return df.unpivot(ids or [], cols, "feature", "value")


def feature_order(cols: list[str]) -> Column:
    """Position of ``feature`` in ``cols`` (1-based), for stable ordering."""
    return F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature")).cast("int")


# --------------------------------------------------------------- describe
def schema_profile(df: DataFrame) -> DataFrame:
    """Per column: name, position, type name, non-null count and row count (one pass)."""
    n = F.count(F.lit(1))
    row = df.agg(n.alias("__n"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    dtypes = dict(df.dtypes)
    parts = [F.struct(F.lit(c).alias("feature"), F.lit(i + 1).alias("position"),
                      F.lit(dtypes[c]).alias("dtype"), F.col(c).alias("non_null"),
                      F.col("__n").alias("n_rows"))
             for i, c in enumerate(df.columns)]
    return row.select(F.inline(F.array(*parts)))


def numeric_describe(df: DataFrame, cols: list[str], method: str | None = None) -> DataFrame:
    """count, mean, std (ddof 1), min, q25, median, q75, max per numeric column."""
    v = F.col("value")
    out = grouped_with_quantiles(
        long_view(df.select(*cols), cols), ["feature"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75},
        [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
         F.min(v).alias("min"), F.max(v).alias("max")], method)
    return out.select("feature", "count", "mean", "std", "min", "q25", "median", "q75", "max")


def categorical_describe(df: DataFrame, col: str) -> DataFrame:
    """count, unique, top (most frequent; ties -> smallest label), freq."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.lit(col).alias("feature"),
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by(F.col(col), F.struct(-F.col("n"), F.col(col))).alias("top"),
        F.max("n").alias("freq"),
    )


def null_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: null count and null percentage (rounded to 2)."""
    cols = cols or df.columns
    n = F.count(F.lit(1))
    row = df.agg(n.alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    parts = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_count"),
                      F.round(100.0 * F.col(c) / F.col("__n"), 2).alias("null_pct"))
             for c in cols]
    return row.select(F.inline(F.array(*parts)))


def any_null(cols: list[str]) -> Column:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNull()
    return cond


def null_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows with at least one null, and their percentage."""
    cols = cols or df.columns
    return (df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(any_null(cols)).alias("n_null_rows"))
            .withColumn("pct_null_rows", 100.0 * F.col("n_null_rows") / F.col("n_rows")))


def duplicate_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Extra copies of identical rows over ``cols`` (nulls compare equal).

    Map-side partial aggregation collapses copies inside each task before the
    shuffle, so a value combination holding a third of all rows costs one
    buffer row per task, not a hot reducer.
    """
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__copies"))
    return groups.agg(F.sum("__copies").alias("n_rows"), F.sum(F.col("__copies") - 1).alias("n_duplicates"),
                      F.count(F.lit(1)).alias("n_distinct"))


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bias-corrected skewness G1 and excess kurtosis G2 (the sample estimators).

    Spark's ``skewness``/``kurtosis`` are the population g1/g2; the standard
    corrections turn them into G1/G2.
    """
    v = F.col("value")
    agg = (long_view(df.select(*cols), cols).groupBy("feature")
           .agg(F.count(v).alias("n"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")))
    n = F.col("n").cast("double")
    g1 = F.when(F.col("n") > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(F.col("n") > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return agg.select("feature", "n", g1.alias("skewness"), g2.alias("kurtosis"))


# ------------------------------------------------------------ categories
def category_rank(col: str, order: list[str] = CATEGORIES) -> Column:
    """1-based business-order position of a category (0 when unknown)."""
    return F.array_position(F.array(*[F.lit(c) for c in order]), F.col(col)).cast("int")


def category_share(df: DataFrame, col: str) -> DataFrame:
    """Counts per non-null category, share in % (rounded 1), and the min/max share.

    The window runs over the aggregated table (one row per category).
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    w = _whole()
    share = 100.0 * F.col("n") / F.sum("n").over(w)
    return (counts.withColumn("share_pct", F.round(share, 1))
            .withColumn("min_share_pct", F.min("share_pct").over(w))
            .withColumn("max_share_pct", F.max("share_pct").over(w)))


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy()


def group_stats(df: DataFrame, group: str, target: str = TARGET, method: str | None = None) -> DataFrame:
    """mean, median, std, count of ``target`` per group; null group dropped."""
    t = F.col(target)
    out = grouped_with_quantiles(df.where(F.col(group).isNotNull()), [group], target, {"median": 0.5},
                                 [F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"), F.count(t).alias("count")],
                                 method)
    return (out.select(group, "mean", "median", "std", "count")
            .withColumn(f"{group}_rank", category_rank(group)))


def group_means(df: DataFrame, group: str, target: str = TARGET) -> DataFrame:
    """Mean of ``target`` per group; null group dropped."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(target).alias("mean"))


def best_worst_group(stats: DataFrame, group: str) -> DataFrame:
    """Best and worst group by mean and the relative spread best/worst - 1 in %."""
    return stats.agg(
        F.max_by(group, F.struct("mean", F.col(group))).alias("best_group"),
        F.max("mean").alias("best_mean"),
        F.min_by(group, F.struct("mean", F.col(group))).alias("worst_group"),
        F.min("mean").alias("worst_mean"),
    ).withColumn("spread_pct", (F.col("best_mean") / F.col("worst_mean") - 1) * 100)


# ---------------------------------------------------------- distributions
def _range_of(df: DataFrame, col: str):
    """Min and max of ``col``, computed once and inlined as literals."""
    s = scalars(df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")))
    return s["lo"], s["hi"]


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Fixed-width histogram between min and max; the max falls in the last bin;
    empty bins are kept (right join with the ``bins`` bin ids)."""
    lo, hi = _range_of(df, col)
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
    b = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    ids = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (ids.join(counts, "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("bin_lo"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


KDE_BINS = 4096


def kde(df: DataFrame, col: str, grid: int = 100, bins: int = KDE_BINS) -> DataFrame:
    """Gaussian kernel density on ``grid`` evenly spaced points from min to max,
    Scott bandwidth h = std * n^(-1/5), by linear binning and convolution.

    One aggregate deals every row's weight to the two ends of its bin (``bins`` + 1
    rows whatever the table); the kernel is summed over those.  With bins of width d
    a density is off by at most (d / h)^2 / 8 / (h sqrt(2 pi)).
    """
    x = df.where(F.col(col).isNotNull()).select(F.col(col).alias("x"))
    s = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd"),
              F.count(F.lit(1)).alias("n"))
    st = scalars(s)
    lo, hi, sd, n = (st[c] for c in ("lo", "hi", "sd", "n"))
    h = sd * F.pow(n.cast("double"), F.lit(-0.2))
    step, width = (hi - lo) / (grid - 1), (hi - lo) / bins
    t = F.when(width > 0, (F.col("x") - lo) / width).otherwise(F.lit(0.0))
    b = F.least(F.floor(t), F.lit(bins - 1))
    parts = x.select(b.alias("b"), (t - b).alias("f")).groupBy("b").agg(F.count(F.lit(1)).alias("c"), F.sum("f").alias("f"))
    ends = F.array(F.struct(F.col("b").alias("j"), (F.col("c") - F.col("f")).alias("w")),
                   F.struct((F.col("b") + 1).alias("j"), F.col("f").alias("w")))
    binned = parts.select(F.inline(ends)).groupBy("j").agg(F.sum("w").alias("w"))
    pts = binned.select("j", "w", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    z = ((lo + F.col("j") * width) - (lo + F.col("g") * step)) / h
    dens = pts.groupBy("g").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("k"))
    return dens.select(F.col("g").cast("int").alias("point"), (lo + F.col("g") * step).alias("x"),
                       (F.col("k") / (n * h * F.sqrt(F.lit(2 * 3.141592653589793)))).alias("density"))


def box_stats(df: DataFrame, value: str, group: str, method: str | None = None) -> DataFrame:
    """Per group: q1, median, q3, IQR fences, whiskers (extreme in-fence values),
    outlier count.  Pass 1 quantiles per group; pass 2 joins the per-group
    fences back (one row per group; AQE broadcasts it when small)."""
    base = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    v = F.col(value)
    q = (grouped_with_quantiles(base, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [], method)
         .withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("fence_lo", F.col("q1") - IQR_FACTOR * F.col("iqr"))
         .withColumn("fence_hi", F.col("q3") + IQR_FACTOR * F.col("iqr")))
    inside = v.between(F.col("fence_lo"), F.col("fence_hi"))
    agg = (join_small(base, q.select(group, "fence_lo", "fence_hi"), group)
           .groupBy(group)
           .agg(F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
                F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("n")))
    return q.join(agg, group)  # two per-group tables


def outlier_rows(df: DataFrame, value: str, group: str, method: str | None = None) -> DataFrame:
    """Rows outside their group's 1.5*IQR fences (the box-plot outlier points)."""
    base = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    v = F.col(value)
    q = (grouped_with_quantiles(base, [group], value, {"q1": 0.25, "q3": 0.75}, [], method)
         .select(group, (F.col("q1") - IQR_FACTOR * (F.col("q3") - F.col("q1"))).alias("fence_lo"),
                 (F.col("q3") + IQR_FACTOR * (F.col("q3") - F.col("q1"))).alias("fence_hi")))
    return (join_small(base, q, group).where(~v.between(F.col("fence_lo"), F.col("fence_hi")))
            .select(KEY, group, value, "fence_lo", "fence_hi"))


def iqr_outliers(df: DataFrame, cols: list[str], method: str | None = None) -> DataFrame:
    """Per column: q1, q3, IQR, fences, outlier count and % of non-null values."""
    lv = long_view(df.select(*cols), cols).where(F.col("value").isNotNull())
    v = F.col("value")
    q = (grouped_with_quantiles(lv, ["feature"], "value", {"q1": 0.25, "q3": 0.75}, [], method)
         .withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("fence_lo", F.col("q1") - IQR_FACTOR * F.col("iqr"))
         .withColumn("fence_hi", F.col("q3") + IQR_FACTOR * F.col("iqr")))
    # one row per listed column: bounded by construction
    cnt = (join_bounded(lv, q.select("feature", "fence_lo", "fence_hi"), "feature")
           .groupBy("feature")
           .agg(F.count_if((v < F.col("fence_lo")) | (v > F.col("fence_hi"))).alias("n_outliers"),
                F.count(F.lit(1)).alias("n")))
    return (join_bounded(q, cnt, "feature")
            .withColumn("pct_outliers", 100.0 * F.col("n_outliers") / F.col("n")))


def quantile_bands(df: DataFrame, col: str, method: str | None = None) -> DataFrame:
    """Bands Q0-Q25 (low), Q25-Q75 (mid), Q75-Q100 (high) with counts and means,
    plus the overall mean; each row falls in exactly one band."""
    s = grouped_with_quantiles(df, [], col, {"q25": 0.25, "q75": 0.75},
                               [F.min(col).alias("q0"), F.max(col).alias("q100"), F.avg(col).alias("mean")], method)
    st = scalars(s)
    q0, q25, q75, q100, mean = (st[c] for c in ("q0", "q25", "q75", "q100", "mean"))
    v = F.col(col)
    band = F.when(v < q25, "low").when(v <= q75, "mid").otherwise("high")
    lo = F.when(v < q25, q0).when(v <= q75, q25).otherwise(q75)
    hi = F.when(v < q25, q25).when(v <= q75, q75).otherwise(q100)
    return (df.where(v.isNotNull())
            .groupBy(band.alias("band"), lo.alias("band_lo"), hi.alias("band_hi"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("band_mean"))
            .withColumn("overall_mean", mean))


def value_band(value: Column, q25: Column, q75: Column) -> Column:
    return F.when(value < q25, "low").when(value <= q75, "mid").otherwise("high")


def parameter_ranges(df: DataFrame, cols: list[str], method: str | None = None) -> DataFrame:
    """min, max and median (slider default) per parameter."""
    v = F.col("value")
    return grouped_with_quantiles(long_view(df.select(*cols), cols), ["feature"], "value", {"median": 0.5},
                                  [F.min(v).alias("min"), F.max(v).alias("max")], method) \
        .select("feature", "min", "max", "median")


# ----------------------------------------------------------- linked panels
def panels(df: DataFrame, cols: list[str], group: str, target: str, target_range: tuple[float, float], bins: int) -> DataFrame:
    """All panels of a filtered view from one scan (R4): every row is tagged with the (panel,
    group) pairs it belongs to and one aggregate serves them, so a new filter costs one pass.

    ``kpi``: mean budget and target and their ratio; ``group``: target per category;
    ``trend``: line and correlation of the target on each number; ``histogram``: counts in
    ``bins`` equal bins of the filter's own target range (so no pass is needed to find it)."""
    y, lo, width = F.col(target), target_range[0], (target_range[1] - target_range[0]) / bins
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    none = F.lit(None).cast("double")
    bin_ = F.least(F.floor((y - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int").cast("string")

    def tag(panel, grp, x):
        return F.struct(F.lit(panel).alias("panel"), grp.alias("grp"), x.alias("x"))
    tags = [tag("kpi", F.lit("all"), total), tag("group", F.col(group), none), tag("histogram", bin_, none),
            *[tag("trend", F.lit(c), F.col(c)) for c in cols]]
    rows = df.select(y.alias("y"), F.inline(F.array(*tags)))
    x, trend = F.col("x"), F.col("panel") == "trend"
    known = F.count_if(x.isNotNull() & F.col("y").isNotNull()) > 1
    agg = rows.groupBy("panel", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.stddev_samp("y").alias("std_y"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.when(known, F.regr_slope("y", "x")).alias("b"),
        F.when(known, F.regr_intercept("y", "x")).alias("a"), F.when(known, F.corr("x", "y")).alias("c"))
    ratio = F.when(F.col("mean_x") > 0, F.col("mean_y") / F.col("mean_x")).otherwise(F.lit(0.0))
    return agg.select("panel", "grp", "n", "mean_x", "mean_y", "std_y", "min_y", "max_y", F.when(trend, F.col("b")).alias("slope"),
                      F.when(trend, F.col("a")).alias("intercept"), F.when(trend, F.col("c")).alias("r"),
                      F.when(F.col("panel") == "kpi", ratio).alias("roi"))
