"""Relations between columns: correlation matrix, target correlations,
multicollinearity, least-squares trend lines, executive KPIs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlift.constants import MULTICOLLINEARITY_R, TARGET


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long Pearson matrix ``(var1, var2, i1, i2, r, in_lower)``, pairwise-complete.

    One aggregate pass computes the k(k-1)/2 distinct ``corr`` values; the
    symmetric long table is produced in-stage from that single row.
    """
    pairs = list(combinations(range(len(cols)), 2))
    row = df.agg(*[F.corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs],
                 *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                r = F.when(F.col(f"n{i}") > 1, F.lit(1.0))
            else:
                r = F.col(f"c{min(i, j)}_{max(i, j)}")
            parts.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                                  F.lit(i + 1).alias("i1"), F.lit(j + 1).alias("i2"), r.alias("r")))
    return (row.select(F.inline(F.array(*parts)))
            .withColumn("in_lower", F.col("i1") > F.col("i2")))


def target_correlations(corr: DataFrame, target: str = TARGET) -> DataFrame:
    """Correlation of each feature with the target, its absolute value, rank by
    absolute value and the strongest flag (window over k rows)."""
    t = corr.where((F.col("var2") == target) & (F.col("var1") != target))
    w = Window.orderBy(F.desc("abs_r"), "feature")
    return (t.select(F.col("var1").alias("feature"), "r", F.abs("r").alias("abs_r"))
            .withColumn("abs_rank", F.row_number().over(w))
            .withColumn("is_strongest", F.col("abs_rank") == 1))


def multicollinear_pairs(corr: DataFrame, features: list[str],
                         threshold: float = MULTICOLLINEARITY_R) -> DataFrame:
    """Feature pairs i<j whose absolute correlation exceeds the threshold."""
    return (corr.where(F.col("var1").isin(features) & F.col("var2").isin(features)
                       & (F.col("i1") < F.col("i2")) & (F.abs("r") > threshold))
            .select("var1", "var2", "r"))


def trend_line(df: DataFrame, xs: list[str], y: str = TARGET) -> DataFrame:
    """Least-squares line y = slope*x + intercept for each x (rows where both are
    present), R2, count and the line endpoints at min/max x; guarded n > 1."""
    parts = []
    for x in xs:
        parts += [F.regr_slope(y, x).alias(f"{x}__slope"), F.regr_intercept(y, x).alias(f"{x}__intercept"),
                  F.regr_r2(y, x).alias(f"{x}__r2"), F.regr_count(y, x).alias(f"{x}__n"),
                  F.min(F.when(F.col(y).isNotNull(), F.col(x))).alias(f"{x}__xmin"),
                  F.max(F.when(F.col(y).isNotNull(), F.col(x))).alias(f"{x}__xmax")]
    row = df.agg(*parts)
    recs = []
    for x in xs:
        ok = F.col(f"{x}__n") > 1
        slope = F.when(ok, F.col(f"{x}__slope"))
        icpt = F.when(ok, F.col(f"{x}__intercept"))
        recs.append(F.struct(F.lit(x).alias("feature"), slope.alias("slope"), icpt.alias("intercept"),
                             F.when(ok, F.col(f"{x}__r2")).alias("r2"), F.col(f"{x}__n").alias("n"),
                             F.col(f"{x}__xmin").alias("x_min"), F.col(f"{x}__xmax").alias("x_max"),
                             (slope * F.col(f"{x}__xmin") + icpt).alias("y_at_min"),
                             (slope * F.col(f"{x}__xmax") + icpt).alias("y_at_max")))
    return row.select(F.inline(F.array(*recs)))


def total_budget(cols: list[str]):
    """tv + radio + social_media; null when any part is null."""
    expr = F.col(cols[0])
    for c in cols[1:]:
        expr = expr + F.col(c)
    return expr


def kpi_summary(df: DataFrame, budget_cols: list[str], group: str, target: str = TARGET) -> DataFrame:
    """Executive KPIs in one row: campaigns, mean budget, mean sales,
    ROI = mean sales / mean budget (0 when the budget is not positive),
    best group by mean sales, r(first budget, sales)."""
    kpis = df.agg(F.count(F.lit(1)).alias("n_campaigns"),
                  F.avg(total_budget(budget_cols)).alias("mean_budget"),
                  F.avg(target).alias("mean_sales"),
                  F.corr(budget_cols[0], target).alias(f"r_{budget_cols[0]}_{target}"))
    best = (df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(target).alias("m"))
            .agg(F.max_by(group, F.struct("m", F.col(group))).alias("best_group")))
    from adlift.operators.quantiles import scalars
    kpis = kpis.withColumn("best_group", scalars(best)["best_group"])
    roi = F.when(F.col("mean_budget") > 0, F.col("mean_sales") / F.col("mean_budget")).otherwise(0.0)
    return kpis.withColumn("roi", roi)
