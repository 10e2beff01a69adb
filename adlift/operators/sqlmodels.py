"""Closed-form models whose fit is a few aggregates.

They give every evaluation, explanation and scoring operator a predictor
that SQL can reproduce exactly, and they are the baselines of the ML models:

* ``LinearOnOne`` — least squares of y on one column (``regr_slope`` /
  ``regr_intercept`` over complete pairs); a missing x is replaced by the
  fitted mean of x.
* ``GroupMean`` — mean of y per category (missing category -> 'missing'),
  the overall mean for a category not seen in fit.
* ``GlobalMean`` — the overall mean of y.

``fit`` runs one aggregate and keeps a fixed-size parameter set (a handful of
numbers, or one per category); ``predict`` is a literal column expression.
Cross-validation of these models needs no refit pass: per-fold sums are
subtracted from the totals (``cv_decomposable``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlift.constants import CATEGORICAL, MISSING_CATEGORY, TARGET
from adlift.operators.joins import join_bounded, join_small

# Largest category count a GroupMean keeps as literals.
MAX_GROUPS = 10_000

LINEAR_TV = "Linear (TV)"
GROUP_MEAN = "Group Mean (Influencer)"
GLOBAL_MEAN = "Global Mean"
SQL_MODELS = [LINEAR_TV, GROUP_MEAN, GLOBAL_MEAN]


@dataclass
class LinearOnOne:
    x: str = "tv"
    y: str = TARGET
    slope: float = 0.0
    intercept: float = 0.0
    mean_x: float = 0.0

    def fit(self, df: DataFrame) -> "LinearOnOne":
        r = df.agg(F.regr_slope(self.y, self.x).alias("b"), F.regr_intercept(self.y, self.x).alias("a"),
                   F.avg(F.when(F.col(self.y).isNotNull(), F.col(self.x))).alias("mx")).first()
        self.slope, self.intercept, self.mean_x = float(r["b"] or 0.0), float(r["a"] or 0.0), float(r["mx"] or 0.0)
        return self

    def predict(self) -> Column:
        return F.lit(self.intercept) + F.lit(self.slope) * F.coalesce(F.col(self.x), F.lit(self.mean_x))


@dataclass
class GroupMean:
    group: str = CATEGORICAL
    y: str = TARGET
    means: dict = field(default_factory=dict)
    overall: float = 0.0

    def key(self) -> Column:
        return F.coalesce(F.col(self.group), F.lit(MISSING_CATEGORY))

    def fit(self, df: DataFrame) -> "GroupMean":
        # one row per category: a bounded result
        rows = df.groupBy(self.key().alias("g")).agg(F.avg(self.y).alias("m")).limit(MAX_GROUPS + 1).collect()
        if len(rows) > MAX_GROUPS:
            raise ValueError(f"{self.group} has more than {MAX_GROUPS} categories; not a categorical feature")
        self.means = {r["g"]: float(r["m"]) for r in rows if r["m"] is not None}
        self.overall = float(df.agg(F.avg(self.y)).first()[0] or 0.0)
        return self

    def predict(self) -> Column:
        e = F.lit(self.overall)
        for g, m in sorted(self.means.items(), reverse=True):
            e = F.when(self.key() == g, F.lit(m)).otherwise(e)
        return e


@dataclass
class GlobalMean:
    y: str = TARGET
    mean: float = 0.0

    def fit(self, df: DataFrame) -> "GlobalMean":
        self.mean = float(df.agg(F.avg(self.y)).first()[0] or 0.0)
        return self

    def predict(self) -> Column:
        return F.lit(self.mean)


def fit_sql_models(train: DataFrame) -> dict:
    return {LINEAR_TV: LinearOnOne().fit(train), GROUP_MEAN: GroupMean().fit(train),
            GLOBAL_MEAN: GlobalMean().fit(train)}


def predictions_long(df: DataFrame, models: dict, ids: list[str], y: str = TARGET) -> DataFrame:
    """``(ids..., model, y_true, y_pred)``: every row scored by every model in
    one pass (one prediction column per model, then an in-stage unpivot)."""
    names = list(models)
    wide = df.select(*ids, F.col(y).alias("y_true"),
                     *[models[m].predict().alias(f"__p{i}") for i, m in enumerate(names)])
    parts = [F.struct(F.lit(m).alias("model"), F.col(f"__p{i}").alias("y_pred")) for i, m in enumerate(names)]
    return wide.select(*ids, "y_true", F.inline(F.array(*parts))).select(*ids, "model", "y_true", "y_pred")


def cv_linear_one(folded: DataFrame, x: str = "tv", y: str = TARGET, fold: str = "fold") -> DataFrame:
    """Cross-validated ``LinearOnOne`` from per-fold sums.

    Pass 1 (groupBy fold): n, sums of x, y, xy, x^2 over complete pairs, and
    the sum/count of x.  Fit for fold k = totals minus fold k (window over the
    k-row table).  Pass 2 scores each fold's rows with its own parameters
    (join on fold with the k-row parameter table) and aggregates RMSE / R2.
    """
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    xx, yy = F.when(pair, F.col(x)), F.when(pair, F.col(y))
    s = folded.groupBy(fold).agg(F.count_if(pair).alias("n"), F.sum(xx).alias("sx"), F.sum(yy).alias("sy"),
                                 F.sum(xx * yy).alias("sxy"), F.sum(xx * xx).alias("sxx"))
    w = Window.partitionBy()
    fit = s.select(fold, *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx")])
    n = F.col("n").cast("double")
    slope = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / (n * F.col("sxx") - F.col("sx") * F.col("sx"))
    params = fit.select(fold, slope.alias("b"), F.col("sx"), F.col("sy"), n.alias("nn")) \
        .select(fold, "b", ((F.col("sy") - F.col("b") * F.col("sx")) / F.col("nn")).alias("a"),
                (F.col("sx") / F.col("nn")).alias("mx"))
    # one parameter row per fold: bounded by construction
    scored = (join_bounded(folded.where(F.col(y).isNotNull()), params, fold)
              .withColumn("y_pred", F.col("a") + F.col("b") * F.coalesce(F.col(x), F.col("mx"))))
    err = F.col(y) - F.col("y_pred")
    return scored.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n_valid"), F.first("b").alias("slope"), F.first("a").alias("intercept"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        r2_expr(F.sum(err * err), F.count(F.lit(1)) * F.var_pop(y)).alias("r2"))


def r2_expr(sse: Column, sst: Column) -> Column:
    """1 - SSE/SST; a constant truth gives 1 when SSE is 0, else 0."""
    return F.when(sst > 0, 1 - sse / sst).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def cv_sql_models(folded: DataFrame, x: str = "tv", group: str = CATEGORICAL, y: str = TARGET,
                  fold: str = "fold") -> DataFrame:
    """Per-fold RMSE / R2 of the three closed-form models, ``(model, fold, n_valid, rmse, r2)``.

    Every fit is "totals minus the held-out fold" of per-fold (and per
    fold x category) sums, so the data is read twice whatever the fold count.
    """
    lin = cv_linear_one(folded, x, y, fold).select(F.lit(LINEAR_TV).alias("model"), fold, "n_valid",
                                                   "rmse", "r2")
    g = F.coalesce(F.col(group), F.lit(MISSING_CATEGORY))
    base = folded.where(F.col(y).isNotNull()).withColumn("__g", g)
    by_fg = base.groupBy(fold, "__g").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"))
    wg = Window.partitionBy("__g")
    fit_g = by_fg.select(fold, "__g", (F.sum("sy").over(wg) - F.col("sy")).alias("sy"),
                         (F.sum("n").over(wg) - F.col("n")).alias("n")) \
        .select(fold, "__g", F.when(F.col("n") > 0, F.col("sy") / F.col("n")).alias("gm"))
    by_f = base.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"))
    w = Window.partitionBy()
    fit_all = by_f.select(fold, ((F.sum("sy").over(w) - F.col("sy"))
                                 / (F.sum("n").over(w) - F.col("n"))).alias("om"))
    scored = join_bounded(join_small(base, fit_g, [fold, "__g"], "left"), fit_all, fold)
    out = []
    for name, pred in ((GROUP_MEAN, F.coalesce("gm", "om")), (GLOBAL_MEAN, F.col("om"))):
        err = F.col(y) - pred
        out.append(scored.groupBy(fold).agg(
            F.count(F.lit(1)).alias("n_valid"), F.sqrt(F.avg(err * err)).alias("rmse"),
            r2_expr(F.sum(err * err), F.count(F.lit(1)) * F.var_pop(y)).alias("r2"))
            .select(F.lit(name).alias("model"), fold, "n_valid", "rmse", "r2"))
    return lin.unionByName(out[0]).unionByName(out[1])


def cv_summary(per_fold: DataFrame) -> DataFrame:
    """Mean CV RMSE and R2 per model."""
    return per_fold.groupBy("model").agg(F.avg("rmse").alias("cv_rmse"), F.avg("r2").alias("cv_r2"),
                                         F.count(F.lit(1)).alias("n_folds"))
