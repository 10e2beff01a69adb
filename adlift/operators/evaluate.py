"""Evaluation operators: metrics, residuals, verdicts, reports, champion
selection, leaderboard and radar scores.

Inputs are long prediction tables ``(…, model, split, y_true, y_pred)``.
Metrics are plain aggregates per ``(model, split)`` (partial aggregation, so
the shuffle carries one buffer row per group per task); report-level
operators work on the per-model tables (one row per model).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlift.constants import MAPE_EPS, RADAR_UNSTABLE
from adlift.functions.scalar import gap_r2, gap_rmse_pct, residual_columns, verdict
from adlift.operators.sqlmodels import r2_expr


def regression_metrics(pred: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """n, MAE, RMSE, R2 (1 - SSE / (n * var_pop)), MAPE % with the |y| guard, over the
    rows that have both truth and prediction."""
    pred = pred.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    err = F.col(y) - F.col(p)
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        r2_expr(F.sum(err * err), F.count(F.lit(1)) * F.var_pop(y)).alias("r2"),
        (100 * F.avg(F.abs(err) / F.greatest(F.abs(F.col(y)), F.lit(MAPE_EPS)))).alias("mape"),
    )


def residuals(pred: DataFrame, ids: list[str]) -> DataFrame:
    return pred.select(*ids, "y_true", "y_pred", *residual_columns())


def residual_summary(pred: DataFrame, by: list[str]) -> DataFrame:
    """Residual mean, std (ddof 1), the +-2 sigma band and the joint range of
    truth and prediction (endpoints of the perfect-prediction diagonal), over the rows
    that have both."""
    pred = pred.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    r = F.col("y_true") - F.col("y_pred")
    return (pred.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_residual"),
                 F.stddev_samp(r).alias("std_residual"),
                 F.min(F.least("y_true", "y_pred")).alias("range_lo"),
                 F.max(F.greatest("y_true", "y_pred")).alias("range_hi"))
            .withColumn("band", 2 * F.col("std_residual")))


def evaluation_report(metrics: DataFrame, model: str = "model") -> DataFrame:
    """One row per model: train/test metrics side by side, gaps and verdict.

    The pivot values are given, so Spark plans a single aggregate without a
    distinct-values pass.
    """
    wide = (metrics.groupBy(model).pivot("split", ["train", "test"])
            .agg(F.first("mae").alias("mae"), F.first("rmse").alias("rmse"), F.first("r2").alias("r2"),
                 F.first("mape").alias("mape")))
    return wide.select(
        model,
        F.col("train_mae").alias("mae_train"), F.col("test_mae").alias("mae_test"),
        F.col("train_rmse").alias("rmse_train"), F.col("test_rmse").alias("rmse_test"),
        F.col("train_r2").alias("r2_train"), F.col("test_r2").alias("r2_test"),
        F.col("test_mape").alias("mape_test"),
        gap_r2("train_r2", "test_r2").alias("gap_r2"),
        gap_rmse_pct("train_rmse", "test_rmse").alias("gap_rmse_pct"),
        verdict("train_r2", "test_r2", "train_rmse", "test_rmse").alias("verdict"),
    )


def best_model_per_metric(report: DataFrame, model: str = "model") -> DataFrame:
    """Best by RMSE (min), R2 (max), MAPE (min); champion = best test RMSE.
    Ties go to the smallest model name."""
    return report.agg(
        F.min_by(model, F.struct("rmse_test", model)).alias("best_rmse_model"),
        F.min("rmse_test").alias("best_rmse"),
        F.min_by(model, F.struct(-F.col("r2_test"), F.col(model))).alias("best_r2_model"),
        F.max("r2_test").alias("best_r2"),
        F.min_by(model, F.struct("mape_test", model)).alias("best_mape_model"),
        F.min("mape_test").alias("best_mape"),
    ).withColumn("champion", F.col("best_rmse_model"))


def leaderboard(report: DataFrame, model: str = "model") -> DataFrame:
    """Models ranked by test RMSE with per-metric best flags and display text
    (L1, W3, F8).  Windows run over the report (one row per model)."""
    w_rmse = Window.orderBy("rmse_test", model)
    return (report.select(model, "rmse_test", "r2_test", "mape_test", "verdict")
            .withColumn("position", F.row_number().over(w_rmse))
            .withColumn("is_best_rmse", F.rank().over(Window.orderBy("rmse_test")) == 1)
            .withColumn("is_best_r2", F.rank().over(Window.orderBy(F.desc("r2_test"))) == 1)
            .withColumn("is_best_mape", F.rank().over(Window.orderBy("mape_test")) == 1)
            .withColumn("rmse_text", F.format_string("%.3f", "rmse_test"))
            .withColumn("r2_text", F.format_string("%.4f", "r2_test"))
            .withColumn("mape_text", F.format_string("%.2f%%", "mape_test")))


def model_radar(report: DataFrame, model: str = "model") -> DataFrame:
    """Scores normalised to the best model: R2/max R2, min RMSE/RMSE,
    min MAPE/MAPE, stability 1.0 when the verdict is OK else 0.6 (D34)."""
    w = Window.partitionBy()
    return report.select(
        model,
        (F.col("r2_test") / F.max("r2_test").over(w)).alias("r2_score"),
        (F.min("rmse_test").over(w) / F.col("rmse_test")).alias("rmse_score"),
        (F.min("mape_test").over(w) / F.col("mape_test")).alias("mape_score"),
        F.when(F.col("verdict") == "OK", F.lit(1.0)).otherwise(F.lit(RADAR_UNSTABLE)).alias("stability"),
    )


def cv_gain(cv: DataFrame, baseline: str, model: str = "model") -> DataFrame:
    """Relative CV-RMSE gain of the best model over the baseline, with the
    three-way reading (> 5 % clear, > 0 slight, else none) (F13, W4)."""
    from adlift.constants import CV_GAIN_CLEAR_PCT
    s = cv.agg(F.min_by(model, F.struct("cv_rmse", model)).alias("best_model"),
               F.min("cv_rmse").alias("best_cv_rmse"),
               F.max_by(model, F.struct("cv_rmse", model)).alias("worst_model"),
               F.max(F.when(F.col(model) == baseline, F.col("cv_rmse"))).alias("baseline_cv_rmse"))
    gain = (F.col("baseline_cv_rmse") - F.col("best_cv_rmse")) / F.col("baseline_cv_rmse") * 100
    return (s.withColumn("baseline_model", F.lit(baseline)).withColumn("gain_pct", gain)
            .withColumn("reading", F.when(gain > CV_GAIN_CLEAR_PCT, "clear gain")
                        .when(gain > 0, "slight gain").otherwise("no gain")))
