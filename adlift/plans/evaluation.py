"""Registered evaluation queries over the closed-form models (Spark + DuckDB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlift.constants import (
    CV_GAIN_CLEAR_PCT,
    KEY,
    MAPE_EPS,
    OVERFIT_GAP_R2,
    OVERFIT_GAP_RMSE_PCT,
    RADAR_UNSTABLE,
    UNDERFIT_GAP_R2,
    UNDERFIT_GAP_RMSE_PCT,
)
from adlift.functions.scalar import slug
from adlift.operators import evaluate as EV
from adlift.operators import sqlmodels as SM
from adlift.plans.preparation import FOLD_CTES, SPLIT_CTES, fold_table, split_table
from adlift.plans.registry import query

# --------------------------------------------------------------- shared SQL
MODEL_CTES = SPLIT_CTES + f"""
, lin AS (SELECT regr_slope(sales, tv) AS b, regr_intercept(sales, tv) AS a,
                 avg(CASE WHEN sales IS NOT NULL THEN tv END) AS mx FROM sp WHERE split = 'train'),
gm AS (SELECT coalesce(influencer, 'missing') AS g, avg(sales) AS m FROM sp WHERE split = 'train' GROUP BY 1),
gall AS (SELECT avg(sales) AS m FROM sp WHERE split = 'train'),
pw AS (SELECT sp.campaign_id, sp.split, sp.sales AS y_true,
              lin.a + lin.b * coalesce(sp.tv, lin.mx) AS p_lin,
              coalesce(gm.m, gall.m) AS p_gm, gall.m AS p_glob
       FROM sp CROSS JOIN lin CROSS JOIN gall LEFT JOIN gm ON coalesce(sp.influencer, 'missing') = gm.g),
pl AS (SELECT campaign_id, split, '{SM.LINEAR_TV}' AS model, y_true, p_lin AS y_pred FROM pw
       UNION ALL SELECT campaign_id, split, '{SM.GROUP_MEAN}', y_true, p_gm FROM pw
       UNION ALL SELECT campaign_id, split, '{SM.GLOBAL_MEAN}', y_true, p_glob FROM pw)"""

R2_SQL = ("CASE WHEN count(*) * var_pop(y_true) > 0 THEN 1 - sum((y_true - y_pred) * (y_true - y_pred)) / "
          "(count(*) * var_pop(y_true)) WHEN sum((y_true - y_pred) * (y_true - y_pred)) = 0 "
          "THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")

METRIC_CTES = MODEL_CTES + f"""
, mt AS (SELECT model, split, count(*) AS n, avg(abs(y_true - y_pred)) AS mae,
                sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, {R2_SQL} AS r2,
                100 * avg(abs(y_true - y_pred) / greatest(abs(y_true), {MAPE_EPS!r})) AS mape
         FROM pl GROUP BY model, split),
er AS (SELECT t.model, t.mae AS mae_train, s.mae AS mae_test, t.rmse AS rmse_train, s.rmse AS rmse_test,
              t.r2 AS r2_train, s.r2 AS r2_test, s.mape AS mape_test, t.r2 - s.r2 AS gap_r2,
              CASE WHEN t.rmse <> 0 THEN (s.rmse - t.rmse) / t.rmse * 100 END AS gap_rmse_pct,
              CASE WHEN t.r2 - s.r2 > {OVERFIT_GAP_R2} OR (s.rmse - t.rmse) / t.rmse * 100 > {OVERFIT_GAP_RMSE_PCT}
                        OR (t.rmse = 0 AND s.rmse > 0)
                   THEN 'OVERFITTING'
                   WHEN t.r2 - s.r2 < {UNDERFIT_GAP_R2} OR (s.rmse - t.rmse) / t.rmse * 100 < {UNDERFIT_GAP_RMSE_PCT}
                   THEN 'UNDERFITTING' ELSE 'OK' END AS verdict
       FROM mt t JOIN mt s ON t.model = s.model AND t.split = 'train' AND s.split = 'test')"""

REPORT_COLS = ["mae_train", "mae_test", "rmse_train", "rmse_test", "r2_train", "r2_test", "mape_test",
               "gap_r2", "gap_rmse_pct"]


# -------------------------------------------------------------- Spark side
def model_predictions(spark, sf):
    """(campaign_id, split, model, y_true, y_pred) for the closed-form models,
    fitted on the train split."""
    sp = split_table(spark, sf)
    models = SM.fit_sql_models(sp.where(F.col("split") == "train"))
    return SM.predictions_long(sp, models, [KEY, "split"])


def model_report(spark, sf):
    return EV.evaluation_report(EV.regression_metrics(model_predictions(spark, sf), ["model", "split"]))


@query("predictions_long", MODEL_CTES + "\nSELECT * FROM pl", round_cols=["y_pred"])
def predictions_long(spark, sf):
    """X17 + P12: every row scored by every model, long form."""
    return model_predictions(spark, sf)


@query("predictions_wide", MODEL_CTES + """
SELECT campaign_id, split, y_true, p_lin AS linear_tv, p_gm AS group_mean_influencer, p_glob AS global_mean FROM pw""",
       round_cols=["linear_tv", "group_mean_influencer", "global_mean"])
def predictions_wide(spark, sf):
    """P13 + J2: one column per model next to the truth.  The models are column
    expressions over the same rows, so the wide table needs no pivot shuffle."""
    sp = split_table(spark, sf)
    models = SM.fit_sql_models(sp.where(F.col("split") == "train"))
    from adlift.functions.scalar import slug_py
    return sp.select(KEY, "split", F.col("sales").alias("y_true"),
                     *[m.predict().alias(slug_py(name)) for name, m in models.items()])


@query("regression_metrics", METRIC_CTES + "\nSELECT * FROM mt", round_cols=["mae", "rmse", "r2", "mape"])
def regression_metrics(spark, sf):
    """D27 + U2: MAE, RMSE, R2, MAPE per model and split."""
    return EV.regression_metrics(model_predictions(spark, sf), ["model", "split"])


@query("residuals", MODEL_CTES + """
SELECT campaign_id, model, y_true, y_pred, y_true - y_pred AS residual, abs(y_true - y_pred) AS abs_residual,
       CASE WHEN y_true <> 0 THEN abs(y_true - y_pred) / abs(y_true) * 100 END AS pct_error
FROM pl WHERE split = 'test'""", round_cols=["y_pred", "residual", "abs_residual", "pct_error"])
def residuals(spark, sf):
    """F2 + F3 on the test split."""
    pl = model_predictions(spark, sf).where(F.col("split") == "test")
    return EV.residuals(pl, [KEY, "model"])


@query("residual_summary", MODEL_CTES + """
SELECT model, count(*) AS n, avg(y_true - y_pred) AS mean_residual, stddev_samp(y_true - y_pred) AS std_residual,
       min(least(y_true, y_pred)) AS range_lo, max(greatest(y_true, y_pred)) AS range_hi,
       2 * stddev_samp(y_true - y_pred) AS band
FROM pl WHERE split = 'test' GROUP BY model""",
       round_cols=["mean_residual", "std_residual", "range_lo", "range_hi", "band"])
def residual_summary(spark, sf):
    """D28 + D36."""
    return EV.residual_summary(model_predictions(spark, sf).where(F.col("split") == "test"), ["model"])


@query("evaluation_report", METRIC_CTES + "\nSELECT * FROM er", round_cols=REPORT_COLS)
def evaluation_report(spark, sf):
    """train/test metrics, gaps and verdict per model."""
    return model_report(spark, sf)


@query("overfit_verdict", METRIC_CTES + "\nSELECT model, gap_r2, gap_rmse_pct, verdict FROM er",
       round_cols=["gap_r2", "gap_rmse_pct"])
def overfit_verdict(spark, sf):
    """F5."""
    return model_report(spark, sf).select("model", "gap_r2", "gap_rmse_pct", "verdict")


@query("best_model_per_metric", METRIC_CTES + """
SELECT arg_min(model, rmse_test) AS best_rmse_model, min(rmse_test) AS best_rmse,
       arg_max(model, r2_test) AS best_r2_model, max(r2_test) AS best_r2,
       arg_min(model, mape_test) AS best_mape_model, min(mape_test) AS best_mape,
       arg_min(model, rmse_test) AS champion FROM er""", round_cols=["best_rmse", "best_r2", "best_mape"])
def best_model_per_metric(spark, sf):
    """X19 + W1."""
    return EV.best_model_per_metric(model_report(spark, sf))


@query("leaderboard", METRIC_CTES + """
SELECT model, rmse_test, r2_test, mape_test, verdict,
       CAST(row_number() OVER (ORDER BY rmse_test, model) AS INTEGER) AS position,
       rank() OVER (ORDER BY rmse_test) = 1 AS is_best_rmse,
       rank() OVER (ORDER BY r2_test DESC) = 1 AS is_best_r2,
       rank() OVER (ORDER BY mape_test) = 1 AS is_best_mape,
       printf('%.3f', rmse_test) AS rmse_text, printf('%.4f', r2_test) AS r2_text,
       printf('%.2f%%', mape_test) AS mape_text
FROM er""", round_cols=["rmse_test", "r2_test", "mape_test"])
def leaderboard(spark, sf):
    """L1 + W3 + F8."""
    return EV.leaderboard(model_report(spark, sf))


@query("model_radar", METRIC_CTES + f"""
SELECT model, r2_test / max(r2_test) OVER () AS r2_score, min(rmse_test) OVER () / rmse_test AS rmse_score,
       min(mape_test) OVER () / mape_test AS mape_score,
       CASE WHEN verdict = 'OK' THEN CAST(1 AS DOUBLE) ELSE {RADAR_UNSTABLE} END AS stability
FROM er""", round_cols=["r2_score", "rmse_score", "mape_score", "stability"])
def model_radar(spark, sf):
    """D34 + J3."""
    return EV.model_radar(model_report(spark, sf))


@query("model_slug", METRIC_CTES + """
SELECT model, replace(replace(replace(lower(model), ' ', '_'), '(', ''), ')', '') AS slug FROM er""")
def model_slug(spark, sf):
    """file-name slug of each evaluated model."""
    return model_report(spark, sf).select("model", slug("model").alias("slug"))


# ------------------------------------------------------------ CV (closed form)
CV_CTES = FOLD_CTES + f"""
, fd AS (SELECT sp.*, fo.fold FROM sp JOIN fo ON sp.campaign_id = fo.campaign_id),
fs AS (SELECT fold, count_if(tv IS NOT NULL AND sales IS NOT NULL) AS n,
              sum(CASE WHEN tv IS NOT NULL AND sales IS NOT NULL THEN tv END) AS sx,
              sum(CASE WHEN tv IS NOT NULL AND sales IS NOT NULL THEN sales END) AS sy,
              sum(CASE WHEN tv IS NOT NULL AND sales IS NOT NULL THEN tv * sales END) AS sxy,
              sum(CASE WHEN tv IS NOT NULL AND sales IS NOT NULL THEN tv * tv END) AS sxx FROM fd GROUP BY fold),
ft AS (SELECT fold, CAST(sum(n) OVER () - n AS DOUBLE) AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy,
              sum(sxy) OVER () - sxy AS sxy, sum(sxx) OVER () - sxx AS sxx FROM fs),
fb AS (SELECT fold, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, sx, sy, n FROM ft),
fp AS (SELECT fold, b, (sy - b * sx) / n AS a, sx / n AS mx FROM fb),
cvl AS (SELECT fd.fold, count(*) AS n_valid, any_value(b) AS slope, any_value(a) AS intercept,
               sqrt(avg((sales - (a + b * coalesce(tv, mx))) * (sales - (a + b * coalesce(tv, mx))))) AS rmse,
               {R2_SQL.replace('y_true', 'sales').replace('y_pred', '(a + b * coalesce(tv, mx))')} AS r2
        FROM fd JOIN fp ON fd.fold = fp.fold GROUP BY fd.fold),
fgs AS (SELECT fold, coalesce(influencer, 'missing') AS g, count(*) AS n, sum(sales) AS sy FROM fd GROUP BY 1, 2),
fg AS (SELECT fold, g, CASE WHEN sum(n) OVER (PARTITION BY g) - n > 0
                            THEN (sum(sy) OVER (PARTITION BY g) - sy) / (sum(n) OVER (PARTITION BY g) - n) END AS gm
       FROM fgs),
fa AS (SELECT fold, (sum(sy) OVER () - sy) / (sum(n) OVER () - n) AS om
       FROM (SELECT fold, count(*) AS n, sum(sales) AS sy FROM fd GROUP BY fold)),
fsc AS (SELECT fd.fold, sales, coalesce(fg.gm, fa.om) AS p_gm, fa.om AS p_glob FROM fd
        LEFT JOIN fg ON fd.fold = fg.fold AND coalesce(fd.influencer, 'missing') = fg.g
        JOIN fa ON fd.fold = fa.fold),
cvall AS (SELECT '{SM.LINEAR_TV}' AS model, fold, n_valid, rmse, r2 FROM cvl
          UNION ALL
          SELECT '{SM.GROUP_MEAN}', fold, count(*), sqrt(avg((sales - p_gm) * (sales - p_gm))),
                 {R2_SQL.replace('y_true', 'sales').replace('y_pred', 'p_gm')} FROM fsc GROUP BY fold
          UNION ALL
          SELECT '{SM.GLOBAL_MEAN}', fold, count(*), sqrt(avg((sales - p_glob) * (sales - p_glob))),
                 {R2_SQL.replace('y_true', 'sales').replace('y_pred', 'p_glob')} FROM fsc GROUP BY fold),
cvs AS (SELECT model, avg(rmse) AS cv_rmse, avg(r2) AS cv_r2, count(*) AS n_folds FROM cvall GROUP BY model)"""


def _folded(spark, sf):
    return fold_table(spark, sf)


@query("cv_simple_linear", CV_CTES + "\nSELECT * FROM cvl",
       round_cols=["slope", "intercept", "rmse", "r2"])
def cv_simple_linear(spark, sf):
    """5-fold CV of the one-feature linear model from fold sums."""
    return SM.cv_linear_one(_folded(spark, sf))


@query("cv_gain", CV_CTES + f"""
, s AS (SELECT arg_min(model, cv_rmse) AS best_model, min(cv_rmse) AS best_cv_rmse,
               arg_max(model, cv_rmse) AS worst_model,
               max(CASE WHEN model = '{SM.LINEAR_TV}' THEN cv_rmse END) AS baseline_cv_rmse FROM cvs)
SELECT *, '{SM.LINEAR_TV}' AS baseline_model,
       (baseline_cv_rmse - best_cv_rmse) / baseline_cv_rmse * 100 AS gain_pct,
       CASE WHEN (baseline_cv_rmse - best_cv_rmse) / baseline_cv_rmse * 100 > {CV_GAIN_CLEAR_PCT} THEN 'clear gain'
            WHEN (baseline_cv_rmse - best_cv_rmse) / baseline_cv_rmse * 100 > 0 THEN 'slight gain'
            ELSE 'no gain' END AS reading
FROM s""", round_cols=["best_cv_rmse", "baseline_cv_rmse", "gain_pct"])
def cv_gain(spark, sf):
    """F13 + W4: CV gain of the best closed-form model over the linear baseline."""
    cv = SM.cv_summary(SM.cv_sql_models(_folded(spark, sf)))
    return EV.cv_gain(cv, SM.LINEAR_TV)
