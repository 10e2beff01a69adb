"""Registered explanation queries over the closed-form linear model (Spark + DuckDB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlift.constants import EXPLAIN_SAMPLE_N, FEATURES, KEY, TARGET
from adlift.operators import explain as XP
from adlift.operators import sqlmodels as SM
from adlift.operators.prep import output_columns
from adlift.plans.evaluation import MODEL_CTES, R2_SQL
from adlift.plans.preparation import split_table
from adlift.plans.registry import query

PERM_REPEATS = 10
_FEATS_SQL = ", ".join(f"('{f}')" for f in FEATURES)
_TRANSFORMED = output_columns()


def _test_and_model(spark, sf):
    sp = split_table(spark, sf)
    model = SM.LinearOnOne().fit(sp.where(F.col("split") == "train"))
    return sp, sp.where(F.col("split") == "test"), model


def _predictor(model):
    return lambda d: d.withColumn("y_pred", model.predict())


# ------------------------------------------------------------------ SQL parts
def _feistel_sql(x: str) -> str:
    left, right = f"({x} // side)", f"({x} % side)"
    for i in range(1, 2 * XP.PERM_ROUNDS, 2):
        left, right = right, f"(({left} + ({right} * k[{i}] + k[{i + 1}]) % {XP.PERM_PRIME}) % side)"
    return f"{left} * side + {right}"


def _perm_ctes(jobs: list[tuple[str, int]]) -> str:
    """The test rows, numbered by key, with one feature taken from the row that a walk leads from."""
    values = ", ".join(f"('{f}', {r}, {XP.permutation_keys(f, r)}::BIGINT[])" for f, r in jobs)
    picked = ", ".join(f"CASE WHEN v.feature = '{f}' THEN b.{f} ELSE a.{f} END AS {f}" for f in FEATURES)
    return MODEL_CTES + f"""
, te AS (SELECT * FROM sp WHERE split = 'test'),
nb AS (SELECT te.*, row_number() OVER (ORDER BY campaign_id) - 1 AS nr FROM te),
sz AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM te),
jobs AS (SELECT * FROM (VALUES {values}) AS j(feature, rep, k)),
walk AS (
  WITH RECURSIVE w(nr, feature, rep, k, y) AS (
    SELECT nr, feature, rep, k, {_feistel_sql('nr')} FROM nb, jobs, sz
    UNION ALL SELECT nr, feature, rep, k, {_feistel_sql('y')} FROM w, sz WHERE y >= n)
  SELECT nr, feature, rep, y FROM w, sz WHERE y < n),
pm AS (SELECT a.campaign_id, v.feature, v.rep, a.sales, a.tv AS tv_original, {picked}
       FROM walk v JOIN nb b ON b.nr = v.nr JOIN nb a ON a.nr = v.y)"""


PERM_CTES = _perm_ctes([(f, r) for f in FEATURES for r in range(PERM_REPEATS)]) + """,
base AS (SELECT """ + R2_SQL.replace("y_true", "sales").replace("y_pred", "(lin.a + lin.b * coalesce(tv, lin.mx))") + """ AS r2
         FROM te, lin),
drops AS (SELECT feature, rep, base.r2 - (""" + R2_SQL.replace("y_true", "sales").replace(
    "y_pred", "(lin.a + lin.b * coalesce(tv, lin.mx))") + """) AS dr
          FROM pm, lin, base GROUP BY feature, rep, base.r2),
pi AS (SELECT feature, avg(dr) AS importance_mean, stddev_pop(dr) AS importance_std, count(*) AS n_repeats
       FROM drops GROUP BY feature)"""

CONTRIB_CTES = MODEL_CTES + f"""
, te AS (SELECT * FROM sp WHERE split = 'test'),
lc AS (SELECT campaign_id, lin.a + lin.b * lin.mx AS base_value, lin.a + lin.b * coalesce(tv, lin.mx) AS prediction,
              f.feature, CASE WHEN f.feature = 'tv' THEN lin.b * (coalesce(tv, lin.mx) - lin.mx)
                              ELSE CAST(0 AS DOUBLE) END AS contribution
       FROM te, lin, (VALUES {_FEATS_SQL}) AS f(feature)),
sg AS (SELECT feature, avg(abs(contribution)) AS mean_abs_contribution, count(*) AS n FROM lc GROUP BY feature)"""


# -------------------------------------------------------------------- queries
@query("permute_column", _perm_ctes([("tv", 0)]) + "\nSELECT campaign_id, tv_original, tv AS tv_permuted FROM pm")
def permute_column(spark, sf):
    """E2 building block: the test rows with ``tv`` permuted (repeat 0)."""
    _, te, _ = _test_and_model(spark, sf)
    pc = XP.permuted_copies(te.withColumn("tv_original", F.col("tv")), ["tv"], 1)
    return pc.select(KEY, "tv_original", F.col("tv").alias("tv_permuted"))


@query("permutation_importance", PERM_CTES + "\nSELECT * FROM pi",
       round_cols=["importance_mean", "importance_std"])
def permutation_importance(spark, sf):
    """R2 drop over 10 seeded permutations of each raw feature (test split)."""
    _, te, model = _test_and_model(spark, sf)
    return XP.permutation_importance(te, _predictor(model), FEATURES, PERM_REPEATS)


@query("linear_contributions", CONTRIB_CTES + "\nSELECT * FROM lc",
       round_cols=["base_value", "prediction", "contribution"])
def linear_contributions(spark, sf):
    """E10R: exact Shapley contributions of the linear model on the test split."""
    _, te, model = _test_and_model(spark, sf)
    return XP.linear_contributions(te, model, FEATURES)


@query("shap_global", CONTRIB_CTES + "\nSELECT * FROM sg", round_cols=["mean_abs_contribution"])
def shap_global(spark, sf):
    """E5: mean absolute contribution per feature."""
    _, te, model = _test_and_model(spark, sf)
    return XP.shap_global(XP.linear_contributions(te, model, FEATURES))


@query("waterfall_samples", MODEL_CTES + f"""
, t5 AS (SELECT campaign_id, sales FROM sp WHERE split = 'test' ORDER BY campaign_id LIMIT {EXPLAIN_SAMPLE_N}),
r AS (SELECT *, row_number() OVER (ORDER BY sales, campaign_id) - 1 AS pos, count(*) OVER () AS n FROM t5),
q AS (SELECT * FROM (VALUES ('p10', 0.1), ('p50', 0.5), ('p90', 0.9)) AS v(label, q))
SELECT label, campaign_id, sales, pos FROM r, q WHERE pos = floor(q * n)""")
def waterfall_samples(spark, sf):
    """W2 + L3: rows at the 10/50/90 % positions (by sales) of the first 500 test rows."""
    _, te, _ = _test_and_model(spark, sf)
    return XP.waterfall_rows(XP.explanation_sample(te.select(KEY, TARGET)))


_NATIVE_SQL = ", ".join(f"('{c}')" for c in _TRANSFORMED)


@query("importance_synthesis", PERM_CTES + f"""
, lc AS (SELECT f.feature, CASE WHEN f.feature = 'tv' THEN lin.b * (coalesce(te.tv, lin.mx) - lin.mx)
                                ELSE CAST(0 AS DOUBLE) END AS contribution
         FROM te, lin, (VALUES {_FEATS_SQL}) AS f(feature)),
sg AS (SELECT feature, avg(abs(contribution)) AS shap FROM lc GROUP BY feature),
sd AS (SELECT stddev_pop(coalesce(tv, lin.mx)) AS s FROM sp, lin WHERE split = 'train'),
nat AS (SELECT CASE WHEN t.feature LIKE 'influencer\\_%' ESCAPE '\\' THEN 'influencer'
                    ELSE replace(t.feature, '_scaled', '') END AS feature,
               sum(CASE WHEN t.feature = 'tv_scaled' THEN abs(lin.b) * sd.s ELSE CAST(0 AS DOUBLE) END) AS native
        FROM (VALUES {_NATIVE_SQL}) AS t(feature), lin, sd GROUP BY 1),
j AS (SELECT nat.feature, native, pi.importance_mean AS permutation, sg.shap
      FROM nat JOIN pi ON nat.feature = pi.feature JOIN sg ON nat.feature = sg.feature)
, nm AS (SELECT *, round(100 * native / sum(native) OVER (), 2) AS native_norm,
              round(100 * permutation / sum(permutation) OVER (), 2) AS permutation_norm,
              round(100 * shap / sum(shap) OVER (), 2) AS shap_norm FROM j)
SELECT *, CAST(row_number() OVER (ORDER BY shap_norm DESC, feature) AS INTEGER) AS shap_rank FROM nm""", round_cols=["native", "permutation", "shap"])
def importance_synthesis(spark, sf):
    """E9 + D30 + J1 + D31 + P11 + L2: native (|coef| x std), permutation and
    Shapley importances of the linear model, folded to raw features, joined
    and normalised."""
    sp, te, model = _test_and_model(spark, sf)
    x = F.coalesce(F.col(model.x), F.lit(model.mean_x))
    from adlift.operators.quantiles import scalars
    sd = scalars(sp.where(F.col("split") == "train").agg(F.stddev_pop(x).alias("sd")))["sd"]
    native = (sp.sparkSession.createDataFrame([(c,) for c in _TRANSFORMED], "feature string")
              .select(F.regexp_replace("feature", "_scaled$", "").alias("feature"),
                      F.when(F.col("feature") == f"{model.x}_scaled", abs(model.slope) * sd)
                      .otherwise(F.lit(0.0)).alias("native")))
    perm = XP.permutation_importance(te, _predictor(model), FEATURES, PERM_REPEATS) \
        .select("feature", F.col("importance_mean").alias("permutation"))
    shap = XP.shap_global(XP.linear_contributions(te, model, FEATURES)) \
        .select("feature", F.col("mean_abs_contribution").alias("shap"))
    return XP.importance_synthesis(native, perm, shap)
