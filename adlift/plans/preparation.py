"""Registered split / fold / preparation queries (Spark plan + DuckDB oracle)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from adlift.constants import (
    CATEGORIES,
    GBT_GRID,
    KEY,
    MLP_GRID,
    N_FOLDS,
    NUMERIC,
    PAIR_SAMPLE_N,
    RF_GRID,
    SPLIT_GAP_OK_PCT,
    TARGET,
)
from adlift.operators import prep as X
from adlift.operators import split as S
from adlift.operators.profile import clean_target, complete_cases
from adlift.plans.registry import query
from adlift.sources.campaigns import campaigns

# ---------------------------------------------------------------- shared CTEs
SPLIT_CTES = f"""
, sr AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(campaign_id AS VARCHAR) || '{S.SPLIT_SALT}'), campaign_id) AS rk,
                count(*) OVER () AS n FROM clean),
sp AS (SELECT campaign_id, tv, radio, social_media, influencer, sales,
              CASE WHEN rk <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM sr)"""

FOLD_CTES = SPLIT_CTES + f"""
, fr AS (SELECT campaign_id, row_number() OVER (ORDER BY md5(CAST(campaign_id AS VARCHAR) || '{S.FOLD_SALT}'), campaign_id) AS rk,
                count(*) OVER () AS n FROM sp WHERE split = 'train'),
fo AS (SELECT campaign_id, CAST(CASE WHEN rk - 1 < (n % {N_FOLDS}) * (n // {N_FOLDS} + 1)
                                   THEN (rk - 1) // (n // {N_FOLDS} + 1)
                                   ELSE (n % {N_FOLDS}) + (rk - 1 - (n % {N_FOLDS}) * (n // {N_FOLDS} + 1)) // (n // {N_FOLDS})
                              END AS INTEGER) AS fold FROM fr)"""


def _onehot_sql(v):
    return (f"CASE WHEN coalesce(influencer, 'missing') = '{v}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
            f"AS influencer_{v.lower()}")


PREP_CTES = SPLIT_CTES + """
, st AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS md_{c}" for c in NUMERIC) + """ FROM sp WHERE split = 'train'),
st2 AS (SELECT """ + ", ".join(
    f"md_{c}, avg(coalesce({c}, md_{c})) AS mu_{c}, "
    f"CASE WHEN stddev_pop(coalesce({c}, md_{c})) > 0 THEN stddev_pop(coalesce({c}, md_{c})) ELSE 1 END AS sd_{c}"
    for c in NUMERIC) + """
        FROM sp, st WHERE split = 'train' GROUP BY """ + ", ".join(f"md_{c}" for c in NUMERIC) + """),
pf AS (SELECT campaign_id, split, """ + ", ".join(
    f"(coalesce({c}, md_{c}) - mu_{c}) / sd_{c} AS {c}_scaled" for c in NUMERIC) + ", " + ", ".join(
    _onehot_sql(v) for v in CATEGORIES) + """, sales FROM sp, st2)"""

FEATURE_COLS = X.output_columns()


# -------------------------------------------------------------- Spark tables
def clean(spark, sf):
    return clean_target(campaigns(spark, sf))


def split_table(spark, sf):
    """Clean campaigns with ``split`` (exact-size hash split), materialized once
    per session and partitioned by ``split`` (readers of one side prune the other)."""
    from adlift.sources.campaigns import materialized
    df = materialized(spark, "split", sf, lambda: S.train_test_split(clean(spark, sf)), ["split"])
    return df.select(KEY, *NUMERIC, "influencer", TARGET, "split")


def fold_table(spark, sf, split=None):
    """Train rows with ``fold``; for the session's split table it is
    materialized once (every CV consumer then scans it instead of
    re-deriving the fold cut)."""
    if split is not None:
        return S.kfold(split.where(F.col("split") == "train"))
    from adlift.sources.campaigns import materialized
    df = materialized(spark, "folds", sf,
                      lambda: S.kfold(split_table(spark, sf).where(F.col("split") == "train")))
    return df.select(KEY, *NUMERIC, "influencer", TARGET, "split", "fold")


def fit_preprocessor(split_df, output_col: str = ""):
    """Fit on the train rows only (never on test rows)."""
    return X.CampaignPreprocessor(outputCol=output_col).fit(split_df.where(F.col("split") == "train"))


def prepared(spark, sf):
    sp = split_table(spark, sf)
    model = fit_preprocessor(sp)
    return model.transform(sp).select(KEY, "split", *FEATURE_COLS, TARGET)


# ------------------------------------------------------------------ queries
@query("train_test_split", SPLIT_CTES + "\nSELECT campaign_id, split FROM sp")
def train_test_split(spark, sf):
    """X6 (exact size) + S4."""
    return split_table(spark, sf).select(KEY, "split")


@query("hash_split", """
SELECT campaign_id, CASE WHEN CAST(('0x' || substr(md5(CAST(campaign_id AS VARCHAR) || '#42'), 1, 8)) AS BIGINT) % 1000 < 200
                        THEN 'test' ELSE 'train' END AS split FROM clean""")
def hash_split(spark, sf):
    """X6 (exact=False): split by hash threshold, no aggregate."""
    return S.hash_split(clean(spark, sf)).select(KEY, "split")


@query("kfold_assign", FOLD_CTES + "\nSELECT campaign_id, fold FROM fo")
def kfold_assign(spark, sf):
    """Seeded 5-fold assignment of train rows."""
    return fold_table(spark, sf).select(KEY, "fold")


@query("split_balance", SPLIT_CTES + f"""
, b AS (SELECT count_if(split = 'train') AS n_train, count_if(split = 'test') AS n_test,
               avg(CASE WHEN split = 'train' THEN sales END) AS mean_train,
               avg(CASE WHEN split = 'test' THEN sales END) AS mean_test,
               stddev_samp(CASE WHEN split = 'train' THEN sales END) AS std_train,
               stddev_samp(CASE WHEN split = 'test' THEN sales END) AS std_test FROM sp)
SELECT *, abs(mean_test - mean_train) / mean_train * 100 AS gap_pct,
       CASE WHEN abs(mean_test - mean_train) / mean_train * 100 < {SPLIT_GAP_OK_PCT} THEN 'OK' ELSE 'WARN' END AS status
FROM b""", round_cols=["mean_train", "mean_test", "std_train", "std_test", "gap_pct"])
def split_balance(spark, sf):
    """Target mean/std per split, relative gap and status, one pass."""
    sp = split_table(spark, sf)
    tr, te = F.col("split") == "train", F.col("split") == "test"
    y = F.col(TARGET)
    b = sp.agg(F.count_if(tr).alias("n_train"), F.count_if(te).alias("n_test"),
               F.avg(F.when(tr, y)).alias("mean_train"), F.avg(F.when(te, y)).alias("mean_test"),
               F.stddev_samp(F.when(tr, y)).alias("std_train"), F.stddev_samp(F.when(te, y)).alias("std_test"))
    gap = F.abs(F.col("mean_test") - F.col("mean_train")) / F.col("mean_train") * 100
    return b.withColumn("gap_pct", gap).withColumn(
        "status", F.when(gap < SPLIT_GAP_OK_PCT, "OK").otherwise("WARN"))


@query("prepared_features", PREP_CTES + "\nSELECT * FROM pf",
       round_cols=[f"{c}_scaled" for c in NUMERIC])
def prepared_features(spark, sf):
    """Preprocessor fitted on train, applied to every row."""
    return prepared(spark, sf)


@query("transform_quality", PREP_CTES + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count_if({c} IS NULL OR isnan({c})) AS n_bad, avg({c}) AS mean, "
    f"stddev_pop({c}) AS std_pop FROM pf WHERE split = 'train'" for c in FEATURE_COLS),
    round_cols=["mean", "std_pop"])
def transform_quality(spark, sf):
    """Post-transform checks on train (no NaN/null, mean ~ 0, pop-std ~ 1)."""
    tr = prepared(spark, sf).where(F.col("split") == "train")
    lv = tr.unpivot([], FEATURE_COLS, "feature", "value")
    v = F.col("value")
    return lv.groupBy("feature").agg(F.count_if(v.isNull() | F.isnan(v)).alias("n_bad"),
                                     F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"))


@query("pair_sample", f"""
SELECT * FROM campaigns WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [KEY] + NUMERIC + ['influencer', TARGET])}
ORDER BY md5(CAST(campaign_id AS VARCHAR) || '{S.SPLIT_SALT}'), campaign_id LIMIT {PAIR_SAMPLE_N}""")
def pair_sample(spark, sf):
    """L4 + D35: seeded sample of min(1000, n) complete-case rows (top-k by hash)."""
    return S.hash_sample(complete_cases(campaigns(spark, sf)), PAIR_SAMPLE_N)


# ------------------------------------------------------------- CV work plan
def grid_points() -> list[tuple[str, str]]:
    """(model, params) for every grid point of the three tuned models."""
    def fmt(v):
        if v is None:
            return "None"
        if isinstance(v, tuple):
            return "-".join(str(x) for x in v)
        return str(v)
    out = []
    for model, grid in (("Random Forest", RF_GRID), ("Gradient Boosting", GBT_GRID), ("MLP (Deep Learning)", MLP_GRID)):
        keys = list(grid)
        for combo in product(*(grid[k] for k in keys)):
            out.append((model, ";".join(f"{k}={fmt(v)}" for k, v in zip(keys, combo))))
    return out


def _grid_values_sql():
    return ", ".join(f"('{m}', '{p}')" for m, p in grid_points())


@query("param_grid", FOLD_CTES + f"""
, g AS (SELECT * FROM (VALUES {_grid_values_sql()}) AS t(model, params)),
fc AS (SELECT fold, count(*) AS n_valid, (SELECT count(*) FROM fo) AS n_all FROM fo GROUP BY fold)
SELECT model, params, fold, n_all - n_valid AS n_fit, n_valid FROM fc, g""")
def param_grid(spark, sf):
    """J5 + X9: every hyper-parameter combination x fold with the rows it fits
    on and validates on.  The grid is generated per fold row (explode), not
    joined."""
    fo = fold_table(spark, sf)
    per_fold = fo.groupBy("fold").agg(F.count(F.lit(1)).alias("n_valid"))
    from adlift.operators.quantiles import scalars
    n_all = scalars(fo.agg(F.count(F.lit(1)).alias("n")))["n"]
    grid = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(p).alias("params")) for m, p in grid_points()])
    return (per_fold.select("fold", "n_valid", F.explode(grid).alias("g"))
            .select("g.model", "g.params", "fold", (n_all - F.col("n_valid")).alias("n_fit"), "n_valid"))
