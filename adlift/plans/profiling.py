"""Registered profiling / exploration queries (Spark plan + DuckDB oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlift.constants import CATEGORIES, HIST_BINS, KEY, NUMERIC, TARGET
from adlift.operators import profile as P
from adlift.operators import relate as R
from adlift.plans.registry import query
from adlift.sources.campaigns import campaigns

NUM_T = NUMERIC + [TARGET]
ALL_COLS = [KEY] + NUMERIC + ["influencer", TARGET]
CAT_LIST = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
# Explorer filter parameters used by the registered explorer queries.
EXPLORER = {"influencers": ["Nano", "Macro"], "tv": (100.0, 400.0), "sales": (100.0, 400.0)}


def clean(spark, sf):
    return P.clean_target(campaigns(spark, sf))


def union(template: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(template.format(c=c, i=i + 1) for i, c in enumerate(cols))


# ------------------------------------------------------------------ scans
@query("campaigns_scan", "SELECT * FROM campaigns")
def campaigns_scan(spark, sf):
    """S1 + P4: the campaign table (features + target + key)."""
    return campaigns(spark, sf)


@query("clean_target", "SELECT * FROM clean")
def clean_target(spark, sf):
    """Rows with a target."""
    return clean(spark, sf)


@query("complete_cases", "SELECT * FROM campaigns WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in ALL_COLS))
def complete_cases(spark, sf):
    """Complete-case rows."""
    return P.complete_cases(campaigns(spark, sf))


@query("schema_profile", union(
    "SELECT '{c}' AS feature, {i} AS position, "
    "(SELECT CASE typeof({c}) WHEN 'VARCHAR' THEN 'string' ELSE lower(typeof({c})) END FROM campaigns LIMIT 1) AS dtype, "
    "count({c}) AS non_null, count(*) AS n_rows FROM campaigns", ALL_COLS))
def schema_profile(spark, sf):
    """Column list, types, non-null counts, shape."""
    return P.schema_profile(campaigns(spark, sf))


# --------------------------------------------------------------- describe
@query("numeric_describe", union(
    "SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    "min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, "
    "quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM campaigns", NUM_T),
    round_cols=["mean", "std", "min", "q25", "median", "q75", "max"])
def numeric_describe(spark, sf):
    """D1 + D2."""
    return P.numeric_describe(campaigns(spark, sf), NUM_T)


@query("categorical_describe", """
, c AS (SELECT influencer, count(*) AS n FROM campaigns WHERE influencer IS NOT NULL GROUP BY influencer)
SELECT 'influencer' AS feature, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique,
       (SELECT influencer FROM c ORDER BY n DESC, influencer LIMIT 1) AS top, max(n) AS freq
FROM c""")
def categorical_describe(spark, sf):
    """D3."""
    return P.categorical_describe(campaigns(spark, sf), "influencer")


@query("null_report", union(
    "SELECT '{c}' AS feature, count_if({c} IS NULL) AS null_count, "
    "round(CAST(100 AS DOUBLE) * count_if({c} IS NULL) / count(*), 2) AS null_pct FROM campaigns",
    ALL_COLS))
def null_report(spark, sf):
    """D4."""
    return P.null_report(campaigns(spark, sf))


@query("null_rows", "SELECT count(*) AS n_rows, count_if(" + " OR ".join(f"{c} IS NULL" for c in ALL_COLS)
       + ") AS n_null_rows, CAST(100 AS DOUBLE) * count_if(" + " OR ".join(f"{c} IS NULL" for c in ALL_COLS)
       + ") / count(*) AS pct_null_rows FROM campaigns", round_cols=["pct_null_rows"])
def null_rows(spark, sf):
    """D5."""
    return P.null_rows(campaigns(spark, sf))


@query("duplicate_rows", """
, g AS (SELECT count(*) AS c FROM campaigns GROUP BY tv, radio, social_media, influencer, sales)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates, count(*) AS n_distinct FROM g""")
def duplicate_rows(spark, sf):
    """Duplicates over the data columns (the key is unique by construction)."""
    return P.duplicate_rows(campaigns(spark, sf), NUMERIC + ["influencer", TARGET])


@query("moments", union(
    "SELECT '{c}' AS feature, count({c}) AS n, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis "
    "FROM campaigns", NUM_T), round_cols=["skewness", "kurtosis"])
def moments(spark, sf):
    """D7 + D8."""
    return P.moments(campaigns(spark, sf), NUM_T)


# ------------------------------------------------------------ categories
@query("category_share", """
, c AS (SELECT influencer, count(*) AS n FROM campaigns WHERE influencer IS NOT NULL GROUP BY influencer),
s AS (SELECT influencer, n, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (), 1) AS share_pct FROM c)
SELECT *, min(share_pct) OVER () AS min_share_pct, max(share_pct) OVER () AS max_share_pct FROM s""")
def category_share(spark, sf):
    """D9 + D10."""
    return P.category_share(campaigns(spark, sf), "influencer")


@query("sales_by_influencer", f"""
SELECT influencer, avg(sales) AS mean, quantile_cont(sales, 0.5) AS median, stddev_samp(sales) AS std,
       count(sales) AS count, CAST(list_position({CAT_LIST}, influencer) AS INTEGER) AS influencer_rank
FROM clean WHERE influencer IS NOT NULL GROUP BY influencer""", round_cols=["mean", "median", "std"])
def sales_by_influencer(spark, sf):
    """D11 + L5."""
    return P.group_stats(clean(spark, sf), "influencer")


@query("best_worst_group", """
, g AS (SELECT influencer, avg(sales) AS mean FROM clean WHERE influencer IS NOT NULL GROUP BY influencer)
SELECT arg_max(influencer, mean) AS best_group, max(mean) AS best_mean,
       arg_min(influencer, mean) AS worst_group, min(mean) AS worst_mean,
       (max(mean) / min(mean) - 1) * 100 AS spread_pct FROM g""",
       round_cols=["best_mean", "worst_mean", "spread_pct"])
def best_worst_group(spark, sf):
    """D12."""
    return P.best_worst_group(P.group_means(clean(spark, sf), "influencer"), "influencer")


# ----------------------------------------------------------- correlations
def _corr_sql(cols):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            r = f"CASE WHEN count({a}) > 1 THEN CAST(1 AS DOUBLE) END" if i == j else \
                f"corr({cols[min(i, j)]}, {cols[max(i, j)]})"
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, {i + 1} AS i1, {j + 1} AS i2, {r} AS r, "
                         f"{i + 1} > {j + 1} AS in_lower FROM campaigns")
    return "\nUNION ALL\n".join(parts)


@query("correlation_matrix", _corr_sql(NUM_T), round_cols=["r"])
def correlation_matrix(spark, sf):
    """D13 + D14."""
    return R.correlation_matrix(campaigns(spark, sf), NUM_T)


@query("target_correlations", f"""
, m AS ({_corr_sql(NUM_T)})
SELECT var1 AS feature, r, abs(r) AS abs_r,
       CAST(row_number() OVER (ORDER BY abs(r) DESC, var1) AS INTEGER) AS abs_rank,
       row_number() OVER (ORDER BY abs(r) DESC, var1) = 1 AS is_strongest
FROM m WHERE var2 = 'sales' AND var1 <> 'sales'""", round_cols=["r", "abs_r"])
def target_correlations(spark, sf):
    """D15."""
    return R.target_correlations(R.correlation_matrix(campaigns(spark, sf), NUM_T))


@query("multicollinear_pairs", f"""
, m AS ({_corr_sql(NUMERIC)})
SELECT var1, var2, r FROM m WHERE i1 < i2 AND abs(r) > 0.7""", round_cols=["r"])
def multicollinear_pairs(spark, sf):
    """D16 + J4."""
    return R.multicollinear_pairs(R.correlation_matrix(campaigns(spark, sf), NUMERIC), NUMERIC)


# --------------------------------------------------------------- outliers
@query("iqr_outliers", union(
    "SELECT '{c}' AS feature, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS fence_lo, "
    "q3 + 1.5 * (q3 - q1) AS fence_hi, "
    "count_if(x.{c} < q1 - 1.5 * (q3 - q1) OR x.{c} > q3 + 1.5 * (q3 - q1)) AS n_outliers, count(x.{c}) AS n, "
    "CAST(100 AS DOUBLE) * count_if(x.{c} < q1 - 1.5 * (q3 - q1) OR x.{c} > q3 + 1.5 * (q3 - q1)) / count(x.{c}) "
    "AS pct_outliers FROM campaigns x, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 "
    "FROM campaigns) q GROUP BY q1, q3", NUM_T),
    round_cols=["q1", "q3", "iqr", "fence_lo", "fence_hi", "pct_outliers"])
def iqr_outliers(spark, sf):
    """D17."""
    return P.iqr_outliers(campaigns(spark, sf), NUM_T)


_BOX_CTE = """
, q AS (SELECT influencer, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.5) AS median,
               quantile_cont(sales, 0.75) AS q3 FROM clean WHERE influencer IS NOT NULL GROUP BY influencer),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS fence_lo, q3 + 1.5 * (q3 - q1) AS fence_hi FROM q)"""


@query("box_stats", _BOX_CTE + """
SELECT f.influencer, q1, median, q3, iqr, fence_lo, fence_hi,
       min(CASE WHEN c.sales BETWEEN fence_lo AND fence_hi THEN c.sales END) AS whisker_lo,
       max(CASE WHEN c.sales BETWEEN fence_lo AND fence_hi THEN c.sales END) AS whisker_hi,
       count_if(NOT (c.sales BETWEEN fence_lo AND fence_hi)) AS n_outliers, count(*) AS n
FROM clean c JOIN f ON c.influencer = f.influencer
GROUP BY f.influencer, q1, median, q3, iqr, fence_lo, fence_hi""",
       round_cols=["q1", "median", "q3", "iqr", "fence_lo", "fence_hi", "whisker_lo", "whisker_hi"])
def box_stats(spark, sf):
    """Box plot of sales per influencer."""
    return P.box_stats(clean(spark, sf), TARGET, "influencer")


@query("outlier_rows", _BOX_CTE + """
SELECT c.campaign_id, c.influencer, c.sales, fence_lo, fence_hi
FROM clean c JOIN f ON c.influencer = f.influencer
WHERE NOT (c.sales BETWEEN fence_lo AND fence_hi)""", round_cols=["fence_lo", "fence_hi"])
def outlier_rows(spark, sf):
    """Outlier points per influencer."""
    return P.outlier_rows(clean(spark, sf), TARGET, "influencer")


# ------------------------------------------------------------ distribution
@query("sales_histogram", f"""
, s AS (SELECT min(sales) AS lo, max(sales) AS hi FROM clean),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / {HIST_BINS} ELSE CAST(1 AS DOUBLE) END AS width FROM s),
c AS (SELECT CAST(least(floor((sales - lo) / width), {HIST_BINS - 1}) AS INTEGER) AS bin, count(*) AS count
      FROM clean, w GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, lo + r.range * width AS bin_lo, lo + (r.range + 1) * width AS bin_hi,
       coalesce(c.count, 0) AS count
FROM range({HIST_BINS}) r CROSS JOIN w LEFT JOIN c ON c.bin = r.range""", round_cols=["bin_lo", "bin_hi"])
def sales_histogram(spark, sf):
    """D19 (50 bins)."""
    return P.histogram(clean(spark, sf), TARGET, HIST_BINS)


@query("sales_kde", f"""
, s AS (SELECT min(sales) AS lo, max(sales) AS hi, stddev_samp(sales) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h,
               count(*) AS n, (max(sales) - min(sales)) / {P.KDE_BINS} AS d FROM clean),
t AS (SELECT least(floor((sales - lo) / d), {P.KDE_BINS - 1}) AS b, (sales - lo) / d AS t FROM clean, s),
p AS (SELECT b, count(*) AS c, sum(t - b) AS f FROM t GROUP BY b),
j AS (SELECT j, sum(w) AS w FROM (SELECT b AS j, c - f AS w FROM p UNION ALL SELECT b + 1, f FROM p) GROUP BY j),
k AS (SELECT g.range AS g, sum(w * exp(-0.5 * (((lo + j * d) - (lo + g.range * ((hi - lo) / 99))) / h)
                                      * (((lo + j * d) - (lo + g.range * ((hi - lo) / 99))) / h))) AS k
      FROM j, s, range(100) g GROUP BY g.range)
SELECT CAST(g AS INTEGER) AS point, lo + g * ((hi - lo) / 99) AS x, k / (n * h * sqrt(2 * pi())) AS density
FROM k, s""", round_cols={"x": 9, "density": 12})
def sales_kde(spark, sf):
    """Gaussian KDE of sales on 100 points (linear binning, convolution)."""
    return P.kde(clean(spark, sf), TARGET, 100)


@query("quantile_bands", """
, s AS (SELECT min(sales) AS q0, quantile_cont(sales, 0.25) AS q25, quantile_cont(sales, 0.75) AS q75,
               max(sales) AS q100, avg(sales) AS mean FROM clean)
SELECT CASE WHEN sales < q25 THEN 'low' WHEN sales <= q75 THEN 'mid' ELSE 'high' END AS band,
       CASE WHEN sales < q25 THEN q0 WHEN sales <= q75 THEN q25 ELSE q75 END AS band_lo,
       CASE WHEN sales < q25 THEN q25 WHEN sales <= q75 THEN q75 ELSE q100 END AS band_hi,
       count(*) AS n, avg(sales) AS band_mean, mean AS overall_mean
FROM clean, s GROUP BY 1, 2, 3, mean""", round_cols=["band_lo", "band_hi", "band_mean", "overall_mean"])
def quantile_bands(spark, sf):
    """D26."""
    return P.quantile_bands(clean(spark, sf), TARGET)


@query("parameter_ranges", union(
    "SELECT '{c}' AS feature, min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.5) AS median FROM clean",
    NUMERIC), round_cols=["median"])
def parameter_ranges(spark, sf):
    """Slider bounds and defaults."""
    return P.parameter_ranges(clean(spark, sf), NUMERIC)


@query("trend_line", union(
    "SELECT '{c}' AS feature, CASE WHEN regr_count(sales, {c}) > 1 THEN regr_slope(sales, {c}) END AS slope, "
    "CASE WHEN regr_count(sales, {c}) > 1 THEN regr_intercept(sales, {c}) END AS intercept, "
    "CASE WHEN regr_count(sales, {c}) > 1 THEN regr_r2(sales, {c}) END AS r2, "
    "CAST(regr_count(sales, {c}) AS BIGINT) AS n, min(CASE WHEN sales IS NOT NULL THEN {c} END) AS x_min, "
    "max(CASE WHEN sales IS NOT NULL THEN {c} END) AS x_max, "
    "CASE WHEN regr_count(sales, {c}) > 1 THEN regr_slope(sales, {c}) * min(CASE WHEN sales IS NOT NULL THEN {c} END) "
    "+ regr_intercept(sales, {c}) END AS y_at_min, "
    "CASE WHEN regr_count(sales, {c}) > 1 THEN regr_slope(sales, {c}) * max(CASE WHEN sales IS NOT NULL THEN {c} END) "
    "+ regr_intercept(sales, {c}) END AS y_at_max FROM clean", NUMERIC),
    round_cols=["slope", "intercept", "r2", "y_at_min", "y_at_max"])
def trend_line(spark, sf):
    """Least-squares trend of sales on each budget."""
    return R.trend_line(clean(spark, sf), NUMERIC)


@query("kpi_summary", """
SELECT count(*) AS n_campaigns, avg(tv + radio + social_media) AS mean_budget, avg(sales) AS mean_sales,
       corr(tv, sales) AS r_tv_sales,
       (SELECT arg_max(influencer, m) FROM (SELECT influencer, avg(sales) AS m FROM clean
        WHERE influencer IS NOT NULL GROUP BY influencer)) AS best_group,
       CASE WHEN avg(tv + radio + social_media) > 0 THEN avg(sales) / avg(tv + radio + social_media)
            ELSE CAST(0 AS DOUBLE) END AS roi
FROM clean""", round_cols=["mean_budget", "mean_sales", "r_tv_sales", "roi"])
def kpi_summary(spark, sf):
    """Executive KPIs."""
    return R.kpi_summary(clean(spark, sf), NUMERIC, "influencer")


# ---------------------------------------------------------------- explorer
def explorer_filter(df, influencers, tv_range, sales_range):
    """Membership AND closed range AND closed range; a null operand excludes the row."""
    return (F.col("influencer").isin(influencers) & F.col("tv").between(*tv_range)
            & F.col(TARGET).between(*sales_range))


def _explorer_sql_pred():
    inf = ", ".join(f"'{c}'" for c in EXPLORER["influencers"])
    return (f"influencer IN ({inf}) AND tv BETWEEN {EXPLORER['tv'][0]} AND {EXPLORER['tv'][1]} "
            f"AND sales BETWEEN {EXPLORER['sales'][0]} AND {EXPLORER['sales'][1]}")


@query("filtered_explorer", f"SELECT * FROM clean WHERE {_explorer_sql_pred()}")
def filtered_explorer(spark, sf):
    """P6 (+ P17: previews are ``orderBy(key).limit(n)`` on this result)."""
    df = clean(spark, sf)
    return df.where(explorer_filter(df, EXPLORER["influencers"], EXPLORER["tv"], EXPLORER["sales"]))


@query("filter_coverage", f"""
SELECT count(*) AS n_total, count_if({_explorer_sql_pred()}) AS n_kept,
       CAST(100 AS DOUBLE) * count_if({_explorer_sql_pred()}) / count(*) AS pct_kept FROM clean""",
       round_cols=["pct_kept"])
def filter_coverage(spark, sf):
    """Share of rows kept by the explorer filter, one pass."""
    df = clean(spark, sf)
    pred = explorer_filter(df, EXPLORER["influencers"], EXPLORER["tv"], EXPLORER["sales"])
    return (df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(pred).alias("n_kept"))
            .withColumn("pct_kept", 100.0 * F.col("n_kept") / F.col("n_total")))


_LO, _HI = EXPLORER["sales"]


@query("linked_panels", f"""
, f AS (SELECT * FROM clean WHERE {_explorer_sql_pred()}),
t AS (SELECT 'kpi' AS panel, 'all' AS grp, tv + radio + social_media AS x, sales AS y FROM f
  UNION ALL SELECT 'group', influencer, NULL, sales FROM f
  UNION ALL SELECT 'histogram', CAST(CAST(least(floor((sales - {_LO}) / {(_HI - _LO) / HIST_BINS}), {HIST_BINS - 1}) AS INTEGER) AS VARCHAR), NULL, sales FROM f
  UNION ALL """ + " UNION ALL ".join(f"SELECT 'trend', '{c}', {c}, sales FROM f" for c in NUMERIC) + """)
SELECT panel, grp, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, stddev_samp(y) AS std_y, min(y) AS min_y, max(y) AS max_y,
  CASE WHEN panel = 'trend' AND regr_count(y, x) > 1 THEN regr_slope(y, x) END AS slope,
  CASE WHEN panel = 'trend' AND regr_count(y, x) > 1 THEN regr_intercept(y, x) END AS intercept,
  CASE WHEN panel = 'trend' AND regr_count(y, x) > 1 THEN corr(x, y) END AS r,
  CASE WHEN panel = 'kpi' THEN CASE WHEN avg(x) > 0 THEN avg(y) / avg(x) ELSE CAST(0 AS DOUBLE) END END AS roi
FROM t GROUP BY panel, grp""", round_cols=["mean_x", "mean_y", "std_y", "min_y", "max_y", "slope", "intercept", "r", "roi"])
def linked_panels(spark, sf):
    """KPIs, group statistics, trends and histogram of the filtered rows, one scan."""
    df = clean(spark, sf)
    kept = df.where(explorer_filter(df, EXPLORER["influencers"], EXPLORER["tv"], EXPLORER["sales"]))
    return P.panels(kept, NUMERIC, "influencer", TARGET, EXPLORER["sales"], HIST_BINS)


@query("campaign_roi", """
SELECT campaign_id, tv + radio + social_media AS total_budget, sales,
       round(CASE WHEN tv + radio + social_media > 0 THEN sales / (tv + radio + social_media)
                  ELSE CAST(0 AS DOUBLE) END, 4) AS roi
FROM clean""")
def campaign_roi(spark, sf):
    """P15 + F4: total budget and guarded ROI per campaign."""
    from adlift.functions.scalar import guarded_roi
    df = clean(spark, sf)
    b = R.total_budget(NUMERIC)
    return df.select(KEY, b.alias("total_budget"), TARGET, guarded_roi(F.col(TARGET), b).alias("roi"))


@query("budget_mix", union(
    "SELECT campaign_id, '{c}' AS channel, {c} AS budget, "
    "CASE WHEN tv + radio + social_media > 0 THEN {c} / (tv + radio + social_media) * 100 END AS share_pct "
    "FROM clean", NUMERIC))
def budget_mix(spark, sf):
    """channel share of each campaign's total budget."""
    from adlift.functions.scalar import budget_shares
    return budget_shares(clean(spark, sf), NUMERIC)


@query("market_gap", """
, m AS (SELECT avg(sales) AS m FROM clean)
SELECT campaign_id, sales, (sales - m) / m * 100 AS gap_pct,
       CASE WHEN (sales - m) / m * 100 >= 0 THEN 'above' ELSE 'below' END AS position
FROM clean, m""", round_cols=["gap_pct"])
def market_gap(spark, sf):
    """F9 + J3: deviation of each campaign from the market mean (scalar subquery, no join)."""
    from adlift.functions.scalar import market_gap as gap
    df = clean(spark, sf)
    return gap(df, TARGET)
