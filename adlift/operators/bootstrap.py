"""Poisson bootstrap for confidence intervals (group means, trend-line band).

Each (row, replicate) gets a Poisson(1) weight from a hash of its key - no random
state, the same on every re-execution (so a retried task reproduces its output).
An md5 digest holds ``DRAWS`` 16-bit draws, so a row needs one digest per ``DRAWS``
replicates.  Rows are not multiplied: a task adds the weighted sums of all replicates
of a group in one matrix (weights transposed times values) and passes on groups x
replicates rows, whatever it read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlift.constants import KEY, SEED

DRAWS = 8  # of 16 bits in a digest
SALT = f"#boot{SEED}:"


def poisson1_cuts(k_max: int = 7) -> list[int]:
    """16-bit cuts of Poisson(1): a draw u gives the number of cuts at or below it."""
    out, acc = [], 0.0
    for k in range(k_max + 1):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(math.ceil(acc * 65536))
    return out


def replicate_sums(df: DataFrame, by: list[str], values: dict[str, Column], replicates: int, key: str = KEY) -> DataFrame:
    """Per (``by``, replicate) the sums of weight times each value: ``by, rep, *values``."""
    blocks = -(-replicates // DRAWS)
    digests = [F.unhex(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"{SALT}{b}")))) for b in range(blocks)]
    src = df.select(*by, F.concat(*digests).alias("draws"), *[c.cast("double").alias(n) for n, c in values.items()])
    names, cuts = list(values), np.array(poisson1_cuts())

    def run(frames):
        total: dict = {}
        for t in frames:
            if len(t):
                raw = np.frombuffer(b"".join(t["draws"]), ">u2").reshape(len(t), blocks * DRAWS)[:, :replicates]
                w = np.searchsorted(cuts, raw, side="right").astype(float)
                v = t[names].to_numpy(float)
                groups = t.groupby(by, dropna=False).indices.items() if by else [((), np.arange(len(t)))]
                for g, at in groups:
                    g = g if isinstance(g, tuple) else (g,)
                    total[g] = total.get(g, 0.0) + w[at].T @ v[at]
        for g, sums in total.items():
            yield pd.DataFrame({**dict(zip(by, g, strict=True)), "rep": np.arange(1, replicates + 1, dtype=np.int32),
                                **{n: sums[:, i] for i, n in enumerate(names)}})
    kinds = dict(df.select(*by).dtypes) if by else {}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "rep int", *[f"{n} double" for n in names]])
    return src.mapInPandas(run, schema).groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names])


def group_mean_ci(df: DataFrame, group: str, value: str, replicates: int = 200, level: float = 0.95,
                  key: str = KEY) -> DataFrame:
    """Mean per group with a percentile bootstrap interval."""
    base = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(key, group, value)
    point = base.groupBy(group).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    reps = replicate_sums(base, [group], {"sw": F.lit(1.0), "sv": F.col(value)}, replicates, key)
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    m = F.when(F.col("sw") > 0, F.col("sv") / F.col("sw"))  # a replicate that drew no row of the group has no mean
    ci = reps.select(group, m.alias("m")).groupBy(group).agg(F.percentile("m", lo).alias("ci_lo"), F.percentile("m", hi).alias("ci_hi"))
    return point.join(ci, group)


def trend_band(df: DataFrame, x: str, y: str, points: int = 20, replicates: int = 200, level: float = 0.95,
               key: str = KEY) -> DataFrame:
    """Least-squares line with a bootstrap band on ``points`` x values (D24):
    per replicate the weighted sums n, Sx, Sy, Sxy, Sxx give slope and
    intercept; each replicate line is evaluated on the grid and the band is
    the percentile interval per grid point."""
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y)
    from adlift.operators.quantiles import scalars
    st = scalars(base.agg(F.min(x).alias("lo"), F.max(x).alias("hi"),
                          F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a")))
    lo, hi, b0, a0 = st["lo"], st["hi"], st["b"], st["a"]
    X, Y = F.col(x), F.col(y)
    sums = replicate_sums(base, [], {"n": F.lit(1.0), "sx": X, "sy": Y, "sxy": X * Y, "sxx": X * X}, replicates, key)
    n = F.col("n")
    spread = n * F.col("sxx") - F.col("sx") * F.col("sx")
    b = F.when(spread > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / spread)
    lines = sums.select("rep", b.alias("b"), F.col("sx"), F.col("sy"), n) \
        .select("rep", "b", F.when(n > 0, (F.col("sy") - F.col("b") * F.col("sx")) / n).alias("a"))
    step = (hi - lo) / (points - 1)
    # a line per replicate: replicates x points rows, none per row of the table
    grid = lines.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))) \
        .withColumn("xv", lo + F.col("g") * step)
    pl, ph = (1 - level) / 2, 1 - (1 - level) / 2
    return (grid.groupBy("g", "xv")
            .agg(F.percentile(F.col("a") + F.col("b") * F.col("xv"), pl).alias("y_lo"),
                 F.percentile(F.col("a") + F.col("b") * F.col("xv"), ph).alias("y_hi"))
            .select(F.col("g").cast("int").alias("point"), F.col("xv").alias("x"),
                    (a0 + b0 * F.col("xv")).alias("y_fit"), "y_lo", "y_hi"))


def weights_sql(rows: str, key: str = KEY, replicates: int = 200) -> str:
    """CTE ``w`` of the SQL twin: the rows of ``rows`` with a weight ``w`` for every ``rep``."""
    u = f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '{SALT}' || ((rep - 1) // {DRAWS})), (rep - 1) % {DRAWS} * 4 + 1, 4) AS INTEGER)"
    w = " + ".join(f"CAST(u >= {c} AS INTEGER)" for c in poisson1_cuts())
    return f"""w AS (SELECT *, {w} AS w FROM (
  SELECT r.*, rep, {u} AS u FROM {rows} r, range(1, {replicates + 1}) AS x(rep)))"""
