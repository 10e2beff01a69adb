"""Scalar column functions: ROI, residuals, verdict, slug, footprint, hashing.

Every function returns a built-in ``Column`` expression, so it stays inside
whole-stage code generation (no Python on the row path).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlift.constants import (
    CAR_G_PER_KM,
    CO2_FRANCE_G_PER_KWH,
    CO2_WORLD_G_PER_KWH,
    CPU_WATTS,
    KEY,
    OVERFIT_GAP_R2,
    OVERFIT_GAP_RMSE_PCT,
    PUE,
    UNDERFIT_GAP_R2,
    UNDERFIT_GAP_RMSE_PCT,
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ ROI
def guarded_roi(sales, budget, digits: int | None = 4) -> Column:
    """sales / budget, 0.0 when the budget is not positive."""
    b = _c(budget)
    roi = F.when(b > 0, _c(sales) / b).otherwise(F.lit(0.0))
    return F.round(roi, digits) if digits is not None else roi


def budget_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long ``(key, channel, budget, share_pct)`` of each channel in the total."""
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    long = df.select(KEY, total.alias("__t"), *cols).unpivot([KEY, "__t"], cols, "channel", "budget")
    share = F.when(F.col("__t") > 0, F.col("budget") / F.col("__t") * 100)
    return long.select(KEY, "channel", "budget", share.alias("share_pct"))


def market_gap(df: DataFrame, col: str) -> DataFrame:
    """Deviation of each row from the column mean in %, with a sign class.

    The mean is computed once (one aggregate) and inlined as a literal: no join.
    """
    from adlift.operators.quantiles import scalars
    m = scalars(df.agg(F.avg(col).alias("m")))["m"]
    gap = (F.col(col) - m) / m * 100
    return df.select(KEY, col, gap.alias("gap_pct"),
                     F.when(gap >= 0, "above").otherwise("below").alias("position"))


# ------------------------------------------------------------- residuals
def residual_columns(y_true="y_true", y_pred="y_pred") -> list[Column]:
    """residual, abs_residual, pct_error."""
    r = _c(y_true) - _c(y_pred)
    return [r.alias("residual"), F.abs(r).alias("abs_residual"),
            F.when(_c(y_true) != 0, F.abs(r) / F.abs(_c(y_true)) * 100).alias("pct_error")]


# ---------------------------------------------------------------- verdict
def gap_r2(r2_train, r2_test) -> Column:
    return _c(r2_train) - _c(r2_test)


def gap_rmse_pct(rmse_train, rmse_test) -> Column:
    return F.when(_c(rmse_train) != 0, (_c(rmse_test) - _c(rmse_train)) / _c(rmse_train) * 100)


def verdict(r2_train, r2_test, rmse_train, rmse_test) -> Column:
    """OVERFITTING / UNDERFITTING / OK on the unrounded gaps (F5).  A positive test RMSE
    over a train RMSE of 0 is an infinite relative gap."""
    g2 = gap_r2(r2_train, r2_test)
    gr = gap_rmse_pct(rmse_train, rmse_test)
    infinite = (_c(rmse_train) == 0) & (_c(rmse_test) > 0)
    return (F.when((g2 > OVERFIT_GAP_R2) | (gr > OVERFIT_GAP_RMSE_PCT) | infinite, "OVERFITTING")
            .when((g2 < UNDERFIT_GAP_R2) | (gr < UNDERFIT_GAP_RMSE_PCT), "UNDERFITTING")
            .otherwise("OK"))


# ------------------------------------------------------------------- slug
_SLUG_FROM, _SLUG_TO = " ()", "_"  # the one rule: character for character, the rest removed


def slug(name) -> Column:
    """lower case, spaces to '_', parentheses removed."""
    return F.translate(F.lower(_c(name)), _SLUG_FROM, _SLUG_TO)


def slug_py(name: str) -> str:
    """``slug`` of a Python string."""
    cut = len(_SLUG_TO)
    return name.lower().translate(str.maketrans(_SLUG_FROM[:cut], _SLUG_TO, _SLUG_FROM[cut:]))


# -------------------------------------------------------------- footprint
def emissions(time_sec, cpu_watts: float = CPU_WATTS, pue: float = PUE) -> Column:
    """Energy and CO2 of a run of ``time_sec`` seconds as a struct.

    Wh = W * s / 3600 * PUE; g = kWh * intensity; km = world g / 120;
    rounded to 4 / 4 / 4 / 5 digits.
    """
    t = _c(time_sec).cast("double")
    wh = F.lit(cpu_watts) * (t / 3600.0) * F.lit(pue)
    kwh = wh / 1000.0
    world = kwh * CO2_WORLD_G_PER_KWH
    return F.struct(round_binary(wh, 4).alias("energy_wh"),
                    round_binary(kwh * CO2_FRANCE_G_PER_KWH, 4).alias("co2_france_g"),
                    round_binary(world, 4).alias("co2_world_g"),
                    round_binary(world / CAR_G_PER_KM, 5).alias("car_km_eq"))


_ROUNDERS: dict = {}


def round_binary(x, digits: int) -> Column:
    """Half-even rounding of the exact binary value of a double (Python's
    ``round``).  Spark's ``bround`` rounds the shortest decimal form instead,
    which differs when that form is an exact tie (0.03325 -> 0.0332 vs the
    binary value just above the tie -> 0.0333).  Arrow-batched pandas UDF,
    meant for report-sized tables (one row per model or run)."""
    if digits not in _ROUNDERS:
        @F.pandas_udf("double")
        def _round(s: pd.Series) -> pd.Series:
            return s.map(lambda v: v if v is None or v != v else round(float(v), digits))

        _ROUNDERS[digits] = _round
    return _ROUNDERS[digits](_c(x).cast("double"))


# ---------------------------------------------------------------- hashing
def key_hash_hex(key, salt: str) -> Column:
    """md5 hex of ``key || salt`` — identical in Spark and DuckDB."""
    return F.md5(F.concat(_c(key).cast("string"), F.lit(salt)))


def hash_unit(key, salt: str, digits: int = 8) -> Column:
    """Integer from the first ``digits`` hex chars of the key hash."""
    return F.conv(F.substring(key_hash_hex(key, salt), 1, digits), 16, 10).cast("long")
