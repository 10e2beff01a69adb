"""Energy / CO2 footprint of training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlift.functions.scalar import emissions, round_binary

REPORT_COLS = ["time_sec", "energy_wh", "co2_france_g", "co2_world_g", "car_km_eq"]
DIGITS = {"time_sec": 2, "energy_wh": 4, "co2_france_g": 4, "co2_world_g": 4, "car_km_eq": 5}


def require_columns(df: DataFrame, cols: list[str]) -> None:
    """Raise before any job when a required column is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"required column(s) missing: {missing}")


def footprint_report(runs: DataFrame, model: str = "model", time_col: str = "time_sec") -> DataFrame:
    """Per run: time (rounded 2), energy and CO2 estimates (4/4/4/5 digits),
    sorted by CO2; a TOTAL row sums the already rounded columns."""
    require_columns(runs, [time_col])
    name = F.coalesce(F.col(model).cast("string"), F.lit("?")) if model in runs.columns else F.lit("?")
    t = F.col(time_col).cast("double")
    per = runs.select(name.alias("model"), round_binary(t, 2).alias("time_sec"), emissions(t).alias("e")) \
        .select("model", "time_sec", "e.*")
    total = per.agg(F.lit("TOTAL").alias("model"),
                    *[F.sum(c).alias(c) for c in REPORT_COLS])
    total = total.select("model", *[round_binary(F.col(c), DIGITS[c]).alias(c) for c in REPORT_COLS])
    order = F.when(F.col("model") == "TOTAL", 1).otherwise(0)
    # window over the report (one row per run)
    return (per.unionByName(total)
            .withColumn("position", F.row_number().over(Window.orderBy(order, "co2_france_g", "model"))))
