"""Query registry: each key maps to a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where the result is expressible in SQL, to a DuckDB oracle string.

Oracle strings see the driver tables as views; every oracle starts from the
same campaign view as the Spark side (``CAMPAIGNS_CTES``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6

# Campaign view (SQL twin of adlift.sources.campaigns.campaigns).
CAMPAIGNS_CTES = """
l AS (
  SELECT l_orderkey AS k,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS p,
         CAST(l_discount AS DECIMAL(4,2)) AS d,
         CAST(l_tax AS DECIMAL(4,2)) AS t,
         CAST(l_quantity AS DECIMAL(8,2)) AS q
  FROM lineitem),
a AS (
  SELECT k, SUM(p) AS tv, SUM(q) AS radio, SUM(p*d) AS sm, SUM(p*(1-d)*(1+t)) AS s
  FROM l GROUP BY k),
campaigns AS (
SELECT o_orderkey AS campaign_id,
  CASE WHEN o_orderkey % 113 = 0 THEN NULL ELSE CAST(tv AS DOUBLE)/1000 END AS tv,
  CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE CAST(radio AS DOUBLE) END AS radio,
  CASE WHEN o_orderkey % 307 = 0 THEN NULL ELSE CAST(sm AS DOUBLE)/1000 END AS social_media,
  CASE WHEN o_orderkey % 401 = 0 THEN NULL
       WHEN o_custkey % 4 = 0 THEN 'Nano' WHEN o_custkey % 4 = 1 THEN 'Micro'
       WHEN o_custkey % 4 = 2 THEN 'Macro' ELSE 'Mega' END AS influencer,
  CASE WHEN o_orderkey % 503 = 0 THEN NULL ELSE CAST(s AS DOUBLE)/1000 END AS sales
FROM orders JOIN a ON o_orderkey = k),
clean AS (SELECT * FROM campaigns WHERE sales IS NOT NULL)"""


def query(name: str, sql: str | None = None, round_cols: list[str] | dict | None = None,
          digits: int = DIGITS):
    """Register a Spark query; ``sql`` is the body after the campaign CTEs.

    ``round_cols`` lists the double outputs rounded to ``digits`` on both
    sides (or maps a column to its own digits), so the value hash does not
    depend on summation order.
    """
    def deco(fn: Callable) -> Callable:
        def run(spark, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), round_cols or [], digits)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, round_cols or [], digits)
        return run
    return deco


def _digits(cols, digits: int) -> dict:
    return dict(cols) if isinstance(cols, dict) else {c: digits for c in cols}


def round_doubles(df: DataFrame, cols, digits: int = DIGITS) -> DataFrame:
    if not cols:
        return df
    # "+ 0.0" turns a rounded -0.0 into 0.0 (IEEE), identically in both engines
    return df.withColumns({c: F.round(F.col(c).cast(T.DoubleType()), d) + F.lit(0.0)
                           for c, d in _digits(cols, digits).items()})


def _bigint_count_if(sql: str) -> str:
    """Wrap every ``count_if(...)`` in ``CAST(... AS BIGINT)``: DuckDB returns
    HUGEINT where Spark returns bigint."""
    out, i, token = [], 0, "count_if("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(token) - 1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        inner = sql[j + len(token):k]
        out.append(sql[i:j] + "CAST(count_if(" + _bigint_count_if(inner) + ") AS BIGINT)")
        i = k + 1


def oracle(body: str, round_cols, digits: int = DIGITS) -> str:
    """Full DuckDB statement: campaign CTEs, then ``body`` (which may add CTEs
    with a leading comma) and the rounding of ``round_cols``."""
    body = _bigint_count_if(body.strip())
    if body.startswith(","):
        full = f"WITH {CAMPAIGNS_CTES}{body}"
    else:
        full = f"WITH {CAMPAIGNS_CTES}\n{body}"
    if not round_cols:
        return full
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), {d}) + CAST(0 AS DOUBLE) AS {c}"
                    for c, d in _digits(round_cols, digits).items())
    return f"SELECT * REPLACE ({rep}) FROM ({full}) AS q"
