"""Binned feature cube: what tree models need to know of a table of any size.

Numeric features are cut at quantiles into at most ``MAX_BINS`` bins, the category
keeps its levels, so a row falls into one of at most ``MAX_BINS**3 * 5`` cells.  A
split on a bin border sees a row only through its cell; count, sum and sum of
squares of the target per cell therefore replace the rows in growing, cutting and
scoring trees (exactly: all rows of a cell get the same prediction).  The cube is one
map-side combined aggregate whose size is set by the bins, not by the data.

Every fold has bins, medians and a cube of its own, from the rows outside it; its
``held`` half holds the fold's own rows.  Fold ``ALL`` is fitted on all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlift.constants import CATEGORICAL, CATEGORIES, NUMERIC, TARGET
from adlift.operators.prep import CampaignPreprocessorModel
from adlift.operators.quantiles import SELECT_BINS, SELECT_SMALL, grouped_with_quantiles

MAX_BINS = 32
EDGE_ACCURACY = 10_000  # of the quantile sketch the borders come from
ALL = -1
LEVELS = len(CATEGORIES) + 1  # the last one: missing or unknown
CUBE_SCHEMA = "fold int, cell long, held boolean, n double, s double, ss double"


@dataclass(frozen=True)
class Binning:
    """Cell of a row: medians for missing numbers, borders per number, category levels."""

    medians: tuple[float, ...]
    edges: tuple[tuple[float, ...], ...]

    def cell(self) -> Column:
        out = F.lit(0).cast("long")
        for c, median, edges in zip(NUMERIC, self.medians, self.edges, strict=True):
            x = F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(median))
            out = out * MAX_BINS + _bin(x, edges, 0)
        level = F.lit(LEVELS - 1)
        for i, v in enumerate(CATEGORIES):
            level = F.when(F.col(CATEGORICAL) == v, i).otherwise(level)
        return out * LEVELS + level

    def cells(self) -> np.ndarray:
        """Every cell a row can fall into."""
        grid = np.meshgrid(*[np.arange(len(e) + 1) for e in self.edges], np.arange(LEVELS), indexing="ij")
        return np.sort(_join([g.ravel() for g in grid]))


def _bin(x: Column, edges: tuple[float, ...], first: int) -> Column:
    """Number of borders below ``x``, found by halving."""
    if not edges:
        return F.lit(first).cast("long")
    mid = len(edges) // 2
    return F.when(x > F.lit(edges[mid]), _bin(x, edges[mid + 1:], first + mid + 1)).otherwise(_bin(x, edges[:mid], first))


def _join(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0].astype(np.int64)
    for p in parts[1:-1]:
        out = out * MAX_BINS + p
    return out * LEVELS + parts[-1]


def cell_bins(cells: np.ndarray) -> np.ndarray:
    """Bins of the transformed features (the numbers, then one 0 / 1 column per category)."""
    level, rest = cells % LEVELS, cells // LEVELS
    numbers = []
    for _ in NUMERIC:
        numbers.append(rest % MAX_BINS)
        rest = rest // MAX_BINS
    return np.stack([*numbers[::-1], *[(level == i).astype(np.int64) for i in range(len(CATEGORIES))]]).T  # a column is contiguous


def fit_preprocessors(folded: DataFrame, folds: list[int]) -> dict[int, CampaignPreprocessorModel]:
    """A preprocessor per fold, fitted on the rows outside it (``ALL``: on all rows); all
    folds' medians in one selection, their means and scales from moments of the single folds."""
    aggs = [f(c).alias(f"{name}:{c}") for c in NUMERIC for name, f in (
        ("n", F.count), ("lo", F.min), ("hi", F.max), ("mean", F.avg), ("var", F.var_pop),
        ("known", lambda c: F.count(_number(c))), ("least", lambda c: F.min(_number(c))), ("most", lambda c: F.max(_number(c))))]
    parts = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), *aggs).collect()
    median, out = _medians(folded, folds, parts), {}
    for f in folds:
        moments = [_filled([r for r in parts if r["fold"] != f], c, median.get((f, c), 0.0)) for c in NUMERIC]
        out[f] = CampaignPreprocessorModel(medians=[median.get((f, c), 0.0) for c in NUMERIC],
                                           means=[mean for mean, _ in moments], scales=[std or 1.0 for _, std in moments])
    return out


def _number(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c).cast("double"))


def _medians(folded: DataFrame, folds: list[int], parts: list) -> dict[tuple[int, str], float]:
    """Exact medians ``(fold, number)`` of the rows outside each fold.

    The values between which all folds' medians lie are narrowed down together, from counts per
    (fold, sub-range) of rows that are not repeated per fold, until few are left, which the driver
    ranks.  A number whose range does not narrow (or is infinite) goes through the general selection."""
    known = {(r["fold"], c): r[f"known:{c}"] for r in parts for c in NUMERIC}
    ranks = {}  # (fold, number): ranks of the two middle values
    for f in folds:
        for c in NUMERIC:
            if n := sum(k for (g, d), k in known.items() if d == c and g != f):
                ranks[f, c] = ((n - 1) // 2, n // 2)
    window, below, left = {}, dict.fromkeys(known, 0), {}
    for c in {c for _, c in ranks}:
        window[c] = (min(r[f"least:{c}"] for r in parts if known[r["fold"], c]), max(r[f"most:{c}"] for r in parts if known[r["fold"], c]))
        left[c] = sum(k for (_, d), k in known.items() if d == c)
    general = {c for c, (lo, hi) in window.items() if not np.isfinite(hi - lo)}
    rows = folded.select("fold", *[_number(c).alias(c) for c in NUMERIC]).unpivot(["fold"], NUMERIC, "feature", "value")

    def inside(numbers):
        return reduce(Column.__or__, [(F.col("feature") == c) & F.col("value").between(*window[c]) for c in numbers])
    while wide := [c for c in window if c not in general and left[c] > SELECT_SMALL and window[c][0] < window[c][1]]:
        place = F.coalesce(*[F.when(F.col("feature") == c, (F.col("value") - window[c][0]) / (window[c][1] - window[c][0])) for c in wide])
        counted = rows.where(inside(wide)).groupBy("fold", "feature", F.floor(place * SELECT_BINS).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        for c in wide:
            mine = sorted((r for r in counted if r["feature"] == c), key=lambda r: r["bin"])
            bins = sorted({r["bin"] for r in mine})
            at, counts = {b: i for i, b in enumerate(bins)}, {g: np.zeros(len(bins), np.int64) for g, d in known if d == c}
            for r in mine:
                counts[r["fold"]][at[r["bin"]]] += r["n"]
            hit = [int(np.searchsorted(np.cumsum(sum(n for g, n in counts.items() if g != f)) + sum(below[g, c] for g in counts if g != f), k, side="right"))
                   for (f, d), ks in ranks.items() if d == c for k in ks]
            first, last = bins[min(hit)], bins[max(hit)]
            held = [r for r in mine if first <= r["bin"] <= last]
            for g, n in counts.items():
                below[g, c] += int(n[:min(hit)].sum())
            new = (min(r["lo"] for r in held), max(r["hi"] for r in held))
            if new == window[c]:
                general.add(c)
            window[c], left[c] = new, sum(r["n"] for r in held)
    out = {k: window[k[1]][0] for k in ranks if k[1] not in general and window[k[1]][0] == window[k[1]][1]}
    if few := [c for c in window if c not in general and window[c][0] < window[c][1]]:
        values = {}
        for r in rows.where(inside(few)).collect():  # SELECT_SMALL a number
            values.setdefault(r["feature"], []).append((r["value"], r["fold"]))
        for (f, c), ks in ranks.items():
            if c in few:
                x = sorted(v for v, g in values[c] if g != f)
                low, high = (x[k - sum(n for (g, d), n in below.items() if d == c and g != f)] for k in ks)
                out[f, c] = low if low == high else 0.5 * low + 0.5 * high
    if general:
        outside = F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col("fold"))
        long = rows.where(F.col("feature").isin(sorted(general))).select("feature", "value", F.explode(outside).alias("outside"))
        found = grouped_with_quantiles(long, ["outside", "feature"], "value", {"median": 0.5}, []).collect()
        out |= {(r["outside"], r["feature"]): float(r["median"]) for r in found if r["median"] is not None}
    return out


def _filled(parts: list, c: str, fill: float) -> tuple[float, float]:
    """Mean and standard deviation of a number over ``parts`` (moments of one fold each), its missing values ``fill``."""
    n, mean, squares = 0, 0.0, 0.0
    for r in parts:
        same = r[f"lo:{c}"] == r[f"hi:{c}"]  # one value: no rounding of its sum, so that it does not seem to vary
        known = (r[f"n:{c}"], r[f"lo:{c}"] if same else r[f"mean:{c}"], 0.0 if same else r[f"var:{c}"])
        for k, m, v in (known, (r["rows"] - r[f"n:{c}"], fill, 0.0)):
            if k:
                n, delta = n + k, m - mean
                squares += k * v + delta * delta * (n - k) * (k / n)
                mean = m if n == k else mean + delta * (k / n)
    return float(mean), float(np.sqrt(squares / n)) if n else 0.0


def fit_binnings(folded: DataFrame, preps: dict[int, CampaignPreprocessorModel]) -> dict[int, Binning]:
    """Bin borders of all folds in one pass."""
    probs = [i / MAX_BINS for i in range(1, MAX_BINS)]
    aggs = []
    for f in preps:
        for c in NUMERIC:
            x = F.col(c) if f == ALL else F.when(F.col("fold") != f, F.col(c))
            aggs.append(F.percentile_approx(F.when(~F.isnan(x), x), probs, EDGE_ACCURACY).alias(f"{c}:{f}"))
    row = folded.agg(*aggs).first()
    return {f: Binning(tuple(p.getOrDefault("medians")), tuple(tuple(sorted(set(row[f"{c}:{f}"] or []))) for c in NUMERIC))
            for f, p in preps.items()}


def build_cube(folded: DataFrame, binnings: dict[int, Binning], label: str = TARGET) -> DataFrame:
    """``CUBE_SCHEMA`` for all folds, in one aggregate."""
    y = F.col(label).cast("double")
    known = folded.where(y.isNotNull())
    parts = [known.select(F.lit(f).alias("fold"), b.cell().alias("cell"), (F.col("fold") == f).alias("held"), y.alias("y"))
             for f, b in binnings.items()]  # one projection a fold: all in one would outgrow generated code
    return reduce(DataFrame.unionByName, parts).groupBy("fold", "cell", "held").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))


# -- linear model from moments ----------------------------------------------

def moment_groups(folded: DataFrame, label: str = TARGET) -> list:
    """Raw moments per (fold, which numbers are missing, category): at most 5 * 8 * 5 rows,
    from which the Gram matrix under any fold's medians and scales follows exactly."""
    cols = [*NUMERIC, label]
    x = {c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)) for c in cols}
    level = F.when(F.col(CATEGORICAL).isin(CATEGORIES), F.col(CATEGORICAL)).alias("level")
    gone = [(F.col(c).isNull() | F.isnan(c)).alias(f"no_{c}") for c in NUMERIC]
    aggs = [F.sum(x[a] * x[b]).alias(f"{a}*{b}") for i, a in enumerate(cols) for b in cols[i:]]
    rows = folded.where(F.col(label).isNotNull()).select("fold", *cols, *gone, level)
    return rows.groupBy("fold", *[f"no_{c}" for c in NUMERIC], "level").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x[c]).alias(c) for c in cols], *aggs).collect()


def gram(groups: list, prep: CampaignPreprocessorModel, folds, label: str = TARGET) -> np.ndarray:
    """Gram matrix of (1, transformed features, target) over the rows of ``folds``."""
    cols = [*NUMERIC, label]
    medians, means, scales = (prep.getOrDefault(k) for k in ("medians", "means", "scales"))
    size = 2 + len(NUMERIC) + len(CATEGORIES)
    out = np.zeros((size, size))
    for r in groups:
        if r["fold"] not in folds:
            continue
        raw = np.empty((5, 5))  # moments of (1, numbers, target)
        raw[0, 0] = r["n"]
        for i, a in enumerate(cols):
            raw[0, i + 1] = raw[i + 1, 0] = r[a]
            for j, b in enumerate(cols[i:], i):
                raw[i + 1, j + 1] = raw[j + 1, i + 1] = r[f"{a}*{b}"]
        t = np.zeros((size, 5))  # transformed = t @ (1, numbers, target)
        t[0, 0] = t[-1, -1] = 1.0
        for i, c in enumerate(NUMERIC):
            if r[f"no_{c}"]:
                t[1 + i, 0] = (medians[i] - means[i]) / scales[i]
            else:
                t[1 + i, 0], t[1 + i, 1 + i] = -means[i] / scales[i], 1.0 / scales[i]
        if r["level"] is not None:
            t[1 + len(NUMERIC) + CATEGORIES.index(r["level"]), 0] = 1.0
        out += t @ raw @ t.T
    return out


def solve(g: np.ndarray) -> np.ndarray:
    """Minimum-norm least squares (intercept first) of a Gram matrix with the target last."""
    return np.linalg.pinv(g[:-1, :-1]) @ g[:-1, -1]


def gram_errors(g: np.ndarray, beta: np.ndarray) -> tuple[float, float, float, float]:
    """(squared error, rows, target sum, target square sum) of ``beta`` on the rows of ``g``."""
    d = np.append(-beta, 1.0)
    return float(d @ g @ d), float(g[0, 0]), float(g[0, -1]), float(g[-1, -1])
