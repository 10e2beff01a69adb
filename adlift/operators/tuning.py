"""Grid search of all four models and the fitted winners.

One scan each gives the folds' bins, cubes and moments (``cube``).  Then
* linear regression is solved and scored per fold from its Gram matrices;
* every fold's forest is grown once without limits, in blocks of ``TREES_PER_TASK``
  trees, and all 12 grid points are read off it (its first 100 trees, its nodes closed
  at a depth or below a size), the blocks' sums of predictions are added per fold;
* every (fold, depth, rate) is boosted once to the largest number of rounds;
* all networks train together (``mlp``).
Growing tasks get their fold's cube by a join and a range partitioning on the task
number; nothing but scores and, for the winners, tables of a size set by bins and
trees comes back.

A fitted tree model scores by its table of cells: rows are binned by column expressions
and joined with at most ``MAX_BINS**3 * 5`` predictions.  Models are saved as JSON plus
Parquet tables (``save`` / ``load_fitted``).
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlift.constants import CATEGORICAL, CATEGORIES, FEATURES, GBT_GRID, KEY, MLP_GRID, N_FOLDS, NUMERIC, RF_GRID, SEED, TARGET
from adlift.functions.scalar import slug_py
from adlift.operators import cube as C
from adlift.operators import forest as FO
from adlift.operators import mlp as MLP
from adlift.operators.prep import CampaignPreprocessorModel, output_columns
from adlift.session import shared_path

LR_NAME, RF_NAME, GBT_NAME, MLP_NAME = "Linear Regression", "Random Forest", "Gradient Boosting", "MLP (Deep Learning)"
MODELS = [LR_NAME, RF_NAME, GBT_NAME, MLP_NAME]
TREES_PER_TASK = 25
RIDGE = 1.0  # of boosted leaves, in rows
GRIDS = {RF_NAME: RF_GRID, GBT_NAME: GBT_GRID, MLP_NAME: MLP_GRID}


def points(name: str, grids: dict = GRIDS) -> list[dict]:
    grid = grids.get(name, {})
    return [dict(zip(grid, combo, strict=True)) for combo in product(*grid.values())]


def _limit(depth) -> int:
    return FO.UNLIMITED if depth is None else int(depth)


# -- growing on the executors -----------------------------------------------

def _fold_arrays(t: pd.DataFrame, extra: np.ndarray | None = None):
    """Cells of a fold: bins, training (n, s, ss) and held (n, s, ss)."""
    t = t.sort_values(["cell", "held"])
    cells = np.unique(t["cell"].to_numpy() if extra is None else np.concatenate([t["cell"].to_numpy(), extra]))
    out = np.zeros((2, 3, len(cells)))
    for held in (False, True):
        part = t[t["held"] == held]
        out[int(held)][:, np.searchsorted(cells, part["cell"].to_numpy())] = part[["n", "s", "ss"]].to_numpy().T
    return cells, C.cell_bins(cells), out[0], out[1]


def _per_task(cube: DataFrame, jobs: list[tuple], names: str, run, schema: str) -> DataFrame:
    """``run(job row, cube rows of its fold)`` for every job, each a task of its own."""
    spark = cube.sparkSession
    listed = F.broadcast(spark.createDataFrame([(i, *j) for i, j in enumerate(jobs)], f"job int, {names}"))

    def task(frames):
        frames = [f for f in frames if len(f)]
        if frames:
            for _, t in pd.concat(frames, ignore_index=True).groupby("job", sort=True):
                yield from run(t.iloc[0], t)
    return cube.join(listed, "fold").repartitionByRange(len(jobs), "job").mapInPandas(task, schema)


SCORES = "model string, point int, fold int, sse double, n double, s double, ss double"


def _forest_scores(cube: DataFrame, folds: list[int], grid: list[dict]) -> DataFrame:
    """Scores of all forest points from one growth per fold."""
    trees = max(p["numTrees"] for p in grid)
    cuts = sorted({(_limit(p["maxDepth"]), float(p["minSplit"])) for p in grid})
    counts = sorted({p["numTrees"] for p in grid})
    starts = sorted({0, *counts, *range(0, trees, TREES_PER_TASK)} - {trees})
    blocks = list(zip(starts, [*starts[1:], trees], strict=True))

    def grow_block(job, t):
        _, bins, (n, s, ss), held = _fold_arrays(t)
        sums = np.zeros((len(cuts), len(n)))
        for tree in range(job["first"], job["upto"]):
            sums += FO.grow(bins, *FO.bootstrap(n, s, ss, SEED, tree), cuts=cuts)[2]
        mine = held[0] > 0
        yield pd.DataFrame({"fold": [int(job["fold"])], "upto": [int(job["upto"])], "sums": [sums[:, mine].ravel()], "held": [held[:, mine].ravel()]})

    parts = _per_task(cube, [(f, a, b) for f in folds for a, b in blocks], "fold int, first int, upto int", grow_block,
                      "fold int, upto int, sums array<double>, held array<double>")

    def score(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("upto")
        n, s, ss = np.asarray(t["held"].iloc[0]).reshape(3, -1)
        total, out = np.zeros((len(cuts), len(n))), []
        for upto, sums in zip(t["upto"], t["sums"], strict=True):
            total += np.asarray(sums).reshape(total.shape)
            for i, p in enumerate(grid):
                if p["numTrees"] == upto:
                    y = total[cuts.index((_limit(p["maxDepth"]), float(p["minSplit"])))] / upto
                    out.append((RF_NAME, i, int(t["fold"].iloc[0]), float((ss - 2 * y * s + n * y * y).sum()), n.sum(), s.sum(), ss.sum()))
        return pd.DataFrame(out, columns=["model", "point", "fold", "sse", "n", "s", "ss"])
    return parts.groupBy("fold").applyInPandas(score, SCORES)


def _boost_scores(cube: DataFrame, folds: list[int], grid: list[dict]) -> DataFrame:
    """Scores of all boosting points, one run per (fold, depth, rate)."""
    runs = sorted({(p["maxDepth"], p["stepSize"]) for p in grid})

    def boost(job, t):
        depth, rate = int(job["depth"]), float(job["rate"])
        _, bins, (n, s, _), held = _fold_arrays(t)
        marks = {p["maxIter"]: i for i, p in enumerate(grid) if (p["maxDepth"], p["stepSize"]) == (depth, rate)}
        _, _, seen = FO.boost(bins, n, s, max(marks), depth, rate, RIDGE, tuple(marks))
        hn, hs, hss = held
        yield pd.DataFrame([(GBT_NAME, marks[r], int(job["fold"]), float((hss - 2 * y * hs + hn * y * y).sum()), hn.sum(), hs.sum(), hss.sum())
                            for r, y in seen.items()], columns=["model", "point", "fold", "sse", "n", "s", "ss"])
    jobs = [(f, d, r) for d, r in reversed(runs) for f in folds]  # the deepest, longest ones first
    return _per_task(cube, jobs, "fold int, depth int, rate double", boost, SCORES)


# -- fitted models ----------------------------------------------------------

TREE_SCHEMA = "tree int, weight double, " + ", ".join(f"{c} array<{'double' if c in ('value', 'cover') else 'long'}>" for c in FO.NODE_FIELDS)


def _refit(cube: DataFrame, name: str, p: dict, binning: C.Binning, path: str) -> dict:
    """Grow the winner on all rows; writes its trees and its cell table under ``path``."""
    cells, spark = binning.cells(), cube.sparkSession
    schema = TREE_SCHEMA + ", base double, sums array<double>"

    def rows(trees, first, weight, base, sums):
        for i, t in enumerate(trees):
            last = i == len(trees) - 1
            yield pd.DataFrame([{"tree": first + i, "weight": weight, **{c: t[c].tolist() for c in FO.NODE_FIELDS}, "base": base,
                                 "sums": sums.tolist() if last else None}])

    def grow_block(job, t):
        _, bins, (n, s, ss), _ = _fold_arrays(t, cells)
        trees, sums = [], np.zeros(len(n))
        for tree in range(job["first"], job["upto"]):
            nodes, pred, _ = FO.grow(bins, *FO.bootstrap(n, s, ss, SEED, tree), _limit(p["maxDepth"]), float(p["minSplit"]))
            trees.append(nodes)
            sums += pred / p["numTrees"]
        yield from rows(trees, int(job["first"]), 1.0 / p["numTrees"], 0.0, sums)

    def boost(job, t):
        _, bins, (n, s, _), _ = _fold_arrays(t, cells)
        base, trees, seen = FO.boost(bins, n, s, p["maxIter"], p["maxDepth"], p["stepSize"], RIDGE, (p["maxIter"],))
        yield from rows(trees, 0, p["stepSize"], base, seen[p["maxIter"]])

    if name == RF_NAME:
        blocks = [(C.ALL, a, min(a + TREES_PER_TASK, p["numTrees"])) for a in range(0, p["numTrees"], TREES_PER_TASK)]
        out = _per_task(cube, blocks, "fold int, first int, upto int", grow_block, schema)
    else:
        out = _per_task(cube, [(C.ALL, 0)], "fold int, first int", boost, schema)
    out.write.mode("overwrite").parquet(f"{path}/grown")
    grown = spark.read.parquet(f"{path}/grown")
    sums = grown.where("sums is not null").select("base", F.posexplode("sums").alias("at", "v"))
    table = sums.groupBy("at").agg(F.sum("v").alias("prediction"))
    listed = spark.createDataFrame(pd.DataFrame({"at": np.arange(len(cells)), "cell": cells}))  # MAX_BINS**3 * 5 at most
    table.join(listed, "at").select("cell", "prediction").write.mode("overwrite").parquet(f"{path}/cells")
    return {"base": grown.agg(F.max("base")).first()[0] or 0.0}


@dataclass
class Fitted:
    """A fitted model: ``transform`` adds ``prediction``; saved as JSON beside its tables."""

    spark: SparkSession
    path: str
    info: dict

    @property
    def name(self) -> str:
        return self.info["model"]

    @property
    def prep(self) -> CampaignPreprocessorModel:
        return CampaignPreprocessorModel(**{k: self.info[k] for k in ("medians", "means", "scales")})

    @property
    def binning(self) -> C.Binning:
        return C.Binning(tuple(self.info["medians"]), tuple(map(tuple, self.info["edges"])))

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.name == LR_NAME:
            x = [F.lit(b) * e for b, e in zip(self.info["beta"][1:], self.prep.feature_exprs().values(), strict=True)]
            total = F.lit(self.info["beta"][0])
            for e in x:
                total = total + e
            return df.withColumn(out, total)
        if self.name == MLP_NAME:
            return MLP.predict(MLP.raw_columns(df), self.network(), MLP.raw_features(), df.columns, out)
        table = self.spark.read.schema("cell long, prediction double").parquet(f"{self.path}/cells")
        table = table.toDF("__cell", out)
        return df.withColumn("__cell", self.binning.cell()).join(F.broadcast(table), "__cell", "left").drop("__cell")

    def network(self) -> MLP.Network:
        c = self.info["best_params"]
        cfg = MLP.MLPConfig(hidden=tuple(c["layers"]), alpha=c["alpha"], learning_rate=c["learningRate"])
        net = MLP.new_network(cfg, MLP.affine_of(self.prep))
        net.w = np.array(self.info["weights"])
        return net

    def coalition_scorer(self, features: list[str]):
        """For networks: (columns added to rows, their names, ``f(rows, background) -> (rows, coalitions)``),
        mean predictions with a coalition's raw features from the row and the others from the background."""
        if self.name != MLP_NAME or list(features) != FEATURES:
            return None
        net, names = self.network(), MLP.raw_features()
        owner = [FEATURES.index(c) if c in NUMERIC else FEATURES.index(CATEGORICAL) for c in names]
        masks = [np.array([bool(S >> f & 1) for f in owner]) for S in range(1 << len(FEATURES))]

        def values(rows: pd.DataFrame, background: list[dict]) -> np.ndarray:
            B = [[*[b[c] for c in NUMERIC], *[b[CATEGORICAL] == v for v in CATEGORIES]] for b in background]
            return MLP.coalition_values(net, rows[names].to_numpy(float), np.array(B, float), masks)
        return MLP.raw_columns, names, values

    def features(self, df: DataFrame) -> DataFrame:
        """Rows with the transformed feature columns."""
        return self.prep.transform(df)

    def trees(self) -> tuple[list[dict], list[float], float]:
        """Node arrays on the transformed features, weights and base value (size set by the trees)."""
        rows = self.spark.read.parquet(f"{self.path}/grown").drop("sums").orderBy("tree").collect()
        means, scales = self.info["means"], self.info["scales"]
        border = [np.array([(e - m) / s for e in edges]) for edges, m, s in zip(self.info["edges"], means, scales, strict=True)]
        out = []
        for r in rows:
            t = {c: np.array(r[c]) for c in FO.NODE_FIELDS}
            cut = np.full(len(t["bin"]), 0.5)  # 0 / 1 columns
            for j in range(len(NUMERIC)):
                at = t["feature"] == j
                cut[at] = border[j][t["bin"][at]] if len(border[j]) else 0.0
            out.append({"feature": np.maximum(t["feature"], 0), "threshold": cut, "left": t["left"], "right": t["right"],
                        "value": t["value"].astype(float), "cover": t["cover"].astype(float)})
        return out, [float(r["weight"]) for r in rows], float(self.info.get("base", 0.0))

    def importances(self) -> list[float]:
        """Share of the squared-error reduction per transformed feature (split gain)."""
        total = np.zeros(len(output_columns()))
        for t in self.trees()[0]:
            inner = np.flatnonzero(t["left"] >= 0)
            at = lambda i: t["cover"][i] * t["value"][i] ** 2
            np.add.at(total, t["feature"][inner], at(t["left"][inner]) + at(t["right"][inner]) - at(inner))
        total = np.maximum(total, 0.0)
        return (total / total.sum() if total.sum() else total).tolist()

    def save(self) -> str:
        row = self.spark.createDataFrame([(json.dumps(self.info),)], "info string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/info")
        return self.path


def load_fitted(spark: SparkSession, path: str) -> Fitted:
    from adlift.sources.results import read_table
    return Fitted(spark, path, json.loads(read_table(spark, f"{path}/info").first()["info"]))


# -- search -----------------------------------------------------------------

def _mean_scores(rows: list) -> dict[int, tuple[float, float]]:
    by: dict = {}
    for r in rows:
        if r["n"]:
            spread = r["ss"] - r["s"] ** 2 / r["n"]
            by.setdefault(r["point"], []).append((np.sqrt(max(r["sse"], 0.0) / r["n"]), 1 - r["sse"] / spread if spread > 0 else 0.0))
    return {p: tuple(map(float, np.mean(x, axis=0))) for p, x in by.items()}


class Search:
    """Tuning of single models on one folded table.  What models share (the folds'
    preprocessors, the cube) and each model's search run once, when first asked for;
    concurrent callers wait for them."""

    def __init__(self, folded: DataFrame, grids: dict = GRIDS, n_folds: int = N_FOLDS, root: str | None = None,
                 label: str = TARGET, epochs: int = 500, patience: int = 20) -> None:
        self.folded, self.grids, self.folds, self.label = folded, grids, list(range(n_folds)), label
        self.epochs, self.patience = epochs, patience
        self.spark = folded.sparkSession
        self.root = root or shared_path(self.spark, f"models/{uuid.uuid4().hex[:12]}")
        self._done: dict = {}
        self._lock = threading.RLock()

    def _once(self, key: str, make):
        """``(value, seconds)`` of ``make()``, computed once."""
        with self._lock:
            if key not in self._done:
                start = time.time()
                value = make()
                self._done[key] = (value, time.time() - start)
            return self._done[key]

    def _preps(self):
        return self._once("preps", lambda: C.fit_preprocessors(self.folded, [*self.folds, C.ALL]))

    def _cube(self):
        preps, _ = self._preps()

        def make():
            binnings = C.fit_binnings(self.folded, preps)
            path = shared_path(self.spark, f"cubes/{uuid.uuid4().hex[:12]}")
            C.build_cube(self.folded, binnings, self.label).write.parquet(path)
            return binnings, self.spark.read.schema(C.CUBE_SCHEMA).parquet(path)
        return self._once("cube", make)

    def result(self, name: str) -> dict:
        """All grid points of a model with mean RMSE and R2 over the folds (``results``), the
        best one, seconds (with its share of the common steps), and the model fitted with it
        on all rows (``fitted``, saved under ``root``)."""
        return self._once(name, lambda: self._search(name))[0]

    def _search(self, name: str) -> dict:
        folded, folds, label, spark = self.folded, self.folds, self.label, self.spark
        grid, where, extra = points(name, self.grids), f"{self.root}/{slug_py(name)}", {}
        preps, seconds = self._preps()
        final = preps[C.ALL]
        info = {k: list(map(float, final.getOrDefault(k))) for k in ("medians", "means", "scales")}
        if name in (RF_NAME, GBT_NAME):
            (binnings, cube), more = self._cube()
            seconds += more
        start = time.time()
        if name == LR_NAME:
            groups, rows = C.moment_groups(folded, label), []
            for f in folds:
                beta = C.solve(C.gram(groups, preps[f], [x for x in folds if x != f], label))
                sse, n, s, ss = C.gram_errors(C.gram(groups, preps[f], [f], label), beta)
                rows.append({"point": 0, "sse": sse, "n": n, "s": s, "ss": ss})
            scores = _mean_scores(rows)
            extra["beta"] = C.solve(C.gram(groups, final, folds, label)).tolist()
        elif name == MLP_NAME:
            r = MLP.cross_validate_mlp(folded, grid, preps, len(folds), self.epochs, self.patience, label)
            scores = {i: (x["cv_rmse"], x["cv_r2"]) for i, x in enumerate(r["results"])}
            extra["weights"], extra["epochs"] = r["network"].weights.tolist(), r["epochs"]
        else:
            scores = _mean_scores((_forest_scores if name == RF_NAME else _boost_scores)(cube, folds, grid).collect())
            extra["edges"] = [list(e) for e in binnings[C.ALL].edges]
        best = min(scores, key=lambda i: (scores[i][0], i))
        if name in (RF_NAME, GBT_NAME):
            extra |= _refit(cube, name, grid[best], binnings[C.ALL], where)
        results = [{"params": p, "cv_rmse": scores[i][0], "cv_r2": scores[i][1]} for i, p in enumerate(grid)]
        fitted = Fitted(spark, where, info | extra | {"model": name, "best_params": grid[best], "cv_rmse": scores[best][0], "cv_r2": scores[best][1]})
        fitted.save()
        return {"model": name, "cv_rmse": scores[best][0], "cv_r2": scores[best][1], "best_params": grid[best], "results": results,
                "time_sec": seconds + time.time() - start, "fitted": fitted}


def tune(folded: DataFrame, names: list[str] = MODELS, grids: dict = GRIDS, n_folds: int = N_FOLDS, root: str | None = None,
         label: str = TARGET, epochs: int = 500, patience: int = 20) -> list[dict]:
    """``Search.result`` of every model."""
    search = Search(folded, grids, n_folds, root, label, epochs, patience)
    return [search.result(n) for n in names]


def out_of_fold_rmse(folded: DataFrame, fitted: Fitted, label: str = TARGET) -> float:
    """RMSE of a fitted model on rows (a plain check of the cell tables)."""
    err = F.col("prediction") - F.col(label)
    return float(fitted.transform(folded.select(KEY, *NUMERIC, "influencer", label)).agg(F.sqrt(F.avg(err * err))).first()[0])
