"""The tuning jobs: every grid point of the studied project, equal to models fitted one by one."""

import math
import pickle
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from adlift.constants import FEATURES, KEY, TARGET
from adlift.operators import cube as C
from adlift.operators import forest as FO
from adlift.operators import mlp as MLP
from adlift.operators import split as S
from adlift.operators import treeshap as TS
from adlift.operators import tuning as TU
from adlift.operators.prep import CampaignPreprocessor, output_columns
from adlift.operators.profile import clean_target
from adlift.sources import registry as REG
from adlift.sources.campaigns import campaigns
from adlift.sources.results import MissingInput

from conftest import SF_SMALL

SMALL = {TU.RF_NAME: {"numTrees": [3, 7], "maxDepth": [None, 2, 4], "minSplit": [2, 30]},
         TU.GBT_NAME: {"maxIter": [4, 9], "maxDepth": [2, 3], "stepSize": [0.1, 0.3]},
         TU.MLP_NAME: {"layers": [(8,)], "alpha": [1e-4, 1e-3], "learningRate": [1e-2]}}


@pytest.fixture(scope="module")
def folded(spark):
    clean = clean_target(campaigns(spark, SF_SMALL))
    return S.kfold(S.train_test_split(clean).where("split = 'train'")).select(KEY, *FEATURES, TARGET, "fold").cache()


@pytest.fixture(scope="module")
def small_search(folded):
    return {r["model"]: r for r in TU.tune(folded, grids=SMALL, epochs=4)}


def test_the_grid_has_the_41_points():
    assert [len(TU.points(m)) for m in TU.MODELS] == [1, 12, 12, 16]


def _walk(nodes, bins):
    out = np.empty(len(bins))
    for i, x in enumerate(bins):
        at = 0
        while nodes["left"][at] >= 0:
            at = nodes["right"][at] if x[nodes["feature"][at]] > nodes["bin"][at] else nodes["left"][at]
        out[i] = nodes["value"][at]
    return out


def _fold_rows(folded, f, prep):
    rows = folded.withColumn("cell", C.fit_binnings(folded, {f: prep})[f].cell()).toPandas().sort_values("cell")
    return rows[rows["fold"] != f], rows[rows["fold"] == f]


def test_points_equal_models_grown_and_scored_apart(folded, small_search):
    preps = {f: CampaignPreprocessor().fit(folded.where(F.col("fold") != f)) for f in range(5)}
    rmse = {}
    for f, prep in preps.items():
        train, held = _fold_rows(folded, f, prep)
        cells, at = np.unique(np.concatenate([train["cell"], held["cell"]]), return_inverse=True)
        bins, at, mine = C.cell_bins(cells), at[:len(train)], at[len(train):]
        y, n = train[TARGET].to_numpy(), np.bincount(at, minlength=len(cells)).astype(float)
        s, ss = np.bincount(at, y, len(cells)), np.bincount(at, y * y, len(cells))
        for p in TU.points(TU.RF_NAME, SMALL):
            trees = [FO.grow(bins, *FO.bootstrap(n, s, ss, TU.SEED, t), TU._limit(p["maxDepth"]), p["minSplit"])[0] for t in range(p["numTrees"])]
            pred = np.mean([_walk(t, bins[mine]) for t in trees], axis=0)
            rmse.setdefault((TU.RF_NAME, str(p)), []).append(np.sqrt(np.mean((pred - held[TARGET]) ** 2)))
        for p in TU.points(TU.GBT_NAME, SMALL):
            base, trees, _ = FO.boost(bins, n, s, p["maxIter"], p["maxDepth"], p["stepSize"], TU.RIDGE)
            pred = base + p["stepSize"] * sum(_walk(t, bins[mine]) for t in trees)
            rmse.setdefault((TU.GBT_NAME, str(p)), []).append(np.sqrt(np.mean((pred - held[TARGET]) ** 2)))
    for name in (TU.RF_NAME, TU.GBT_NAME):
        for r in small_search[name]["results"]:
            assert r["cv_rmse"] == pytest.approx(np.mean(rmse[name, str(r["params"])]), rel=1e-9)


def test_a_tree_takes_the_best_split():
    rng = np.random.default_rng(1)
    bins = np.stack([rng.integers(0, 6, 80), rng.integers(0, 3, 80)], axis=1)
    w, y = rng.integers(0, 4, 80).astype(float), rng.normal(size=80)
    nodes, pred, _ = FO.grow(bins, w, w * y, max_depth=1)
    best = max(((w[m] @ y[m]) ** 2 / w[m].sum() + (w[~m] @ y[~m]) ** 2 / w[~m].sum(), j, b)
               for j, top in ((0, 5), (1, 2)) for b in range(top) for m in [bins[:, j] <= b])
    assert (nodes["feature"][0], nodes["bin"][0]) == best[1:]
    full = FO.grow(bins, w, w * y)[0]  # wide tables and lists of bins agree, whatever the size of the level
    assert (full["cover"][full["left"] < 0].sum(), full["cover"][0]) == (w.sum(), w.sum())


def test_preprocessors_of_all_folds_equal_single_fits(folded):
    got = C.fit_preprocessors(folded, [0, 3, C.ALL])
    for f, m in got.items():
        want = CampaignPreprocessor().fit(folded if f == C.ALL else folded.where(F.col("fold") != f))
        for k in ("medians", "means", "scales"):
            assert m.getOrDefault(k) == pytest.approx(want.getOrDefault(k), rel=1e-12)


def test_moments_of_folds_add_up(spark):
    rows = [(i, i % 3, 0.1, None if i % 4 else float(i), 1e9 + i) for i in range(60)]
    folded = spark.createDataFrame(rows, f"{KEY} long, fold int, tv double, radio double, social_media double")
    got = C.fit_preprocessors(folded, [0, 1, 7, C.ALL])  # fold 7 has no rows
    for f, m in got.items():
        part = [r for r in rows if r[1] != f]
        for i, (median, mean, scale) in enumerate(zip(*(m.getOrDefault(k) for k in ("medians", "means", "scales")), strict=True)):
            known = np.array([r[2 + i] for r in part if r[2 + i] is not None])
            x = np.append(known, np.full(len(part) - len(known), np.median(known)))
            assert (median, mean) == pytest.approx((np.median(known), x.mean()), rel=1e-12)
            assert scale == (1.0 if i == 0 else pytest.approx(x.std(), rel=1e-9))


def test_medians_of_all_folds_narrow_together(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 600
    tv = np.where(rng.random(n) < 0.3, 2.5, rng.lognormal(0, 9, n))
    radio = [None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(x) for i, x in enumerate(rng.normal(size=n))]
    social = [float("inf") if i % 5 == 0 else float(x) for i, x in enumerate(rng.choice([0.0, 8.0], n))]
    rows = [(i, int(rng.integers(0, 5)), float(tv[i]), radio[i], social[i]) for i in range(n)]
    folded = spark.createDataFrame(rows, f"{KEY} long, fold int, tv double, radio double, social_media double").cache()
    for bins, small, general in ((8, 20, None), (4096, 4096, None), (8, 20, 1)):
        monkeypatch.setattr(C, "SELECT_BINS", bins)
        monkeypatch.setattr(C, "SELECT_SMALL", small)
        asked = []
        plain = C.grouped_with_quantiles
        with monkeypatch.context() as m:
            m.setattr(C, "grouped_with_quantiles", lambda df, *a: asked.append({r["feature"] for r in df.select("feature").distinct().collect()}) or plain(df, *a))
            got = C.fit_preprocessors(folded.drop("social_media").withColumn("social_media", F.lit(3.0)) if general is None else folded, [0, 3, C.ALL])
        assert asked == ([] if general is None else [{"social_media"}])  # the others without a row per fold
        for f, model in got.items():
            for i in range(2 if general is None else 3):
                x = np.array([r[2 + i] for r in rows if r[1] != f and r[2 + i] is not None and not math.isnan(r[2 + i])])
                assert model.getOrDefault("medians")[i] == pytest.approx(np.median(x), rel=1e-14)


def test_linear_regression_from_moments(folded, small_search):
    rmse = []
    for f in range(5):
        prep = CampaignPreprocessor().fit(folded.where(F.col("fold") != f))
        rows = prep.transform(folded).toPandas()
        x = np.column_stack([np.ones(len(rows)), rows[output_columns()].to_numpy()])
        mine = (rows["fold"] == f).to_numpy()
        beta = np.linalg.lstsq(x[~mine], rows[TARGET][~mine], rcond=None)[0]
        rmse.append(np.sqrt(np.mean((x[mine] @ beta - rows[TARGET][mine]) ** 2)))
    assert small_search[TU.LR_NAME]["cv_rmse"] == pytest.approx(np.mean(rmse), rel=1e-8)


@pytest.mark.parametrize("name", TU.MODELS)
def test_saved_models_load_and_score_alike(spark, folded, small_search, name):
    m = small_search[name]["fitted"]
    back = TU.load_fitted(spark, m.path)
    rows = folded.unionByName(spark.createDataFrame([(-1, 1e6, None, -5.0, "Giga", 1.0, 0)], folded.schema))
    a = {r[KEY]: r["prediction"] for r in m.transform(rows).collect()}
    assert a == {r[KEY]: r["prediction"] for r in back.transform(rows).collect()} and len(a) == rows.count()
    assert all(math.isfinite(v) for v in a.values())


@pytest.mark.parametrize("name", [TU.RF_NAME, TU.GBT_NAME])
def test_trees_on_features_predict_as_the_cell_table(folded, small_search, name):
    m = small_search[name]["fitted"]
    trees, weights, base = m.trees()
    rows = {r[KEY]: r for r in TS.tree_shap(m.features(folded), trees, weights, output_columns(), KEY, base).collect()}
    for r in m.transform(folded).collect():
        e = rows[r[KEY]]
        assert e["prediction"] == pytest.approx(r["prediction"], rel=1e-9)
        assert e["base_value"] + sum(e["contributions"]) == pytest.approx(e["prediction"], rel=1e-9)


def test_tree_shap_with_twenty_features():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 2, (400, 20))
    y = bins @ rng.normal(size=20) + bins[:, 0] * bins[:, 1]
    t = FO.grow(bins, np.ones(400), y)[0]
    tree = {**t, "feature": np.maximum(t["feature"], 0), "threshold": t["bin"] + 0.5}
    base, phi, pred = TS.tree_shap_matrix([tree], [1.0], bins[:50].astype(float))
    assert np.allclose(base + phi.sum(axis=1), pred) and np.allclose(pred, FO.follow(t, bins[:50]))


def test_tabled_patterns_explain_as_the_rows_do(monkeypatch):
    rng = np.random.default_rng(5)
    bins = np.column_stack([rng.integers(0, 9, (600, 3)), rng.integers(0, 2, (600, 3))])
    y = bins[:, 0] * bins[:, 1] - 3.0 * bins[:, 3] + rng.normal(size=600)
    trees = [{**t, "feature": np.maximum(t["feature"], 0), "threshold": t["bin"] + 0.5} for t in FO.boost(bins, np.ones(600), y, 6, 5, 0.3)[1]]
    x = bins[:200].astype(float)
    x[3, 1] = np.nan
    calls = []
    weights = TS._subset_weights
    monkeypatch.setattr(TS, "_subset_weights", lambda zero, one: calls.append(one.shape) or weights(zero, one))
    tables = TS.leaf_tables(trees, [0.3] * 6)
    assert calls and len(calls) <= 6  # once for all leaves with as many features on their way
    calls.clear()
    base, phi, pred = TS.explain_rows(tables, x)
    assert not calls  # rows are looked up
    monkeypatch.setattr(TS, "PATTERN_FEATURES", 0)
    other = TS.tree_shap_matrix(trees, [0.3] * 6, x)
    assert calls and np.allclose(phi, other[1], atol=1e-12) and np.array_equal(pred, other[2]) and base == other[0]
    ok = ~np.isnan(x).any(axis=1)
    assert np.allclose((base + phi.sum(axis=1))[ok], pred[ok])


def test_cuts_and_flags_of_one_growth(monkeypatch):
    rng = np.random.default_rng(6)
    bins = np.column_stack([rng.integers(0, 20, (4000, 2)), rng.integers(0, 5, 4000)[:, None] == np.arange(4)])
    w = rng.poisson(1.0, 4000).astype(float)
    g = w * (bins[:, 0] + 5.0 * bins[:, 3] + rng.normal(size=4000))
    cuts = ((FO.UNLIMITED, 2.0), (3, 2.0), (6, 9.0))
    nodes, pred, cut_pred = FO.grow(bins, w, g, cuts=cuts)
    assert np.array_equal(pred, FO.follow(nodes, bins)) and np.array_equal(pred, cut_pred[0])
    for (depth, least), p in zip(cuts, cut_pred, strict=True):
        assert np.array_equal(p, FO.grow(bins, w, g, depth, least)[1])
    monkeypatch.setattr(FO, "FLAGS", 0)  # a table of its own for every 0 / 1 feature
    alone = FO.grow(bins.astype(np.int64), w, g)[0]
    assert all(np.array_equal(nodes[k], alone[k]) for k in ("feature", "bin", "left", "right"))


def test_cells_are_grouped_by_node_and_bin():
    rng = np.random.default_rng(7)
    at, x = rng.integers(0, 200_000, 50_000), rng.integers(0, 32, 50_000).astype(np.uint8)
    assert np.array_equal(FO._grouped(at, x), np.lexsort((x, at)))


# -- networks ---------------------------------------------------------------

def _weights(folded, parts, per_group, calls=None):
    rows = MLP.raw_columns(folded.repartition(parts))
    valid = F.col(KEY) % 10 == 0
    prep = CampaignPreprocessor().fit(folded)
    units, groups, lanes = MLP.dealt_groups(rows, MLP.raw_features(), TARGET, KEY, valid, per_group)
    nets = [MLP.new_network(MLP.MLPConfig(hidden=h, max_epochs=e, fold=f), MLP.affine_of(prep)) for h in ((8,), (6, 4)) for f, e in ((0, 5), (1, 3))]
    out = MLP.train_networks(units, groups, lanes, nets)
    units.unpersist()
    return groups, out


@pytest.mark.parametrize("per_group", [100_000, 90])
def test_weights_do_not_depend_on_partitions(folded, per_group):
    groups, a = _weights(folded, 2, per_group)
    _, b = _weights(folded, 7, per_group)
    assert groups == (1 if per_group > 1000 else -(-folded.count() // 90))
    for x, y in zip(a, b, strict=True):
        assert np.abs(x.weights - y.weights).max() <= 1e-9 and x.history == y.history
    assert [n.epoch for n in a] == [5, 3, 5, 3]


def test_all_networks_share_the_jobs_of_a_round(spark, folded):
    rows = MLP.raw_columns(folded)
    units, groups, lanes = MLP.dealt_groups(rows, MLP.raw_features(), TARGET, KEY, F.col(KEY) % 10 == 0, 300)
    units.count()
    affine = MLP.affine_of(CampaignPreprocessor().fit(folded))
    nets = [MLP.new_network(MLP.MLPConfig(hidden=h, max_epochs=4, fold=f), affine) for h in ((8,), (6, 4)) for f in range(5)]
    spark.sparkContext.setJobGroup("networks", "ten networks, four epochs")
    MLP.train_networks(units, groups, lanes, nets)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("networks")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    units.unpersist()
    assert groups > 1 and len(jobs) == 4


def test_halves_of_the_folds_train_side_by_side(folded, monkeypatch):
    rows = MLP.raw_columns(folded)
    units, groups, lanes = MLP.dealt_groups(rows, MLP.raw_features(), TARGET, KEY, F.col(KEY) % 10 == 0, 300)
    affine = MLP.affine_of(CampaignPreprocessor().fit(folded))

    def nets():
        return [MLP.new_network(MLP.MLPConfig(hidden=h, max_epochs=3, fold=f), affine) for h in ((8,), (6, 4)) for f in range(3)]
    want, running, most = MLP.train_networks(units, groups, lanes, nets()), [], []
    plain = MLP.train_networks

    def seen(*args):
        running.append(1)
        most.append(len(running))
        out = plain(*args)
        running.pop()
        return out
    monkeypatch.setattr(MLP, "train_networks", seen)
    got = MLP.train_side_by_side(units, groups, lanes, nets())
    units.unpersist()
    assert groups > 1 and max(most) == 2
    for a, b in zip(want, got, strict=True):
        assert a.cfg == b.cfg and np.array_equal(a.weights, b.weights) and a.history == b.history


def test_a_group_sends_what_it_trained_in_single_precision(folded):
    rng = np.random.default_rng(4)
    nets = [MLP.new_network(MLP.MLPConfig(hidden=(6, 4), fold=f), (np.zeros(3), np.zeros(3), np.ones(3))) for f in (0, 1)]
    blob = pickle.dumps((rng.normal(size=(90, 3)), rng.normal(size=90), np.arange(90) % 3, np.arange(90) % 10 == 0))
    shared = types.SimpleNamespace(value=pickle.dumps(nets))
    frames = [pd.DataFrame({"group": [0, 1], "lane": [0, 0], "rows": [blob, blob]})]
    parts = list(pd.concat(MLP._train_unit(shared, 1, False)(frames))["part"])
    assert all(x[0].dtype == np.float32 for p in parts for _, x in pickle.loads(p)) and len(parts) == 2
    size = len(nets[0].w)
    for (_, total), (_, a), (_, b) in zip(pickle.loads(MLP._added(parts)), *map(pickle.loads, parts), strict=True):
        rows = a[1][1]
        assert np.array_equal(total[:3 * size], rows * a[0].astype(float) + rows * b[0].astype(float)) and total[3 * size + 1] == 2 * rows


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    X, y, shapes = rng.normal(size=(12, 3)), rng.normal(size=12), MLP._shapes(3, (4, 3))
    w = np.stack([MLP.init_weights(3, (4, 3), s) for s in (1, 2)])
    alpha = np.array([0.0, 0.5])

    def loss(flat):
        squares = sum((W ** 2).sum(axis=(1, 2)) for W, _ in MLP._layers(flat, shapes))
        return ((MLP.outputs(flat, shapes, X) - y) ** 2).mean(axis=1) / 2 + alpha * squares / 2 / len(y)
    g = MLP.gradients(w, shapes, X, y, alpha)
    for i in range(w.shape[1]):
        d = np.zeros_like(w)
        d[:, i] = 1e-6
        assert (loss(w + d) - loss(w - d)) / 2e-6 == pytest.approx(g[:, i], abs=1e-5)


def test_held_errors_are_those_of_the_predictions(folded):
    nets = [MLP.new_network(MLP.MLPConfig(hidden=(5,), fold=f), MLP.affine_of(CampaignPreprocessor().fit(folded))) for f in (0, 2)]
    rows = MLP.raw_columns(folded)
    got = MLP.held_errors(rows, nets, MLP.raw_features(), TARGET)
    for i, n in enumerate(nets):
        p = MLP.predict(rows.where(F.col("fold") == n.cfg.fold), n, MLP.raw_features(), [TARGET]).toPandas()
        assert got[i] == pytest.approx(((p["prediction"] - p[TARGET]) ** 2).sum(), rel=1e-9)


def test_a_network_explains_coalitions_as_scored_rows_do(folded, small_search, monkeypatch):
    model = small_search[TU.MLP_NAME]["fitted"]
    rows = folded.where(f"{KEY} % 7 = 0").limit(40).cache()
    background = [r.asDict() for r in folded.where(f"{KEY} % 50 < 6").select(*FEATURES).limit(9).collect()]
    background[0] |= {"tv": None, "influencer": "Giga"}
    scored = []
    plain = TU.Fitted.transform
    monkeypatch.setattr(TU.Fitted, "transform", lambda self, df, out="prediction": scored.append(1) or plain(self, df, out))
    got = {r[KEY]: r for r in TS.coalition_shapley(rows, background, model, FEATURES, KEY).collect()}
    assert not scored  # no table of mixed rows
    monkeypatch.setattr(TU.Fitted, "coalition_scorer", lambda self, features: None)
    want = TS.coalition_shapley(rows, background, model, FEATURES, KEY)
    assert scored and len(got) == rows.count() and list(got.values())[0].__fields__ == want.columns
    for r in want.collect():
        assert list(got[r[KEY]]) == pytest.approx(list(r), rel=1e-9, abs=1e-9)


# -- registry ---------------------------------------------------------------

def test_a_promotion_cut_short_leaves_the_champion(spark, small_search, tmp_path):
    root = str(tmp_path)
    with pytest.raises(MissingInput):
        REG.champion(spark, root)
    a, b = small_search[TU.LR_NAME]["fitted"], small_search[TU.GBT_NAME]["fitted"]
    assert REG.promote(spark, root, a, {"rmse_test": 2.0}) == 1
    (tmp_path / "registry" / "version=2").mkdir()  # rows on their way, no mark yet
    assert REG.champion(spark, root)[0]["model"] == TU.LR_NAME and REG.newest(spark, root) == 1
    assert REG.promote(spark, root, b, {"rmse_test": 1.0}) == 3
    row, model = REG.champion(spark, root)
    assert (row["version"], row["model"], row["metrics"]["rmse_test"], model.path) == (3, TU.GBT_NAME, 1.0, b.path)
    assert REG.champion(spark, root, 1)[0]["model"] == TU.LR_NAME
    assert sorted(r["version"] for r in REG.history(spark, root).collect()) == [1, 3]


# -- stream on the registry -------------------------------------------------

def test_stream_takes_the_new_champion_and_keeps_one_copy(spark, small_search, tmp_path):
    from adlift.operators import score as SC
    from adlift.streaming import score_stream as ST
    root, out, rejected = str(tmp_path / "models"), str(tmp_path / "out"), str(tmp_path / "rejected")
    a, b = small_search[TU.LR_NAME]["fitted"], small_search[TU.GBT_NAME]["fitted"]
    rows = SC.requests_from_campaigns(campaigns(spark, SF_SMALL)).limit(300).cache()
    first, second = rows.where("request_id % 2 = 0"), rows.where("request_id % 2 = 1")
    REG.promote(spark, root, a, {})
    ST.write_batch(first, 0, out, rejected, registry=root)
    REG.promote(spark, root, b, {})
    ST.write_batch(first, 0, out, rejected, registry=root)  # replayed after its commit
    # killed between the sinks and the commit: rows of an attempt that no commit names
    ok, bad = ST.scored_batch(second, a, a.name)
    for df, path in ((ok, out), (bad, rejected)):
        df.withColumn("model_version", F.lit(1)).write.parquet(f"{path}/batch_id=1/attempt=lost")
    ST.write_batch(second, 1, out, rejected, registry=root)
    good, refused = (ST.read_sink(spark, p, out).collect() for p in (out, rejected))
    valid = SC.validate(rows)
    assert sorted(r["request_id"] for r in good) == sorted(r["request_id"] for r in valid.where("is_valid").collect())
    want = {r["request_id"]: r["errors_text"] for r in valid.where("not is_valid").collect()}
    assert {r["request_id"]: r["errors_text"] for r in refused} == want and len(refused) == len(want) > 0
    assert {(r["request_id"] % 2, r["model_version"], r["model_used"]) for r in good} == {(0, 1, a.name), (1, 2, b.name)}
    plain = {r["request_id"]: r["prediction"] for r in b.transform(second).collect()}
    assert all(r["predicted_sales_m"] == pytest.approx(plain[r["request_id"]], abs=1e-4) for r in good if r["request_id"] % 2)


def test_a_job_on_one_model_tunes_no_other(folded, small_search, monkeypatch):
    searched = []
    plain = TU.Search._search
    monkeypatch.setattr(TU.Search, "_search", lambda self, name: searched.append(name) or plain(self, name))
    search = TU.Search(folded, SMALL, epochs=4)
    a, b = search.result(TU.GBT_NAME), search.result(TU.GBT_NAME)
    assert searched == [TU.GBT_NAME] and a is b
    assert a["best_params"] == small_search[TU.GBT_NAME]["best_params"] and a["results"] == small_search[TU.GBT_NAME]["results"]


@pytest.mark.parametrize("name", ["native_importance", "tree_shap", "shap_long", "coalition_shapley", "waterfall_values", "importance_synthesis_ml"])
def test_explanations_ask_for_the_boosted_trees_alone(spark, folded, small_search, monkeypatch, name):
    from adlift.plans import modeling as MO
    search = TU.Search(folded, SMALL, epochs=4)
    search._done[TU.GBT_NAME] = (small_search[TU.GBT_NAME], 0.0)

    def refused(self, name):
        raise AssertionError(f"searched {name}")
    monkeypatch.setattr(TU.Search, "_search", refused)
    sp = MO.split_table(spark, SF_SMALL)
    ctx = {"split": sp, "train": sp.where("split = 'train'"), "test": sp.where("split = 'test'"), "search": search}
    monkeypatch.setitem(MO._CACHE, (spark.sparkContext.applicationId, SF_SMALL), ctx)
    assert getattr(MO, name)(spark, SF_SMALL).count() > 0


def test_a_task_trains_a_block_of_many_groups(spark, folded, monkeypatch):
    _, a = _weights(folded, 3, 30)
    monkeypatch.setattr(MLP, "block_size", lambda groups, cores: MLP.FAN_IN)
    monkeypatch.setattr(MLP, "DRIVER_BYTES", 0)
    groups, b = _weights(folded, 3, 30)
    assert groups > MLP.FAN_IN
    for x, y in zip(a, b, strict=True):
        assert np.array_equal(x.weights, y.weights) and x.history == y.history
    rows = MLP.raw_columns(folded)
    units, groups, lanes = MLP.dealt_groups(rows, MLP.raw_features(), TARGET, KEY, F.col(KEY) % 10 == 0, 30, lanes=1)
    assert units.rdd.getNumPartitions() <= -(-groups // MLP.FAN_IN)
    units.unpersist()
