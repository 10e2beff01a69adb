"""Golden values typed from the studied project's published result rows."""

import pytest
from pyspark.sql import functions as F

from adlift.functions.scalar import slug, slug_py, verdict
from adlift.operators.explain import normalise_pct
from adlift.operators.footprint import footprint_report

# Fixed golden rows: (model, time_sec) -> Energy_Wh, CO2_France_g, CO2_World_g, Car_km_eq
FOOTPRINT = [
    ("XGBoost", 1.79, 0.0224, 0.0013, 0.0106, 0.00009),
    ("Linear Regression", 2.66, 0.0333, 0.0019, 0.0158, 0.00013),
    ("MLP (Deep Learning)", 5.50, 0.0688, 0.0039, 0.0327, 0.00027),
    ("Random Forest", 29.96, 0.3745, 0.0210, 0.1779, 0.00148),
    ("TOTAL", 39.91, 0.4990, 0.0281, 0.2370, 0.00197),
]
# (R2_train, R2_test, RMSE_train, RMSE_test) -> verdict
VERDICTS = [
    ((0.9986, 0.9985, 3.543, 3.538), "OK"),
    ((0.9991, 0.9984, 2.761, 3.701), "OVERFITTING"),
    ((0.9951, 0.9960, 6.529, 5.879), "OK"),
    ((0.9950, 0.9958, 6.557, 5.983), "OK"),
]
RAW_NATIVE = [("tv", 0.9951919), ("radio", 0.0038828969), ("social_media", 0.00021809612),
              ("influencer", 0.0007071545)]
NATIVE_NORM = {"tv": 99.52, "radio": 0.39, "social_media": 0.02, "influencer": 0.07}


def test_footprint_report_golden(spark):
    runs = spark.createDataFrame([(m, t) for m, t, *_ in FOOTPRINT[:-1]], "model string, time_sec double")
    rep = {r["model"]: r for r in footprint_report(runs).collect()}
    for model, t, wh, fr, world, km in FOOTPRINT:
        r = rep[model]
        assert r["time_sec"] == pytest.approx(t, abs=1e-9)
        assert r["energy_wh"] == pytest.approx(wh, abs=1e-9)
        assert r["co2_france_g"] == pytest.approx(fr, abs=1e-9)
        assert r["co2_world_g"] == pytest.approx(world, abs=1e-9)
        assert r["car_km_eq"] == pytest.approx(km, abs=1e-12)
    order = [r["model"] for r in sorted(rep.values(), key=lambda r: r["position"])]
    assert order == [m for m, *_ in FOOTPRINT]


def test_footprint_requires_time_column(spark):
    with pytest.raises(KeyError):
        footprint_report(spark.createDataFrame([("x", 1.0)], "model string, seconds double"))


def test_verdict_golden(spark):
    df = spark.createDataFrame([v for v, _ in VERDICTS], "r2_train double, r2_test double, "
                                                          "rmse_train double, rmse_test double")
    got = [r[0] for r in df.select(verdict("r2_train", "r2_test", "rmse_train", "rmse_test")).collect()]
    assert got == [v for _, v in VERDICTS]


def test_importance_normalisation_golden(spark):
    df = spark.createDataFrame(RAW_NATIVE, "feature string, native double")
    got = {r["feature"]: r["native_norm"] for r in normalise_pct(df, ["native"]).collect()}
    assert got == NATIVE_NORM


def test_slugs(spark):
    assert slug_py("MLP (Deep Learning)") == "mlp_deep_learning"
    assert slug_py("Random Forest") == "random_forest"
    df = spark.createDataFrame([("MLP (Deep Learning)",), ("Random Forest",)], "m string")
    assert [r[0] for r in df.select(slug("m")).collect()] == ["mlp_deep_learning", "random_forest"]


def test_checkpoint_dir_read_not_written():
    """The shared folder is read from the session; when unset, a folder is
    registered with the SparkContext only (the setting itself is untouched)."""
    from adlift.session import ensure_checkpoint_dir

    class Conf:
        def __init__(self, value):
            self.value, self.writes = value, 0

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

        def set(self, key, value):
            self.writes += 1

    class Ctx:
        applicationId = "app-test-unset"
        master = "local[2]"

        def __init__(self):
            self.dir = None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        def __init__(self, value):
            self.conf, self.sparkContext = Conf(value), Ctx()

    shared = Session("/shared/ckpt")
    assert ensure_checkpoint_dir(shared) == "/shared/ckpt"
    assert shared.sparkContext.dir == "/shared/ckpt" and shared.conf.writes == 0
    unset = Session(None)
    d = ensure_checkpoint_dir(unset)
    assert d and unset.sparkContext.dir == d and unset.conf.writes == 0
    assert ensure_checkpoint_dir(unset) == d
    cluster = Session(None)
    cluster.sparkContext.applicationId, cluster.sparkContext.master = "app-test-cluster", "yarn"
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(cluster)
