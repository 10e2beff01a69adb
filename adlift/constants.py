"""Column names and fixed parameters shared by every operator."""

KEY = "campaign_id"
NUMERIC = ["tv", "radio", "social_media"]
CATEGORICAL = "influencer"
FEATURES = NUMERIC + [CATEGORICAL]
TARGET = "sales"

# ---------------------------------------------------------------------------
# Fixed values that must equal the studied project's for equal results.
# ---------------------------------------------------------------------------
# Influencer categories, in their business order.
CATEGORIES = ["Nano", "Micro", "Macro", "Mega"]
# Value written for a missing category before one-hot encoding.
MISSING_CATEGORY = "missing"
# Request validation: every budget must lie in [0, 10000].
BUDGET_MIN = 0.0
BUDGET_MAX = 10000.0
# Train / test split and folds.
TEST_SIZE = 0.2
SEED = 42
N_FOLDS = 5
# Overfitting verdict thresholds (gap of R2 train - test; relative RMSE gap in %).
OVERFIT_GAP_R2 = 0.05
OVERFIT_GAP_RMSE_PCT = 20.0
UNDERFIT_GAP_R2 = -0.02
UNDERFIT_GAP_RMSE_PCT = -10.0
# Correlation level that raises a multicollinearity alert.
MULTICOLLINEARITY_R = 0.7
# IQR outlier fences at 1.5 * IQR.
IQR_FACTOR = 1.5
# Split balance status: relative gap of the target mean below 5 % is OK.
SPLIT_GAP_OK_PCT = 5.0
# Radar stability score for a model whose verdict is not OK.
RADAR_UNSTABLE = 0.6
# Contribution display threshold.
CONTRIBUTION_MIN_ABS = 0.001
# CV gain reading: above 5 % is a clear gain.
CV_GAIN_CLEAR_PCT = 5.0
# Footprint: CPU power (W), PUE, grid intensity France / world (g CO2 per kWh),
# average car emissions (g CO2 per km).
CPU_WATTS = 45.0
PUE = 1.0
CO2_FRANCE_G_PER_KWH = 56.0
CO2_WORLD_G_PER_KWH = 475.0
CAR_G_PER_KM = 120.0
# MAPE guard: numpy float64 machine epsilon.
MAPE_EPS = 2.220446049250313e-16
# Sample sizes: pair-plot sample and explanation sample.
PAIR_SAMPLE_N = 1000
EXPLAIN_SAMPLE_N = 500
# Histogram bins (page histogram and notebook histogram).
HIST_BINS = 50
# Scenario slider steps for tv, radio, social_media.
SCENARIO_STEPS = {"tv": 1.0, "radio": 0.5, "social_media": 0.1}
# Model hyper-parameter grids (random forest, boosted trees, MLP).
RF_GRID = {"numTrees": [100, 200], "maxDepth": [None, 10, 20], "minSplit": [2, 5]}
GBT_GRID = {"maxIter": [100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.05, 0.1]}
MLP_GRID = {
    "layers": [(50,), (100,), (50, 25), (100, 50)],
    "alpha": [1e-4, 1e-3],
    "learningRate": [1e-3, 1e-2],
}
