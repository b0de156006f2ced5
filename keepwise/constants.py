"""Fixed values that must equal the reference's for right results.

These are data, not logic: column roles, thresholds, labels and texts.
"""
from __future__ import annotations

# --- fixed values: column roles ---------------------------------------------
ID_COL = "customer_id"
TARGET = "churned"

NUMERIC_COLS = [
    "age", "watch_hours", "last_login_days", "monthly_fee",
    "number_of_profiles", "avg_watch_time_per_day",
]
CATEGORICAL_COLS = [
    "gender", "subscription_type", "region", "device",
    "payment_method", "favorite_genre",
]
ENGINEERED_NUMERIC = ["watch_per_profile"]
ENGINEERED_CATEGORICAL = ["engagement_segment", "recency_bucket"]
NUMERIC_FEATURES = NUMERIC_COLS + ENGINEERED_NUMERIC
CATEGORICAL_FEATURES = CATEGORICAL_COLS + ENGINEERED_CATEGORICAL
LEAKAGE_SUSPECTS = ["last_login_days", "recency_bucket"]

# --- fixed values: modelling ------------------------------------------------
RANDOM_STATE = 42
TEST_SIZE = 0.20
CV_FOLDS = 5

# --- fixed values: risk tiers, revenue, actions -----------------------------
RISK_LOW_MAX = 0.40      # p <= 0.40 -> Low
RISK_HIGH_MIN = 0.70     # p >= 0.70 -> High
REVENUE_MONTHS = 12
ACTIONS = {
    "High": "Offer targeted discount / personalized content",
    "Medium": "Send re-engagement campaign",
    "Low": "Maintain engagement / loyalty rewards",
}
KEY_FACTORS = ["Low recent activity", "Low engagement", "Higher plan cost", "Stable usage"]
DEFAULT_SAVE_RATE = 0.30

# --- fixed values: text missing markers -------------------------------------
# pandas read_csv default NA tokens
CSV_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# category cleaning: stripped text that becomes "Unknown"
UNKNOWN_MARKERS = ["nan", "", "None"]
UNKNOWN = "Unknown"

# --- fixed values: ordered domains and bins ---------------------------------
RISK_ORDER = ["Low", "Medium", "High"]
SEGMENT_ORDER = ["Low", "Medium", "High"]
RECENCY_ORDER = ["Active", "Lapsing", "Dormant"]
STATUS_ORDER = ["Retained", "Churned"]
AGE_BAND_EDGES = [0, 25, 35, 45, 55, 200]
AGE_BAND_LABELS = ["<25", "25-34", "35-44", "45-54", "55+"]
RECENCY_EDGES = [-1, 7, 30]          # (-1,7] Active, (7,30] Lapsing, (30,inf) Dormant
STATUS_FEATURES = [
    "age", "monthly_fee", "watch_hours", "avg_watch_time_per_day",
    "last_login_days", "number_of_profiles",
]
PRIORITY_DIMS = ["subscription_type", "region", "engagement_segment", "recency_bucket"]
SOUTH_AMERICA = [
    "Argentina", "Bolivia", "Brazil", "Chile", "Colombia", "Ecuador",
    "Paraguay", "Peru", "Uruguay", "Venezuela",
]

# --- fixed values: dashboard control ranges (what-if grid) ------------------
SAVE_RATE_STEPS = 21      # 0.00 .. 1.00 by 0.05
DISCOUNT_STEPS = 11       # 0 .. 50 % by 5
MODEL_ORDER = ["Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting"]
METRIC_NAMES = ["pr_auc", "roc_auc", "f1", "precision", "recall", "accuracy", "brier"]
