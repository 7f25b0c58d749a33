"""Fixed values that must equal the audited behaviour for right results.

These are stated plainly, together, in natural order.
"""

# The three group metrics, in report order.
METRICS = ("selection_rate", "true_positive_rate", "false_positive_rate")

# Issue type per metric.
ISSUE_TYPES = {
    "selection_rate": "demographic_disparity",
    "true_positive_rate": "unequal_opportunity",
    "false_positive_rate": "unequal_harm",
}

# Severity bands as multiples of the fairness threshold (>=).
SEVERITY_BANDS = (("severe", 2.0), ("moderate", 1.0), ("mild", 0.5))
SEVERITY_LEVELS = ("mild", "moderate", "severe", "unknown")

# Proxy risk bands on AUC (>=).
RISK_BANDS = (("high", 0.8), ("moderate", 0.65))
RISK_DEFAULT = "low"

# Score cuts of the threshold-sensitivity diagnostic.
DEFAULT_CUTS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)

# Diagnostic tool names, in registry order.
TOOLS = (
    "check_group_sample_sizes",
    "run_feature_distribution_comparison",
    "run_proxy_detection",
    "run_slice_scan",
    "run_threshold_sensitivity",
)

# Defaults of the audit configuration.
DEFAULT_FAIRNESS_THRESHOLD = 0.05
DEFAULT_MIN_GROUP_SIZE = 30
DEFAULT_TEST_SIZE = 0.25
DEFAULT_RANDOM_STATE = 42
SLICE_MAX_DISTINCT = 8
SLICE_MAX_COLUMNS = 5
SLICE_MIN_SUPPORT = 10
SLICE_TOP = 20
SHIFT_TOP = 10
TVD_TOP_K = 5
PROFILE_TOP_VALUES = 15
NULL_GROUP_LABEL = "nan"
