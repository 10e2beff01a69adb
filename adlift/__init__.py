"""adlift — Spark-native campaign analytics.

Profiling, leakage-free feature preparation, regression training and
cross-validation, evaluation, explanation and batch / stream scoring of
marketing-campaign tables, expressed as DataFrame operators.
"""

from adlift.constants import (  # noqa: F401
    CATEGORIES,
    FEATURES,
    KEY,
    NUMERIC,
    TARGET,
)

__version__ = "0.1.0"
