"""DataFrame -> DataFrame operators: filters, buckets, rolling/ordered ops, statistics."""

from sparkseries.operators.grouped import custom_aggregate
from sparkseries.operators.impute import impute_missing
from sparkseries.operators.outliers import detect_outliers
from sparkseries.operators.quantiles import exact_quantiles
from sparkseries.operators.resample import resample, time_bucket_stats
from sparkseries.operators.rolling import rolling_window
from sparkseries.operators.select import filter_time_range, tail_rows
from sparkseries.operators.shift import create_lags, difference
from sparkseries.operators.stats import (
    basic_stats,
    correlation_matrix,
    distributions,
    outlier_stats,
    outlier_summary,
)

__all__ = [
    "basic_stats", "correlation_matrix", "create_lags", "custom_aggregate", "detect_outliers",
    "difference", "distributions", "exact_quantiles", "filter_time_range", "impute_missing",
    "outlier_stats", "outlier_summary", "resample", "rolling_window", "tail_rows",
    "time_bucket_stats",
]
