"""Registered queries: one per operator of the inventory, each with a DuckDB oracle.

Every query reads whole tables from ``sf_dir`` (``events`` is the series,
``lineitem``/``orders`` serve statistics and grouping).  Doubles are rounded
to 6 places on both sides so that summation order cannot change the value
hash.  ``SQL`` holds the oracle text; a key without SQL has only a row check.

Series used by the imputation queries (derived from ``events`` by Spark, so it
grows with the table): ``v`` is ``value`` with every 7th event blanked and
``et`` is ``event_type`` with every 5th event blanked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseries.functions.aggs import block_agg, merged_agg, spark_agg
from sparkseries.operators import (
    basic_stats,
    correlation_matrix,
    create_lags,
    custom_aggregate,
    detect_outliers,
    difference,
    distributions,
    filter_time_range,
    impute_missing,
    outlier_stats,
    outlier_summary,
    resample,
    rolling_window,
    tail_rows,
    time_bucket_stats,
)
from sparkseries.sources import (
    column_info,
    data_info,
    detect_time_column,
    export_parquet,
    export_roundtrip,
    load_days,
    load_series,
    parquet_schema,
)
from sparkseries.session import scratch_path

TS = "ts"
TIE = ("event_id",)
# The time window used by the range queries and the flagship.
RANGE_START, RANGE_END = "2024-01-03", "2024-01-10 12:00:00"
FLAG_START, FLAG_END = "2024-01-03", "2024-01-20"


def _path(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), places).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_series(spark, _path(sf_dir, "events")).df


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(TS, "event_id",
                    F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"),
                    F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("et"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_series(spark, _path(sf_dir, name)).df


def _value_range(s: pd.Series) -> float:
    return float(s.max() - s.min())


def _top_mean(k: int) -> merged_agg:
    """Mean of the ``k`` largest values: a Python aggregate whose state is those values."""
    def largest(a, b):
        return np.sort(np.concatenate([a, b]))[-k:]
    return merged_agg(lambda: np.empty(0), largest, largest, lambda s: float(s.mean()) if len(s) else None, f"top{k}")


def _range_expr():
    return spark_agg(lambda c: F.max(c) - F.min(c), "range")


# --------------------------------------------------------------------------
# Spark side


def q_load_series(spark, sf):
    return events(spark, sf)


def q_filter_time_range(spark, sf):
    return filter_time_range(events(spark, sf), RANGE_START, RANGE_END, ts=TS)


def q_detect_time_column(spark, sf):
    rows = []
    for name in ("events", "lineitem", "orders"):
        df = spark.read.parquet(_path(sf, name))
        rows.append((name, detect_time_column(df)))
    return spark.createDataFrame(rows, "table_name string, time_column string")


def q_parquet_schema(spark, sf):
    return parquet_schema(spark, _path(sf, "events"))


def q_data_info(spark, sf):
    return data_info(events(spark, sf), TS)


def q_export_roundtrip(spark, sf):
    return rounded(export_roundtrip(spark, events(spark, sf)).df)


def q_export_partitioned(spark, sf):
    path = export_parquet(events(spark, sf), scratch_path(spark, "export"), partition_by_day=TS)
    return rounded(load_days(spark, path, RANGE_START, RANGE_END, ts=TS).df)


def q_data_info_regular(spark, sf):
    # one row a second in order of the ids: an evenly spaced grid as long as the table
    e = events(spark, sf)
    grid = e.select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, event_id)").alias(TS), "value")
    return data_info(grid, TS)


def q_tail_rows(spark, sf):
    return tail_rows(events(spark, sf), ts=TS, tie=TIE, columns=["value"], n=1000)


def q_resample_mean(spark, sf):
    return rounded(resample(events(spark, sf), "1H", "mean", ts=TS))


def q_resample_sum_gapfill(spark, sf):
    return rounded(resample(events(spark, sf), "7min", "sum", ts=TS, columns=["value"]))


def q_resample_multi(spark, sf):
    agg = {"value": ["mean", "std", "max"], "user_id": "nunique"}
    return rounded(resample(events(spark, sf), "1H", agg, ts=TS))


def q_resample_median_first(spark, sf):
    agg = {"value": ["median", "first", "last", "count"]}
    return rounded(resample(events(spark, sf), "6H", agg, ts=TS, tie=TIE))


def q_time_bucket_stats(spark, sf):
    return rounded(time_bucket_stats(events(spark, sf), "6H", ts=TS))


def q_resample_expr(spark, sf):
    return rounded(resample(events(spark, sf), "1H", {"value": _range_expr()}, ts=TS))


def q_basic_stats(spark, sf):
    return rounded(basic_stats(table(spark, sf, "lineitem")))


def q_correlation_matrix(spark, sf):
    return rounded(correlation_matrix(table(spark, sf, "lineitem")))


def q_outlier_flags_zscore(spark, sf):
    return detect_outliers(events(spark, sf), method="zscore", threshold=3.0, keep=[TS])


def q_outlier_flags_iqr(spark, sf):
    return detect_outliers(events(spark, sf), method="iqr", threshold=1.5, keep=[TS])


def q_outlier_stats(spark, sf):
    return rounded(outlier_stats(table(spark, sf, "lineitem")))


def q_outlier_summary(spark, sf):
    return rounded(outlier_summary(events(spark, sf), method="zscore", threshold=3.0, exclude=[TS]))


def q_distributions(spark, sf):
    return rounded(distributions(events(spark, sf), ["value", "user_id", "event_id"], bins=50))


def q_custom_aggregate(spark, sf):
    return rounded(custom_aggregate(table(spark, sf, "orders"), "o_orderpriority",
                                    {"o_totalprice": "mean", "o_custkey": "sum"}))


def q_custom_aggregate_multi(spark, sf):
    agg = {"o_totalprice": ["mean", "std", "min", "max", "median", "count", "first", "last"],
           "o_custkey": "nunique"}
    return rounded(custom_aggregate(table(spark, sf, "orders"), ["o_orderstatus"], agg,
                                    order=["o_orderdate", "o_orderkey"]))


def q_custom_aggregate_expr(spark, sf):
    return rounded(custom_aggregate(events(spark, sf), "event_type", {"value": _range_expr()}))


def q_custom_aggregate_merged(spark, sf):
    return rounded(custom_aggregate(events(spark, sf), "event_type", {"value": [_top_mean(10), "count"]}))


def q_resample_merged(spark, sf):
    return rounded(resample(events(spark, sf), "6H", {"value": _top_mean(5)}, ts=TS))


def q_column_info(spark, sf):
    return column_info(events(spark, sf))


def q_two_valued_quantiles(spark, sf):
    # half the rows 0, half 1: the ranks around the median stand in two heavy values
    e = events(spark, sf).select((F.col("event_id") % 2).cast("double").alias("v"))
    return rounded(basic_stats(e))


def q_rolling_rows_mean(spark, sf):
    return rounded(rolling_window(events(spark, sf), ["value"], 10, "mean", ts=TS, tie=TIE))


def q_rolling_rows_std(spark, sf):
    return rounded(rolling_window(gappy(spark, sf), ["v"], 10, "std", ts=TS, tie=TIE))


def q_rolling_rows_count(spark, sf):
    # pandas reports rolling counts as float; so do we (and NULLs stay NULL)
    r = rolling_window(gappy(spark, sf), ["v"], 5, "count", ts=TS, tie=TIE)
    return r.withColumn("v", F.col("v").cast("double"))


def q_rolling_rows_udf(spark, sf):
    return rounded(rolling_window(events(spark, sf), ["value"], 10, _value_range, ts=TS, tie=TIE))


def q_rolling_rows_blocks(spark, sf):
    spread = block_agg(lambda frames: frames.max(axis=1) - frames.min(axis=1), "range")
    return rounded(rolling_window(gappy(spark, sf), ["v"], 4, spread, ts=TS, tie=TIE))


def q_rolling_time_sum(spark, sf):
    return rounded(rolling_window(gappy(spark, sf), ["v"], "5min", "sum", ts=TS))


def q_rolling_time_mean_1h(spark, sf):
    return rounded(rolling_window(gappy(spark, sf), ["v"], "1h", "mean", ts=TS))


def _rolling_time_wide(agg):
    def q(spark, sf):
        return rounded(rolling_window(gappy(spark, sf), ["v"], "3D", agg, ts=TS))
    return q


def q_bigint_sums(spark, sf):
    # sums far beyond 64 bits, grouped and in time frames
    e = events(spark, sf).select(TS, "event_id", "event_type", (F.lit(9_000_000_000_000_000_000) - F.col("user_id")).alias("v"))
    total = custom_aggregate(e, "event_type", {"v": "sum"}).select("event_type", F.col("v").cast("string").alias("v"))
    frames = rolling_window(e.select(TS, "v"), ["v"], "1D", "sum", ts=TS).groupBy(F.date_format(TS, "yyyy-MM-dd").alias("event_type"))
    return total.unionByName(frames.agg(F.max("v").cast("string").alias("v")))


def q_difference(spark, sf):
    return rounded(difference(events(spark, sf), ["value"], 1, ts=TS, tie=TIE))


def q_lag_features(spark, sf):
    lagged = create_lags(events(spark, sf).select(TS, "event_id", "user_id", "value"),
                         ["value", "user_id"], [1, 3, -2], ts=TS, tie=TIE)
    # pandas shifts an integer column into floats (the NaN needs them); report the same
    return rounded(lagged.select(*[F.col(c).cast("double").alias(c) if c.startswith("user_id_lag")
                                   else F.col(c) for c in lagged.columns]))


def _impute(method, limit=None):
    def q(spark, sf):
        return rounded(impute_missing(gappy(spark, sf), method, limit, ts=TS, tie=TIE))
    return q


def q_interpolate_linear(spark, sf):
    d = gappy(spark, sf).select("event_id", "v")
    return rounded(impute_missing(d, "interpolate", ts="event_id"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The dashboard session: filter -> forward fill -> hourly mean -> summary."""
    d = gappy(spark, sf).select(TS, "event_id", "v")
    d = filter_time_range(d, FLAG_START, FLAG_END, ts=TS)
    d = impute_missing(d, "ffill", ts=TS, tie=TIE)
    d = resample(d, "1H", "mean", ts=TS, columns=["v"])
    return rounded(basic_stats(d, ["v"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_series": q_load_series,
    "filter_time_range": q_filter_time_range,
    "detect_time_column": q_detect_time_column,
    "parquet_schema": q_parquet_schema,
    "data_info": q_data_info,
    "export_roundtrip": q_export_roundtrip,
    "export_partitioned": q_export_partitioned,
    "data_info_regular": q_data_info_regular,
    "tail_rows": q_tail_rows,
    "column_info": q_column_info,
    "two_valued_quantiles": q_two_valued_quantiles,
    "resample_mean": q_resample_mean,
    "resample_sum_gapfill": q_resample_sum_gapfill,
    "resample_multi": q_resample_multi,
    "resample_median_first": q_resample_median_first,
    "resample_expr": q_resample_expr,
    "time_bucket_stats": q_time_bucket_stats,
    "basic_stats": q_basic_stats,
    "correlation_matrix": q_correlation_matrix,
    "outlier_flags_zscore": q_outlier_flags_zscore,
    "outlier_flags_iqr": q_outlier_flags_iqr,
    "outlier_stats": q_outlier_stats,
    "outlier_summary": q_outlier_summary,
    "distributions": q_distributions,
    "custom_aggregate": q_custom_aggregate,
    "custom_aggregate_multi": q_custom_aggregate_multi,
    "custom_aggregate_expr": q_custom_aggregate_expr,
    "custom_aggregate_merged": q_custom_aggregate_merged,
    "resample_merged": q_resample_merged,
    "rolling_rows_mean": q_rolling_rows_mean,
    "rolling_rows_std": q_rolling_rows_std,
    "rolling_rows_count": q_rolling_rows_count,
    "rolling_rows_udf": q_rolling_rows_udf,
    "rolling_rows_blocks": q_rolling_rows_blocks,
    "rolling_time_sum": q_rolling_time_sum,
    "rolling_time_mean_1h": q_rolling_time_mean_1h,
    "rolling_time_wide_sum": _rolling_time_wide("sum"),
    "rolling_time_wide_std": _rolling_time_wide("std"),
    "rolling_time_wide_max": _rolling_time_wide("max"),
    "bigint_sums": q_bigint_sums,
    "difference": q_difference,
    "lag_features": q_lag_features,
    "impute_ffill": _impute("ffill"),
    "impute_ffill_limit": _impute("ffill", 2),
    "impute_bfill": _impute("bfill"),
    "impute_bfill_limit": _impute("bfill", 1),
    "interpolate_time": _impute("interpolate"),
    "interpolate_time_limit": _impute("interpolate", 2),
    "interpolate_linear": q_interpolate_linear,
    "filter_impute_resample_stats": flagship,
}
