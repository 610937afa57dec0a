"""Parquet sources and sinks."""

from sparkseries.sources.parquet import (
    Series,
    column_info,
    data_info,
    detect_time_column,
    export_parquet,
    export_roundtrip,
    load_days,
    load_series,
    parquet_schema,
)

__all__ = ["Series", "column_info", "data_info", "detect_time_column", "export_parquet",
           "export_roundtrip", "load_days", "load_series", "parquet_schema"]
