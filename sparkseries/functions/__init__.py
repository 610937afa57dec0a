"""Column-level helpers: column selection, time arithmetic, frequencies, aggregations."""

from sparkseries.functions.aggs import AggSpec, block_agg, merged_agg, spark_agg
from sparkseries.functions.columns import (
    epoch_us,
    from_epoch_us,
    nan_to_null,
    numeric_columns,
)
from sparkseries.functions.freq import parse_freq

__all__ = [
    "AggSpec",
    "block_agg",
    "epoch_us",
    "from_epoch_us",
    "merged_agg",
    "nan_to_null",
    "numeric_columns",
    "parse_freq",
    "spark_agg",
]
