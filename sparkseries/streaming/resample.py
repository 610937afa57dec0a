"""``resample`` on a growing folder of Parquet files (Structured Streaming).

New files are picked up incrementally; each bucket is a tumbling event-time
window.  With the default ``append`` mode a bucket is emitted once, after the
watermark (latest event time minus ``watermark``) has passed its end, and its
state is dropped; later rows for it are discarded as late.  Buckets are
aligned to the epoch when the step divides a day, otherwise to ``origin``.
As in batch ``resample``, a bucket is dropped when any of its outputs is NULL.
Empty buckets never appear in a stream (there is no row to emit them from).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkseries.functions.aggs import agg_expr, normalize
from sparkseries.functions.columns import epoch_us, from_epoch_us, nan_to_null, resolve_columns
from sparkseries.functions.freq import DAY_US, divides_day, parse_freq
from sparkseries.session import scratch_path

# Aggregation names a streaming aggregation can keep as state.
STREAMABLE = ("mean", "sum", "std", "var", "min", "max", "count", "size", "prod")


def resample_stream(spark: SparkSession, path: str, schema: T.StructType | str, freq, agg_func="mean", *,
                    ts: str, columns: Sequence[str] | None = None, watermark: str = "1 hour",
                    origin_us: int | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of bucketed aggregates over the Parquet files in ``path``."""
    step = parse_freq(freq)
    if origin_us is None:
        if not divides_day(step):
            raise ValueError("a step that does not divide a day needs an explicit origin_us")
        origin_us = 0
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = nan_to_null(reader.parquet(path))
    cols = resolve_columns(src, columns, exclude=[ts])
    specs = normalize(agg_func, cols)
    bad = [s.fname for s in specs if not (isinstance(s.func, str) and s.func in STREAMABLE)]
    if bad:
        raise ValueError(f"not supported on a stream: {bad}; use one of {STREAMABLE}")
    offset = origin_us % step
    ts_type = src.schema[ts].dataType
    # watermarks need an instant: read a wall-clock (NTZ) time as UTC
    event = F.timestamp_micros(epoch_us(src, ts)) if isinstance(ts_type, T.TimestampNTZType) else F.col(ts)
    src = src.withColumn("__ss_event", event)
    bucket = F.window(F.col("__ss_event"), f"{step} microseconds", startTime=f"{offset % DAY_US} microseconds")
    agg = (src.withWatermark("__ss_event", watermark).groupBy(bucket.alias("__ss_w"))
           .agg(*[agg_expr(s) for s in specs]))
    outs = [s.out for s in specs]
    cond = None
    for o in outs:
        c = F.col(o).isNotNull()
        cond = c if cond is None else cond & c
    start = F.col("__ss_w.start")
    if isinstance(ts_type, T.TimestampNTZType):
        start = from_epoch_us(F.unix_micros(start), ts_type)
    out = agg.select(start.alias(ts), *outs)
    return out.filter(cond) if cond is not None else out


def start_resample_stream(stream: DataFrame, sink_path: str, *, checkpoint: str | None = None,
                          trigger_seconds: int | None = 60, available_now: bool = False) -> StreamingQuery:
    """Write finished buckets as Parquet; the checkpoint lives in the shared folder."""
    spark = stream.sparkSession
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint or scratch_path(spark, "resample-stream-ckpt")))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start(sink_path)
