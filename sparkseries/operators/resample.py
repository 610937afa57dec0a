"""Tumbling time buckets: ``resample`` (A1), ``time_bucket_stats`` (A2) and the
empty-bucket spine (A9).

Buckets are left-closed and left-labelled and start at midnight of the first
row's day (the reference's default origin).  When the step divides a day,
that origin is also aligned to the epoch, so no pass over the data is needed
to find it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseries.functions.aggs import AggSpec, is_not_null_on_empty, normalize
from sparkseries.functions.columns import epoch_us, from_epoch_us, internal, resolve_columns
from sparkseries.functions.freq import DAY_US, divides_day, parse_freq
from sparkseries.operators.grouped import aggregate_groups

BUCKET = internal("bucket")


def bucket_origin(df: DataFrame, ts: str, step_us: int) -> int:
    """Epoch-µs origin of the bucket grid (a scalar job only if needed)."""
    if divides_day(step_us):
        return 0
    first = df.agg(F.min(epoch_us(df, ts)).alias("m")).first()["m"]
    if first is None:
        return 0
    return (first // DAY_US) * DAY_US


def bucket_expr(df: DataFrame, ts: str, step_us: int, origin_us: int) -> Column:
    """Epoch-µs start of the bucket holding each row (exact integer math)."""
    us = epoch_us(df, ts)
    return us - F.pmod(us - F.lit(origin_us), F.lit(step_us))


def spine(df_buckets: DataFrame, step_us: int) -> DataFrame:
    """Every bucket start from the first to the last present one.

    Built with ``spark.range`` so it is generated in parallel; it never
    passes through the driver (the ``1S`` grid over a year is 3*10^7 rows).
    """
    spark = df_buckets.sparkSession
    row = df_buckets.agg(F.min(BUCKET).alias("lo"), F.max(BUCKET).alias("hi")).first()
    if row["lo"] is None:
        return spark.range(0).select(F.col("id").alias(BUCKET))
    n = (row["hi"] - row["lo"]) // step_us + 1
    return spark.range(n).select((F.lit(row["lo"]) + F.col("id") * F.lit(step_us)).alias(BUCKET))


def _bucketed(df: DataFrame, ts: str, freq) -> tuple[DataFrame, int]:
    step = parse_freq(freq)
    origin = bucket_origin(df, ts, step)
    return df.filter(F.col(ts).isNotNull()).withColumn(BUCKET, bucket_expr(df, ts, step, origin)), step


def _fill_value(spec: AggSpec):
    return 1.0 if spec.func == "prod" else 0


def resample(df: DataFrame, freq, agg_func="mean", *, ts: str, columns: Sequence[str] | None = None,
             tie: Sequence[str] = (), sort: bool = False) -> DataFrame:
    """Aggregate into buckets of ``freq``; drop buckets where any output is NULL.

    Empty buckets exist only when every aggregate is non-NULL on empty input
    (sum, count, size, nunique, prod); then they are filled in from the spine,
    otherwise they would be dropped anyway.
    """
    cols = resolve_columns(df, columns, exclude=[ts])
    specs = normalize(agg_func, cols)
    # total order for first/last: ties broken by the row hash (deterministic on recompute)
    order = F.struct(*[F.col(ts)] + [F.col(t) for t in tie] + [F.xxhash64(*[F.col(c) for c in df.columns])])
    b, step = _bucketed(df, ts, freq)
    agg = aggregate_groups(b, [BUCKET], specs, order)
    outs = [s.out for s in specs]
    if specs and all(is_not_null_on_empty(s) for s in specs):
        agg = spine(agg, step).join(agg, BUCKET, "left").select(
            BUCKET, *[F.coalesce(F.col(s.out), F.lit(_fill_value(s))).alias(s.out) for s in specs])
    ts_type = df.schema[ts].dataType
    out = agg.select(from_epoch_us(F.col(BUCKET), ts_type).alias(ts), *outs)
    out = out.na.drop("any", subset=outs) if outs else out
    # ``sort=True``: time order like pandas (a range sort of one row per bucket)
    return out.orderBy(ts) if sort else out


def time_bucket_stats(df: DataFrame, freq="H", *, ts: str, columns: Sequence[str] | None = None,
                      sort: bool = False) -> DataFrame:
    """``{col}_mean``, ``{col}_std``, ``{col}_count`` per bucket, empty buckets kept."""
    cols = resolve_columns(df, columns, exclude=[ts])
    b, step = _bucketed(df, ts, freq)
    exprs = []
    for c in cols:
        exprs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                  F.count(c).alias(f"{c}_count")]
    agg = b.groupBy(BUCKET).agg(*exprs)
    filled = spine(agg, step).join(agg, BUCKET, "left")
    sel = [from_epoch_us(F.col(BUCKET), df.schema[ts].dataType).alias(ts)]
    for c in cols:
        sel += [F.col(f"{c}_mean"), F.col(f"{c}_std"), F.coalesce(F.col(f"{c}_count"), F.lit(0)).alias(f"{c}_count")]
    out = filled.select(*sel)
    return out.orderBy(ts) if sort else out
