"""Column selection and timestamp <-> epoch-microsecond conversion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order (booleans, timestamps, intervals excluded)."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def resolve_columns(df: DataFrame, columns: Iterable[str] | None,
                    exclude: Iterable[str] = ()) -> list[str]:
    """``columns`` as given, or every numeric column when ``None``."""
    if columns is None:
        return numeric_columns(df, exclude)
    cols = list(columns)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not in frame: {missing}")
    return cols


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_time_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def epoch_us(df: DataFrame, name: str) -> Column:
    """Order key of ``name`` as a bigint.

    Timestamps become epoch microseconds of their wall clock (NTZ) or instant
    (LTZ), independent of the session time zone.  Integral order columns are
    used as they are.
    """
    dt = field_type(df, name)
    col = F.col(name)
    if isinstance(dt, T.TimestampNTZType):
        # NTZ - NTZ is a day-time interval computed on the wall clock alone;
        # timestamp_diff would pass through the session time zone (DST gaps)
        seconds = (col - epoch_ntz()).cast("interval second").cast("decimal(24,6)")
        return (seconds * F.lit(1_000_000)).cast("bigint")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(dt, T.DateType):
        return F.unix_micros(F.to_timestamp(col))
    if isinstance(dt, T.IntegralType):
        return col.cast("bigint")
    raise TypeError(f"order column {name!r} must be a timestamp or integral, not {dt.simpleString()}")


def from_epoch_us(us: Column, like: T.DataType) -> Column:
    """Inverse of :func:`epoch_us` for a timestamp type."""
    if isinstance(like, T.TimestampNTZType):
        seconds = us.cast("decimal(24,0)") / F.lit(1_000_000)
        return epoch_ntz() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    if isinstance(like, T.TimestampType):
        return F.timestamp_micros(us)
    raise TypeError(f"not a timestamp type: {like.simpleString()}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float NaN -> NULL, so counts and means skip them like pandas does."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def internal(name: str) -> str:
    """Name for a helper column that cannot clash with user columns."""
    return f"__ss_{name}"
