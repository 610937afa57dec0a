"""Time-range filter (P1) and the plotted tail of a series (P3)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseries.functions.columns import numeric_columns


def time_literal(value, like: T.DataType):
    """An ISO-ish string or datetime as a literal of the time column's type.

    The literal is folded at planning time, so the comparison on the raw
    column reaches the Parquet scan as a pushed filter.
    """
    iso = pd.Timestamp(value).isoformat()
    target = "timestamp_ntz" if isinstance(like, T.TimestampNTZType) else "timestamp"
    return F.lit(iso).cast(target)


def filter_time_range(df: DataFrame, start, end, *, ts: str) -> DataFrame:
    """Rows with ``start <= ts <= end`` (both ends inclusive), all columns kept."""
    dt = df.schema[ts].dataType
    return df.filter(F.col(ts).between(time_literal(start, dt), time_literal(end, dt)))


def tail_rows(df: DataFrame, *, ts: str, tie: Sequence[str] = (), columns: Sequence[str] | None = None,
              n: int) -> DataFrame:
    """The last ``n`` rows of the chosen columns (default: the first numeric one).

    Planned as a top-k (``TakeOrderedAndProject``): each task keeps its own
    best ``n`` rows, so no task ever holds more than ``n`` rows per partition.
    """
    cols = list(columns) if columns is not None else numeric_columns(df, exclude=[ts, *tie])[:1]
    order = [F.col(ts).desc_nulls_last()] + [F.col(t).desc_nulls_last() for t in tie]
    last = df.select(ts, *[t for t in tie if t not in cols], *cols).orderBy(*order).limit(n)
    # back to time order for display: a sort of at most n rows
    return last.orderBy(*[F.col(ts).asc_nulls_first()] + [F.col(t).asc_nulls_first() for t in tie])
