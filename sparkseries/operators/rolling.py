"""Rolling windows (W1, W2) with names, Column expressions or pandas callables (U1).

* ``window: int`` -- the last ``n`` rows including the current one; the result
  is NULL unless the frame holds ``n`` non-null values (``count`` instead
  needs ``n`` rows and then counts the non-null ones).
* ``window: str`` -- the time frame ``(t - w, t]``; NULL unless the frame has
  a non-null value (``count`` is 0 then).  Rows that share a timestamp are
  all inside each other's frame (order-independent; the reference includes
  only the peers before the current physical row).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import DataFrame

from sparkseries.functions.aggs import block_agg, spark_agg
from sparkseries.functions.columns import resolve_columns
from sparkseries.functions.freq import parse_freq
from sparkseries.operators import ordering as O
from sparkseries.operators.timeframes import MERGEABLE, merged_time_frames, narrow, plain_aggregate

# Rolling aggregation names accepted by name.
ROLLING_NAMES = ("mean", "sum", "std", "var", "min", "max", "count", "median")


def _named(name: str, c: Column) -> Column:
    return {
        "mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp,
        "min": F.min, "max": F.max, "count": F.count,
        "median": lambda x: F.percentile(x, F.lit(0.5)),
    }[name](c)


def _pandas_rolling(fn, return_type=T.DoubleType()):
    @F.pandas_udf(return_type)
    def _agg(s: pd.Series) -> float:
        return fn(s)
    return _agg


def _frame_value(agg_func, col: str, frame: WindowSpec, min_count: Column | None) -> Column:
    c = F.col(col)
    if isinstance(agg_func, str):
        if agg_func not in ROLLING_NAMES:
            raise ValueError(f"unknown rolling aggregation {agg_func!r}; known: {ROLLING_NAMES}")
        value = _named(agg_func, c).over(frame)
    elif isinstance(agg_func, spark_agg):
        value = agg_func.fn(c).over(frame)
    elif callable(agg_func):
        # bounded frame: at most the window's rows reach one Python call
        value = _pandas_rolling(agg_func)(c).over(frame)
    else:
        raise TypeError("agg_func must be a name, spark_agg(...) or a callable")
    return value if min_count is None else F.when(min_count, value)


def rolling_window(df: DataFrame, columns: Sequence[str] | None = None, window: int | str = 10,
                   agg_func="mean", *, ts: str, tie: Sequence[str] = (),
                   rows_per_chunk: int | None = None) -> DataFrame:
    """Rolling aggregate of ``columns``; output: the order columns plus those columns.

    Named aggregates over time windows merge partial states per timestamp (``timeframes``): the cost does not
    grow with the width, and a bigint sum is exact (``decimal(38,0)``).  Where frames are short and no timestamp is hot,
    a plain window per chunk gives the same types and values (floating sums up to the order of addition).  Median and Column expressions are evaluated per
    chunk with the rows of the window before it copied in.  Callables need a bounded frame: a number of rows.
    :class:`block_agg` evaluates many row frames per Python call; a pandas callable is called once per row (slow).
    """
    cols = resolve_columns(df, columns, exclude=[ts, *tie])
    if not cols:
        return df
    keep = [ts, *[t for t in tie if t not in cols], *cols]
    base = df.select(*dict.fromkeys(keep))
    if isinstance(window, str):
        if isinstance(agg_func, block_agg) or (callable(agg_func) and not isinstance(agg_func, spark_agg)):
            raise TypeError("a Python callable needs a window of rows; a time window may hold any number of them")
        width = parse_freq(window)
        chunked = O.chunk(base, ts, tie, rows_per_chunk=rows_per_chunk, split_ties=False)
        named = isinstance(agg_func, str) and agg_func in MERGEABLE
        if named and not narrow(chunked, width):
            return merged_time_frames(chunked, cols, agg_func, width, keep)

        def out(col):
            def fn(w: WindowSpec) -> Column:
                n = F.count(F.col(col)).over(w)
                if named:
                    value = plain_aggregate(base, col, agg_func).over(w)
                    return value if agg_func == "count" else F.when(n >= 1, value)
                return _frame_value(agg_func, col, w, n >= 1)
            return fn
        return O.apply_time_frames(chunked, {c: out(c) for c in cols}, width, keep)

    n = int(window)
    if n < 1:
        raise ValueError("window must be >= 1")
    chunked = O.chunk(base, ts, tie, rows_per_chunk=rows_per_chunk)
    if isinstance(agg_func, block_agg):
        return O.apply_block_frames(chunked, cols, n, agg_func.fn, keep)

    def row_out(col):
        def fn(w: WindowSpec) -> Column:
            frame = w.rowsBetween(-(n - 1), 0)
            if agg_func == "count":
                rows = F.count(F.lit(1)).over(frame)
                return F.when(rows >= n, F.count(F.col(col)).over(frame))
            return _frame_value(agg_func, col, frame, F.count(F.col(col)).over(frame) >= n)
        return fn
    outs = [O.RowOutput(c, row_out(c), pre=n - 1) for c in cols]
    return O.apply_row_frames(chunked, outs, keep)
