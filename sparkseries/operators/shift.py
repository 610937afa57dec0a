"""Differences (W3) and lag features (W4) by row position in ``(ts, *tie)`` order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from sparkseries.functions.columns import resolve_columns
from sparkseries.operators import ordering as O


def shifted(col: str, k: int, w: WindowSpec) -> Column:
    """Value ``k`` rows earlier (``k < 0``: later)."""
    if k == 0:
        return F.col(col)
    return F.lag(col, k).over(w) if k > 0 else F.lead(col, -k).over(w)


def _reach(k: int) -> dict:
    return {"pre": k, "post": 0} if k >= 0 else {"pre": 0, "post": -k}


def difference(df: DataFrame, columns: Sequence[str] | None = None, periods: int = 1, *, ts: str,
               tie: Sequence[str] = (), rows_per_chunk: int | None = None) -> DataFrame:
    """Replace each column by ``x - x[i - periods]``; other columns unchanged."""
    cols = resolve_columns(df, columns, exclude=[ts, *tie])
    if not cols:
        return df
    chunked = O.chunk(df, ts, tie, rows_per_chunk=rows_per_chunk)

    def fn(col):
        return lambda w: F.col(col) - shifted(col, periods, w)
    outs = [O.RowOutput(c, fn(c), **_reach(periods)) for c in cols]
    return O.apply_row_frames(chunked, outs, df.columns)


def create_lags(df: DataFrame, columns: Sequence[str] | None = None, lags: int | Sequence[int] = 1, *,
                ts: str, tie: Sequence[str] = (), rows_per_chunk: int | None = None) -> DataFrame:
    """Append ``{col}_lag_{k}`` for every column and lag (negative = lead)."""
    cols = resolve_columns(df, columns, exclude=[ts, *tie])
    ks = [lags] if isinstance(lags, int) else list(lags)
    if not cols or not ks:
        return df
    chunked = O.chunk(df, ts, tie, rows_per_chunk=rows_per_chunk)

    def fn(col, k):
        return lambda w: shifted(col, k, w)
    outs = [O.RowOutput(f"{c}_lag_{k}", fn(c, k), **_reach(k)) for c in cols for k in ks]
    return O.apply_row_frames(chunked, outs, df.columns)
