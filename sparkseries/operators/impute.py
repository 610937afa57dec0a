"""Missing-value imputation (W5-W8): ffill, bfill, time or linear interpolation.

* ``ffill``/``bfill`` fill every column (strings included) from the nearest
  earlier/later non-null value; with ``limit=k`` only the first ``k`` nulls of
  each run (ffill) or the last ``k`` before the next value (bfill).
* ``interpolate`` fills numeric columns: linear in time when ordered by a
  timestamp, linear in row position otherwise.  Leading nulls stay; trailing
  nulls take the last value; ``limit=k`` fills the first ``k`` of each run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from sparkseries.functions.columns import is_time_type, numeric_columns
from sparkseries.operators import ordering as O

METHODS = ("ffill", "bfill", "interpolate")


def impute_missing(df: DataFrame, method: str = "ffill", limit: int | None = None, *, ts: str,
                   tie: Sequence[str] = (), rows_per_chunk: int | None = None) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    if limit is not None and limit < 1:
        raise ValueError("limit must be >= 1")
    targets = [c for c in df.columns if c != ts and c not in tie]
    if method == "interpolate":
        return _interpolate(df, ts, tie, limit, rows_per_chunk)
    if not targets:
        return df
    chunked = O.chunk(df, ts, tie, rows_per_chunk=rows_per_chunk)
    if limit is not None:
        if method == "ffill":
            outs = [O.RowOutput(c, _fill_fn(c, -limit, 0, last=True), pre=limit) for c in targets]
        else:
            outs = [O.RowOutput(c, _fill_fn(c, 0, limit, last=False), post=limit) for c in targets]
        return O.apply_row_frames(chunked, outs, df.columns)
    forward = {c: F.col(c) for c in targets} if method == "ffill" else {}
    backward = {c: F.col(c) for c in targets} if method == "bfill" else {}

    def combine(prev, nxt):
        got = prev if method == "ffill" else nxt
        return [got[c].alias(c) if c in got else F.col(c) for c in df.columns]
    return O.apply_carry(chunked, chunked.df, forward, backward, combine)


def _fill_fn(col: str, lo: int, hi: int, last: bool):
    def fn(w):
        frame = w.rowsBetween(lo, hi)
        return (F.last if last else F.first)(F.col(col), ignorenulls=True).over(frame)
    return fn


def _interpolate(df: DataFrame, ts: str, tie: Sequence[str], limit: int | None,
                 rows_per_chunk: int | None) -> DataFrame:
    cols = numeric_columns(df, exclude=[ts, *tie])
    if not cols:
        return df
    by_time = is_time_type(df.schema[ts].dataType)
    chunked = O.chunk(df, ts, tie, rows_per_chunk=rows_per_chunk)
    need_idx = (not by_time) or limit is not None
    base, placed_by = O.with_row_index(chunked) if need_idx else (chunked.df, None)
    pos = F.col(O.KEY) if by_time else F.col(O.IDX)
    idx = F.col(O.IDX) if need_idx else F.lit(0)

    def point(c: str) -> Column:
        return F.when(F.col(c).isNotNull(),
                      F.struct(pos.cast("double").alias("p"), idx.alias("i"), F.col(c).cast("double").alias("v")))

    forward = {c: point(c) for c in cols}
    backward = {c: point(c) for c in cols}

    def combine(prev, nxt):
        out = []
        here_p = pos.cast("double")
        for col in df.columns:
            if col not in cols:
                out.append(F.col(col))
                continue
            p0, p1 = prev[col], nxt[col]
            slope = (p1["v"] - p0["v"]) * F.try_divide(here_p - p0["p"], p1["p"] - p0["p"])
            value = (F.when(F.col(col).isNotNull(), F.col(col).cast("double"))
                     .when(p0.isNull(), F.lit(None).cast("double"))
                     .when(p1.isNull(), p0["v"])
                     .otherwise(p0["v"] + F.coalesce(slope, F.lit(0.0))))
            if limit is not None:
                value = F.when(F.col(col).isNotNull() | (idx - p0["i"] <= limit), value)
            out.append(value.alias(col))
        return out
    return O.apply_carry(chunked, base, forward, backward, combine, placed_by)


