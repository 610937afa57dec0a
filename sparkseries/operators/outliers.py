"""Outlier flags (P4 z-score, P5 IQR).

Column statistics are computed once for all columns (one aggregate, or the
exact-quantile jobs) and then enter the flag expressions as literals, so the
flagging itself is a narrow projection: no join, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseries.functions.columns import numeric_columns, resolve_columns
from sparkseries.operators.quantiles import exact_quantiles

METHODS = ("zscore", "iqr")


def outlier_conditions(df: DataFrame, columns: Sequence[str], method: str = "zscore",
                       threshold: float = 3.0) -> dict[str, Column]:
    """``{column: boolean Column}`` -- NULL values and degenerate columns give False."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    cols = list(columns)
    if not cols:
        return {}
    out = {}
    if method == "zscore":
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            m, s = row[f"m{i}"], row[f"s{i}"]
            if m is None or not s or math.isnan(m) or math.isnan(s):  # infinite values leave no deviation to compare with
                out[c] = F.lit(False)
            else:
                z = F.abs((F.col(c) - F.lit(m)) / F.lit(s)).cast("double")
                # NaN is greater than any number to Spark, but no outlier
                out[c] = F.coalesce((z > F.lit(float(threshold))) & ~F.isnan(z), F.lit(False))
    else:
        qs = exact_quantiles(df, cols, [0.25, 0.75])
        for c in cols:
            q1, q3 = qs[(c, 0.25)], qs[(c, 0.75)]
            if q1 is None:
                out[c] = F.lit(False)
                continue
            iqr = q3 - q1
            lo, hi = q1 - threshold * iqr, q3 + threshold * iqr
            out[c] = F.coalesce((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi)), F.lit(False))
    return out


def detect_outliers(df: DataFrame, columns: Sequence[str] | None = None, method: str = "zscore",
                    threshold: float = 3.0, *, keep: Sequence[str] = ()) -> DataFrame:
    """Boolean frame: ``keep`` columns (e.g. the time axis) plus one flag per column.

    With an empty column list every numeric column is reported as all-False,
    as in the reference.
    """
    cols = resolve_columns(df, columns, exclude=keep)
    if not cols:
        return df.select(*keep, *[F.lit(False).alias(c) for c in numeric_columns(df, exclude=keep)])
    conds = outlier_conditions(df, cols, method, threshold)
    return df.select(*keep, *[conds[c].alias(c) for c in cols])
