"""Descriptive statistics (A3-A6, A8), each as a long/tidy DataFrame.

All columns are handled in one aggregate pass (plus the exact-quantile jobs
where quantiles are needed); there is never a job per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseries.functions.columns import resolve_columns
from sparkseries.operators.outliers import outlier_conditions
from sparkseries.operators.quantiles import exact_quantiles

# Statistic rows of basic_stats, in their output order.
BASIC_STATS = ("count", "mean", "std", "min", "q25", "q50", "q75", "max")

#: Rows multiplied at once by correlation_matrix.
GRAM_ROWS = 4096


def _rows(agg_row: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into rows, one per struct."""
    return agg_row.select(F.inline(F.array(*structs)))


def basic_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``statistic`` x one double column per numeric input column."""
    cols = resolve_columns(df, columns)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(c).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"),
                 F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    if not aggs:
        return df.sparkSession.createDataFrame([(s,) for s in BASIC_STATS], "statistic string")
    # one scalar row of count/mean/std/min/max for all columns; the quantile
    # search reuses its counts and bounds
    moments = df.agg(*aggs).first().asDict()
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75], known=moments)
    names = {"count": "n", "mean": "mean", "std": "std", "min": "lo", "max": "hi"}
    quant = {"q25": 0.25, "q50": 0.5, "q75": 0.75}

    def value(stat: str, i: int, c: str):
        if stat in quant:
            return qs[(c, quant[stat])]
        v = moments[f"{names[stat]}{i}"]
        return None if v is None else float(v)

    rows = [tuple([s] + [value(s, i, c) for i, c in enumerate(cols)]) for s in BASIC_STATS]
    schema = ", ".join(["statistic string"] + [f"`{c}` double" for c in cols])
    return df.sparkSession.createDataFrame(rows, schema)


def _finite(batch) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for what is missing, NaN or infinite; 1.0 where a value is there), rows x columns."""
    v = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
    there = np.isfinite(v)
    return np.where(there, v, 0.0), there.astype(np.float64)


def _shifts(d: DataFrame) -> np.ndarray:
    """About the mean of every column's finite values (0 where there is none)."""
    k = len(d.columns)

    def run(batches):
        import pyarrow as pa

        n, mean = np.zeros(k), np.zeros(k)
        for batch in batches:
            v, there = _finite(batch)
            for at in range(0, len(v), GRAM_ROWS):
                w = there[at:at + GRAM_ROWS].sum(axis=0)
                n += w
                with np.errstate(over="ignore", invalid="ignore"):
                    mean += np.where(w > 0, (v[at:at + GRAM_ROWS].sum(axis=0) - w * mean) / np.maximum(n, 1), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(mean)],
                                         names=["i", "n", "mean"])

    rows = d.mapInArrow(run, "i int, n double, mean double").where("n > 0").groupBy("i").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")).collect()
    out = np.zeros(k)
    for r in rows:
        out[r["i"]] = r["mean"] if math.isfinite(r["mean"]) else 0.0
    return out


def _grams(d: DataFrame, shift: np.ndarray) -> dict[str, np.ndarray]:
    """Columns x columns sums over the rows where both columns are present: how many (n), of the shifted values of
    the first (a), of their squares (aa) and of the products (ab)."""
    k = len(d.columns)
    names = ["n", "a", "aa", "ab"]

    def run(batches):
        import pyarrow as pa

        total = np.zeros((4, k, k))
        for batch in batches:
            v, there = _finite(batch)
            for at in range(0, len(v), GRAM_ROWS):
                w = there[at:at + GRAM_ROWS]
                x = (v[at:at + GRAM_ROWS] - shift) * w
                with np.errstate(over="ignore", invalid="ignore"):
                    total += w.T @ w, x.T @ w, (x * x).T @ w, x.T @ x
        for i in range(k):  # one row of each matrix at a time
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, i, np.int32)), pa.array(np.arange(k, dtype=np.int32)),
                                              *[pa.array(m[i]) for m in total]], names=["i", "j", *names])

    got = d.mapInArrow(run, "i int, j int, n double, a double, aa double, ab double").groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in names]).toArrow()
    out = {}
    for c in names:
        out[c] = np.zeros((k, k))
        out[c][got["i"].to_numpy(), got["j"].to_numpy()] = got[c].to_numpy()
    return out


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation, pairwise-complete; rows ``column`` x columns.

    A constant (or all-NULL) column gives NULL, also on its own diagonal.  Infinite
    values and NaN are left out like NULLs, pair by pair.
    Two scans for any number of columns: the first finds about the mean of each column; in the second every
    task adds up products of blocks of rows, of mean-shifted values (no cancellation of raw moment sums) and
    of the masks of what is present, and only these columns x columns sums are shuffled.
    """
    cols = resolve_columns(df, columns)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string")
    d = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    m = _grams(d, _shifts(d))
    with np.errstate(all="ignore"):
        n = np.where(m["n"] < 2, np.nan, m["n"])
        within = m["aa"] - m["a"] ** 2 / n  # of the first column of the pair; the transpose has the second
        r = (m["ab"] - m["a"] * m["a"].T / n) / np.sqrt(within * within.T)
        r = np.where((within > 0) & (within.T > 0), np.clip(r, -1.0, 1.0), np.nan)
    np.fill_diagonal(r, np.where(np.isnan(np.diag(r)), np.nan, 1.0))
    rows = [(c, *[None if math.isnan(x) else float(x) for x in r[i]]) for i, c in enumerate(cols)]
    schema = ", ".join(["`column` string"] + [f"`{c}` double" for c in cols])
    return spark.createDataFrame(rows, schema)


def outlier_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Tukey-fence (1.5 IQR) outliers per column: ``column, count, percentage``.

    The percentage is over the non-null values of the column (NULL if none).
    """
    cols = resolve_columns(df, columns)
    conds = outlier_conditions(df, cols, "iqr", 1.5)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count_if(conds[c]).alias(f"o{i}"), F.count(c).alias(f"n{i}")]
    one = df.agg(*aggs) if aggs else df.agg(F.count(F.lit(1)).alias("n"))
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("count"),
                        (F.try_divide(F.col(f"o{i}"), F.col(f"n{i}")) * 100.0).alias("percentage"))
               for i, c in enumerate(cols)]
    return _rows(one, structs) if structs else one.select(
        F.lit(None).cast("string").alias("column"), F.lit(0).cast("bigint").alias("count"),
        F.lit(None).cast("double").alias("percentage")).limit(0)


def outlier_summary(df: DataFrame, columns: Sequence[str] | None = None, method: str = "zscore",
                    threshold: float = 3.0, *, exclude: Sequence[str] = ()) -> DataFrame:
    """Flag counts per column with the percentage over *all* rows (dashboard summary)."""
    cols = resolve_columns(df, columns, exclude=exclude)
    conds = outlier_conditions(df, cols, method, threshold)
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(conds[c]).alias(f"o{i}")
                                                    for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("count"),
                        (F.try_divide(F.col(f"o{i}"), F.col("total")) * 100.0).alias("percentage"))
               for i, c in enumerate(cols)]
    return _rows(one, structs)


def histogram_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin of ``x`` over ``[lo, hi]``; the last bin is right-closed.

    Same assignment as ``numpy.histogram``: a first guess from the scaled
    offset, then one correction step against the exact bin edges
    ``lo + i * (hi - lo) / bins`` (last edge ``hi``).
    """
    step = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))

    guess = F.least(((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
    dec = F.when(x < edge(guess), guess - 1).otherwise(guess)
    inc = F.when((x >= edge(dec + 1)) & (dec != bins - 1), dec + 1).otherwise(dec)
    inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
    return F.when(inside, inc)


def distributions(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 50) -> DataFrame:
    """Histogram per column: ``column, bin, bin_center, count`` (zero bins included).

    Bounds come from one aggregate; binning and counting is one more pass
    whose shuffle carries at most ``columns x bins`` partial counts per task.
    """
    if bins < 1:
        raise ValueError("bins must be >= 1")
    cols = resolve_columns(df, columns)
    spark = df.sparkSession
    if not cols:
        return spark.range(0).select(F.lit("").alias("column"), F.lit(0).alias("bin"),
                                     F.lit(0.0).alias("bin_center"), F.lit(0).cast("bigint").alias("count"))
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    ranges = []
    for i, _ in enumerate(cols):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None:
            lo, hi = 0.0, 1.0
        elif not (math.isfinite(lo) and math.isfinite(hi)):
            raise ValueError(f"column {cols[len(ranges)]!r} holds infinite values or NaN: it has no equal-width bins")
        elif lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        ranges.append((float(lo), float(hi)))
    binned = df.select(*[histogram_bin(F.col(c).cast("double"), lo, hi, bins).alias(f"b{i}")
                         for i, (c, (lo, hi)) in enumerate(zip(cols, ranges))])
    stacked = binned.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("bin")) for i, c in enumerate(cols)])).alias("e"))
    counts = (stacked.select("e.column", "e.bin").filter(F.col("bin").isNotNull())
              .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count")))
    # every (column, bin) pair, generated from a range: columns x bins rows
    names = F.array(*[F.lit(c) for c in cols])
    los = F.array(*[F.lit(lo) for lo, _ in ranges])
    his = F.array(*[F.lit(hi) for _, hi in ranges])
    k = (F.col("id") / bins).cast("int") + 1
    b = (F.col("id") % bins).cast("int")
    lo_k, hi_k = F.element_at(los, k), F.element_at(his, k)
    step_k = (hi_k - lo_k) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, hi_k).otherwise(i.cast("double") * step_k + lo_k)

    grid = spark.range(len(cols) * bins).select(
        F.element_at(names, k).alias("column"), b.alias("bin"),
        ((edge(b) + edge(b + 1)) / 2).alias("bin_center"))
    return (grid.join(counts, ["column", "bin"], "left")
            .select("column", "bin", "bin_center", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))
