"""Grouped aggregation with user-chosen functions (A7, U2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseries.functions.aggs import agg_expr, merged_agg, normalize
from sparkseries.operators.merged import merge_groups
from sparkseries.operators.quantiles import grouped_quantiles


def custom_aggregate(df: DataFrame, groupby: str | Sequence[str], agg_dict: dict, *,
                     order: Sequence[str] = (), sort: bool = False) -> DataFrame:
    """``groupBy(keys).agg(...)``; rows with a NULL key are dropped (pandas default).

    Names, lists of names and :func:`spark_agg` expressions are Catalyst
    aggregates with map-side partial aggregation, so a key holding a large
    share of the rows is pre-aggregated in every task before the shuffle.
    ``first``/``last`` need ``order`` (the columns that define row order).
    ``sort=True`` orders the result by the keys, as pandas does (a range sort
    of one row per group).
    """
    keys = [groupby] if isinstance(groupby, str) else list(groupby)
    specs = normalize(agg_dict, [])
    # ties in ``order`` are broken by the row hash, so first/last are deterministic
    ordering = (F.struct(*[F.col(o) for o in order], F.xxhash64(*[F.col(c) for c in df.columns]))
                if order else None)
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    src = df.filter(cond) if cond is not None else df
    out = aggregate_groups(src, keys, specs, ordering)
    return out.orderBy(*keys) if sort else out


def _is_bigint(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, T.LongType)


def aggregate_groups(src: DataFrame, keys: list[str], specs, ordering=None) -> DataFrame:
    """``groupBy(keys)`` with every spec; medians take the bounded-memory path.

    Spark's exact ``percentile`` would merge all distinct values of a group in
    one task, so all medians are computed by :func:`grouped_quantiles` and joined
    on the keys (both sides have one row per group).  Python aggregates are merged
    from partial states (:func:`merge_groups`) and joined likewise.
    """
    med = [s for s in specs if s.func == "median"]
    own = [s for s in specs if isinstance(s.func, merged_agg)]
    rest = [s for s in specs if s.func != "median" and s not in own]
    if own and not med and not rest:
        return merge_groups(src, keys, own)
    out = (src.groupBy(*keys).agg(*[agg_expr(s, ordering, _is_bigint(src, s.column)) for s in rest]) if rest
           else src.select(*keys).distinct())
    if med:
        out = out.join(grouped_quantiles(src, keys, [(s.column, 0.5, s.out) for s in med]), keys, "left")
    if own:
        out = out.join(merge_groups(src, keys, own), keys, "left")
    return out.select(*keys, *[s.out for s in specs])
