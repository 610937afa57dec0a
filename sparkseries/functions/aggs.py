"""Aggregation names and callables -> Catalyst aggregate expressions.

Accepted forms, as in the reference API: a name, a list of names, a dict
``{column: name | [names] | callable}``, or a callable.  Output naming:
``col`` for a single function, ``col_fn`` when a column gets a list.

Callables come in two kinds:

* :func:`spark_agg` wraps ``Column -> Column`` (e.g. ``F.max(c) - F.min(c)``):
  it stays a Catalyst aggregate with partial (map-side) aggregation and is the
  form grouped and bucketed aggregations accept.
* :class:`merged_agg` is a Python aggregate given as four functions on a small state.  Tasks add their rows to one
  state per group, and only states are shuffled and merged, so groups of any size are fine.
* a plain Python callable taking a pandas Series.  It can only be evaluated on
  a whole group at once, so it is accepted where the group is bounded (rolling
  frames of a fixed row count); grouped/bucketed aggregations reject it, since
  one key may hold a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class spark_agg:  # noqa: N801 - used like a function
    """A ``Column -> Column`` aggregate, e.g. ``spark_agg(lambda c: F.max(c) - F.min(c), "range")``."""

    fn: Callable[[Column], Column]
    name: str = "custom"


@dataclass(frozen=True)
class merged_agg:  # noqa: N801 - used like a function
    """A Python aggregate whose partial results merge, for grouped and bucketed aggregation.

    ``start()`` gives the state of no rows, ``add(state, values)`` the state after a numpy array of non-NULL values
    (never empty, of one group, in no particular order), ``merge(a, b)`` that of both, ``finish(state)`` a number or
    None.  States are pickled and have to stay small whatever the number of rows.
    """

    start: Callable
    add: Callable
    merge: Callable
    finish: Callable
    name: str = "custom"


@dataclass(frozen=True)
class block_agg:  # noqa: N801 - used like a function
    """A rolling function evaluated on many frames at once: ``fn`` maps a float64 array (frames x window, rows in
    time order, read-only) to one number per frame.  It sees full frames without NULLs only."""

    fn: Callable
    name: str = "custom"


# Aggregation names understood by name, and those whose value on
# an empty group is not NULL (pandas gives 0 for these, and 1 for prod).
AGG_NAMES = ("mean", "sum", "std", "var", "min", "max", "count", "size", "median",
             "first", "last", "nunique", "prod")
NOT_NULL_ON_EMPTY = ("sum", "count", "size", "nunique", "prod")


@dataclass(frozen=True)
class AggSpec:
    column: str
    func: object  # str | spark_agg | Callable
    out: str

    @property
    def fname(self) -> str:
        if isinstance(self.func, str):
            return self.func
        if isinstance(self.func, (spark_agg, merged_agg)):
            return self.func.name
        return getattr(self.func, "__name__", "custom")

    @property
    def is_pandas(self) -> bool:
        return not isinstance(self.func, (str, spark_agg, merged_agg)) and callable(self.func)


def _fname(f) -> str:
    return AggSpec("", f, "").fname


def normalize(agg_func, columns: Sequence[str]) -> list[AggSpec]:
    """Expand the user's aggregation argument into one spec per output column."""
    specs: list[AggSpec] = []
    if isinstance(agg_func, dict):
        for col, v in agg_func.items():
            if isinstance(v, (list, tuple)):
                specs += [AggSpec(col, f, f"{col}_{_fname(f)}") for f in v]
            else:
                specs.append(AggSpec(col, v, col))
    elif isinstance(agg_func, (list, tuple)):
        specs = [AggSpec(c, f, f"{c}_{_fname(f)}") for c in columns for f in agg_func]
    else:
        specs = [AggSpec(c, agg_func, c) for c in columns]
    for s in specs:
        if isinstance(s.func, str) and s.func not in AGG_NAMES:
            raise ValueError(f"unknown aggregation {s.func!r}; known: {AGG_NAMES}")
        if not isinstance(s.func, str) and not callable(s.func) and not isinstance(s.func, (spark_agg, merged_agg)):
            raise TypeError(f"aggregation for {s.column!r} must be a name or callable")
    return specs


def is_not_null_on_empty(spec: AggSpec) -> bool:
    return isinstance(spec.func, str) and spec.func in NOT_NULL_ON_EMPTY


def agg_expr(spec: AggSpec, order: Column | None = None, bigint: bool = False) -> Column:
    """Catalyst aggregate for one spec (pandas semantics: NULLs skipped); ``bigint`` columns are summed exactly."""
    c = F.col(spec.column)
    f = spec.func
    if isinstance(f, spark_agg):
        return f.fn(c).alias(spec.out)
    if spec.is_pandas:
        raise TypeError(
            f"a pandas callable for {spec.column!r} would gather each whole group in one "
            "task; wrap a Column expression in spark_agg(...) or give the four functions of merged_agg(...)")
    if f == "mean":
        e = F.avg(c)
    elif f == "sum":
        # widened to the sum's own type; a bigint sum may need more than 64 bits
        e = F.coalesce(F.sum(c.cast("decimal(38,0)") if bigint else c), F.lit(0))
    elif f == "std":
        e = F.stddev_samp(c)
    elif f == "var":
        e = F.var_samp(c)
    elif f == "min":
        e = F.min(c)
    elif f == "max":
        e = F.max(c)
    elif f == "count":
        e = F.count(c)
    elif f == "size":
        e = F.count(F.lit(1))
    elif f == "median":
        # exact, but one group's distinct values meet in one task; grouped and
        # bucketed aggregations route medians to quantiles.grouped_quantiles
        e = F.percentile(c, F.lit(0.5))
    elif f == "nunique":
        e = F.count_distinct(c)
    elif f == "prod":
        e = F.coalesce(F.product(c), F.lit(1.0))
    elif f in ("first", "last"):
        if order is None:
            raise ValueError(f"{f!r} needs an order column")
        key = F.when(c.isNotNull(), order)
        e = F.min_by(c, key) if f == "first" else F.max_by(c, key)
    else:  # pragma: no cover - normalize() rejects these
        raise ValueError(f)
    return e.alias(spec.out)
