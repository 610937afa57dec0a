"""Time frames ``(t - width, t]`` of any width by merging partial states, without halo copies or subtraction.

The value of a frame depends only on its timestamp, so rows are first combined into one state per distinct
timestamp (count, sum, least, greatest, mean and squared deviations; map-side, so a hot timestamp is pre-aggregated in every
task).  The time axis is cut into *blocks* of exactly one width.  A frame never spans more than two of them: it is a
suffix of the block of ``t - width`` and a prefix of the block of ``t``.  Both are running merges that only ever take in
members of the frame: an infinite or huge value before the frame cannot spoil it, as it would a difference of running totals.

A block may hold any number of timestamps, so it is also cut at the chunk bounds, into *cells*.  Inside its cell a state
is merged forwards for ``t`` and backwards for the position ``t - width`` (a *probe*, sent to the chunk it falls into); the totals
of the block's other cells come from a table with at most two rows per chunk.  The two halves meet by ``t``, and the values
are joined to the rows.  Every timestamp moves a fixed number of times, whatever the width.

Squared deviations are taken around the first mean of the frame's half, itself a member, and halves are put together by the
update formula for means, so no large common offset is squared.  Rows without a time form one frame of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseries.functions.columns import internal
from sparkseries.operators.ordering import CHUNK, KEY, Chunked, longs, with_buckets
from sparkseries.session import materialized

ORIGIN, KIND, CELL = internal("origin"), internal("kind"), internal("cell")
DATA, PROBE = 0, 1

# Names of aggregates that merge from partial states, and the parts of a state each one needs.
STATE_PARTS = {"count": ("n",), "sum": ("n", "s"), "mean": ("n", "s"), "min": ("n", "lo"), "max": ("n", "hi"),
               "std": ("n", "m", "q"), "var": ("n", "m", "q")}
MERGEABLE = tuple(STATE_PARTS)
#: Bytes up to which the table of cell totals is broadcast.
BROADCAST_BYTES = 64 << 20


#: Rows of a typical frame up to which a plain window over copied-in rows is cheaper than merging.
NARROW_ROWS = 256


def narrow(c: Chunked, width: int) -> bool:
    """Whether frames are short and no timestamp is hot: only then plain windows stay linear and in bounded tasks."""
    return not c.heavy and c.n_nulls <= max(1, c.n_rows // c.n_chunks) and width * c.n_rows <= NARROW_ROWS * max(1, c.span)


def plain_aggregate(df: DataFrame, name: str, agg: str) -> Column:
    """The aggregate as a plain window evaluates it, with the type of the merged one."""
    plain = {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp}
    return plain[agg](_summand(df, name, agg) if agg == "sum" else F.col(name))


def _summand(df: DataFrame, name: str, agg: str) -> Column:
    """What is added up for a column: exact for integers, double for the mean of anything but decimals."""
    t, c = df.schema[name].dataType, F.col(name)
    if agg == "mean" and not isinstance(t, T.DecimalType):
        return c.cast("double")
    return c.cast("decimal(38,0)") if isinstance(t, T.LongType) else c


class _States:
    """Names of the state columns of all inputs, and how they merge."""

    def __init__(self, columns: Sequence[str], agg: str):
        self.columns, self.parts = list(columns), STATE_PARTS[agg]
        self.names = [self.of(p, i) for i in range(len(self.columns)) for p in self.parts]

    @staticmethod
    def of(part: str, i: int, tag: str = "") -> str:
        return internal(f"{tag}{part}{i}")

    def initial(self, df: DataFrame, agg: str) -> list[Column]:
        """Aggregates that build a state from rows."""
        out = []
        for i, name in enumerate(self.columns):
            c = F.col(name)
            x = c.cast("double")
            make = {"n": F.count(c), "s": F.sum(_summand(df, name, agg)), "lo": F.min(c), "hi": F.max(c), "m": F.avg(x),
                    "q": F.var_pop(x) * F.count(c)}
            out += [make[p].alias(self.of(p, i)) for p in self.parts]
        return out

    def running(self, df: DataFrame, w: WindowSpec, tag: str) -> DataFrame:
        """Adds the merged states over a growing frame, as columns with the tag."""
        plain = {"n": F.sum, "s": F.sum, "lo": F.min, "hi": F.max}
        some = range(len(self.columns))
        if "m" not in self.parts:
            return df.select("*", *[plain[p](self.of(p, i)).over(w).alias(self.of(p, i, tag)) for i in some for p in self.parts])
        base = [F.first(self.of("m", i), ignorenulls=True).over(w).alias(self.of("b", i, tag)) for i in some]
        df = df.select("*", *base, *[F.sum(self.of("n", i)).over(w).alias(self.of("n", i, tag)) for i in some])
        sums = []
        for i in some:
            n, d = F.col(self.of("n", i)), F.col(self.of("m", i)) - F.col(self.of("b", i, tag))
            sums += [F.sum(n * d).over(w).alias(self.of("y", i, tag)),
                     F.sum(F.col(self.of("q", i)) + n * d * d).over(w).alias(self.of("z", i, tag))]
        df = df.select("*", *sums)
        for i in some:
            n, y = F.col(self.of("n", i, tag)), F.col(self.of("y", i, tag))
            share = F.try_divide(y, n)
            df = df.withColumns({self.of("m", i, tag): F.col(self.of("b", i, tag)) + share,
                                 self.of("q", i, tag): F.greatest(F.col(self.of("z", i, tag)) - y * share, F.lit(0.0))})
        return df.drop(*[self.of(p, i, tag) for i in some for p in ("b", "y", "z")])

    def merge(self, i: int, a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
        """The state of two disjoint parts of a frame; either may be empty (NULL or no values)."""
        zero = F.lit(0).cast("bigint")
        na, nb = F.coalesce(a["n"], zero), F.coalesce(b["n"], zero)
        out = {"n": na + nb}
        if "s" in self.parts:
            out["s"] = F.when(na == 0, b["s"]).when(nb == 0, a["s"]).otherwise(a["s"] + b["s"])
        for p, best in (("lo", F.least), ("hi", F.greatest)):
            if p in self.parts:
                out[p] = best(a[p], b[p])  # both skip NULL
        if "m" in self.parts:
            d, n = b["m"] - a["m"], (na + nb).cast("double")
            out["m"] = F.when(na == 0, b["m"]).when(nb == 0, a["m"]).otherwise(a["m"] + d * (nb / n))
            out["q"] = F.when(na == 0, b["q"]).when(nb == 0, a["q"]).otherwise(a["q"] + b["q"] + d * d * (na * (nb / n)))
        return out

    def tagged(self, i: int, tag: str) -> dict[str, Column]:
        return {p: F.col(self.of(p, i, tag)) for p in self.parts}


def _type(df: DataFrame, name: str, agg: str) -> T.DataType:
    """The type of the result: that of the plain aggregate, but exact for sums of bigint."""
    t = df.select(plain_aggregate(df, name, agg).alias("x")).schema["x"].dataType
    return T.DecimalType(38, 0) if agg == "sum" and isinstance(df.schema[name].dataType, T.LongType) else t


def _finish(s: dict[str, Column], agg: str) -> Column:
    n = s["n"]
    if agg == "count":
        return F.coalesce(n, F.lit(0).cast("bigint"))
    if agg in ("std", "var"):
        var = F.try_divide(s["q"], n - 1)
        return F.when(n >= 2, F.sqrt(var) if agg == "std" else var)
    value = {"sum": lambda: s["s"], "mean": lambda: F.try_divide(s["s"], n), "min": lambda: s["lo"], "max": lambda: s["hi"]}[agg]()
    return F.when(n >= 1, value)


def _cell_totals(c: Chunked, states: _States, run: DataFrame, key: str, width: int) -> DataFrame | None:
    """For the first and the last block of every chunk: the merged totals of the block's earlier and later cells."""
    cut = [b for b in c.bounds if b % width]
    if not cut:
        return None
    ends = _ends(c, width)
    pairs = {(k, b) for k, two in enumerate(ends) for b in two}
    spine = run.sparkSession.createDataFrame(sorted(pairs), f"{CHUNK} bigint, {CELL} bigint")
    last = F.max_by(F.struct(*[F.col(_States.of(p, i, "p_")).alias(_States.of(p, i)) for i in range(len(states.columns))
                               for p in states.parts]), KEY)
    at = (F.col(CHUNK) + 1).cast("int")
    edge = F.lit(False)
    for blocks in zip(*ends):
        edge = edge | (F.col(CELL) == F.element_at(longs(blocks), at))
    totals = run.where((F.col(KIND) == DATA) & edge).groupBy(*dict.fromkeys([key, CHUNK, CELL])).agg(last.alias("t"))
    totals = totals.select(F.col(CHUNK).alias("c"), F.col(CELL).alias("b"), "t.*")
    x = spine.join(totals, [F.col(CHUNK) == F.col("c"), F.col(CELL) == F.col("b")], "left").drop("c", "b")
    for tag, order in (("f_", F.asc(CHUNK)), ("l_", F.desc(CHUNK))):  # up to a cell, then moved on by one
        w = Window.partitionBy(CELL).orderBy(order)
        x = states.running(x, w.rowsBetween(Window.unboundedPreceding, 0), tag)
        x = x.withColumns({n: F.lag(n).over(w) for n in x.columns if n.startswith(internal(tag))})
    # earlier cells belong to the timestamps of a cell, later ones to its probes
    x = x.select(CHUNK, CELL, *[n for n in x.columns if n.startswith((internal("f_"), internal("l_")))])
    return F.broadcast(x) if len(pairs) * 32 * len(x.columns) <= BROADCAST_BYTES else x


def _ends(c: Chunked, width: int) -> list[tuple[int, int]]:
    """The start of the first and the last block of every chunk (of the outer chunks only one is cut off)."""
    first = [b - b % width for b in c.bounds]
    last = [b - 1 - (b - 1) % width for b in c.bounds]
    return list(zip([last[0], *first], [*last, first[-1]]))


def merged_time_frames(c: Chunked, columns: Sequence[str], agg: str, width: int, keep: Sequence[str]) -> DataFrame:
    """``agg`` of every column over ``(t - width, t]``; NULL where the frame has no value (``count``: 0)."""
    states = _States(columns, agg)
    some = range(len(columns))
    per_key = materialized(c.df.groupBy(KEY).agg(*states.initial(c.df, agg)), "frames")
    # every timestamp at its own place, and as a probe one width before it
    places = F.explode(F.array(F.struct(F.col(KEY).alias("at"), F.lit(DATA).alias("kind")),
                               F.struct((F.col(KEY) - F.lit(width)).alias("at"), F.lit(PROBE).alias("kind"))))
    u = per_key.where(F.col(KEY).isNotNull()).select(F.col(KEY).alias(ORIGIN), places.alias("p"), *states.names)
    u = u.select(F.col("p.at").alias(KEY), ORIGIN, F.col("p.kind").alias(KIND),
                 *[F.when(F.col("p.kind") == DATA, F.col(n)).alias(n) for n in states.names])
    u = u.withColumn(CELL, F.col(KEY) - F.pmod(F.col(KEY), F.lit(width)))
    u, key = (u.withColumn(CHUNK, F.lit(0).cast("bigint")), CELL) if c.n_chunks <= 1 else c.place(
        with_buckets(u, {CHUNK: F.col(KEY)}, c.bounds), F.col(CHUNK), by=CHUNK)
    cell = Window.partitionBy(*dict.fromkeys([key, CHUNK, CELL]))
    run = states.running(u, cell.orderBy(F.asc(KEY), F.asc(KIND)).rowsBetween(Window.unboundedPreceding, 0), "p_")
    # a probe comes before the timestamp it falls on: its frame begins behind it
    both = states.running(run, cell.orderBy(F.desc(KEY), F.desc(KIND)).rowsBetween(Window.unboundedPreceding, 0), "s_")
    totals = _cell_totals(c, states, run, key, width) if c.n_chunks > 1 else None
    if totals is not None:
        both = both.join(totals, [CHUNK, CELL], "left")
    here = F.col(KIND) == DATA
    halves = [ORIGIN]
    for i in some:
        old, new = states.tagged(i, "p_"), states.tagged(i, "s_")
        if totals is not None:
            old, new = states.merge(i, states.tagged(i, "f_"), old), states.merge(i, new, states.tagged(i, "l_"))
        halves += [F.when(here, old[p]).alias(_States.of(p, i, "p_")) for p in states.parts]
        halves += [F.when(~here, new[p]).alias(_States.of(p, i, "s_")) for p in states.parts]
    both = both.select(*halves)
    met = both.groupBy(ORIGIN).agg(*[F.max(n).alias(n) for n in both.columns[1:]])
    out = {i: internal(f"v{i}") for i in some}
    types = [_type(c.df, name, agg) for name in columns]

    def valued(d: DataFrame, state) -> DataFrame:
        return d.select(d.columns[0], *[_finish(state(i), agg).cast(types[i]).alias(out[i]) for i in some]).withColumnRenamed(d.columns[0], ORIGIN)

    values = valued(met, lambda i: states.merge(i, states.tagged(i, "s_"), states.tagged(i, "p_")))
    alone = valued(per_key.where(F.col(KEY).isNull()), lambda i: states.tagged(i, ""))  # rows without a time
    rows = c.df.select(*[k for k in keep if k not in columns], KEY)
    hot = F.col(KEY).isin(c.heavy) if c.heavy else F.lit(False)
    joined = rows.where(F.col(KEY).isNotNull() & ~hot).join(values, F.col(KEY) == F.col(ORIGIN))
    if c.n_nulls or c.heavy:
        # hot timestamps are fewer than chunks, the frame of rows without a time is one row
        few = alone if not c.heavy else alone.unionByName(values.where(F.col(ORIGIN).isin(c.heavy)))
        rest = rows.where(F.col(KEY).isNull() | hot).join(F.broadcast(few), F.col(KEY).eqNullSafe(F.col(ORIGIN)))
        joined = joined.unionByName(rest)
    order_out = list(keep) + [k for k in columns if k not in keep]
    return joined.select(*[F.col(out[list(columns).index(k)]).alias(k) if k in columns else F.col(k)
                           for k in order_out])
