"""Exact linear-interpolated quantiles with bounded memory.

``percentile`` is exact but its buffer holds every distinct value of a
column in one map, which does not fit at table scale.  Here the two order
statistics around each wanted rank ``h = (n - 1) * q`` are found by radix
selection: a double's 64 bits, read so that they sort like the values, are taken
``DIGIT`` bits at a time.  A pass counts the values of every open bracket (a prefix of the
bits) by their next digit; the digit holding the rank extends the prefix.  All columns and ranks
share one pass, every task adds up its counts before they are shuffled (at most ``2**DIGIT``
numbers per bracket), and 64 bits need at most six passes, however the values are spread.  A
bracket with at most ``max_select`` rows is finished at once: its values are sorted inside one
task, a bounded group.  The answer equals ``percentile`` / ``numpy.quantile`` / DuckDB ``quantile_cont``.

Every job collects scalars only (counts per digit, two values per bracket).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_SELECT = 50_000
DIGIT = 12
#: Bracket tables (per-group form) up to this size are broadcast; beyond it both sides are salted.
BROADCAST_BYTES, SALTS = 8 << 20, 64


@dataclass
class _Target:
    col: str
    rank: int  # 0-based
    low: float | None = None  # bracket [low, high] on values
    high: float | None = None
    below: int = 0  # rows with value < low
    inside: int = 0  # rows with low <= value <= high

    bits: tuple[int, int] | None = None  # leading bits all values inside share: how many, which

    @property
    def key(self) -> tuple:
        return self.col, self.bits

    @property
    def single(self) -> bool:
        return self.low == self.high or (self.low != self.low and self.high != self.high)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], *,
                    max_select: int = DEFAULT_MAX_SELECT, known: dict | None = None
                    ) -> dict[tuple[str, float], float | None]:
    """``{(column, q): value}``; NULLs are skipped, an all-NULL column gives None.

    ``known`` may carry ``n{i}``, ``lo{i}``, ``hi{i}`` (count, min, max of the
    i-th column) from an aggregate the caller runs anyway.
    """
    cols = list(columns)
    if not cols:
        return {}
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    row = known or d.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                         *[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                         *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first().asDict()
    # one bracket per wanted rank: two ranks in different heavy values never share one
    at: dict[tuple[str, int], _Target] = {}
    wanted: dict[tuple[str, float], tuple[int, int, float]] = {}
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        for q in probs if n else ():
            h = (n - 1) * q
            wanted[(c, q)] = math.floor(h), math.ceil(h), h - math.floor(h)
            for rank in wanted[(c, q)][:2]:
                at.setdefault((c, rank), _Target(c, rank, row[f"lo{i}"], row[f"hi{i}"], 0, n))
    for t in at.values():
        t.bits = _shared_bits(*[int(v) for v in ordered_bits(np.array([t.low, t.high], np.float64))])
    targets = list(at.values())
    _narrow(d, [t for t in targets if not t.single and t.inside > max_select], max_select)
    # a bracket narrowed to one value has its answer (and may hold many rows)
    picked = _select(d, [t for t in targets if not t.single])
    value = {k: t.low if t.single else picked[id(t)] for k, t in at.items()}
    out: dict[tuple[str, float], float | None] = {(c, q): None for c in cols for q in probs}
    for (c, q), (lo, hi, frac) in wanted.items():
        a, b = value[(c, lo)], value[(c, hi)]
        out[(c, q)] = a if frac == 0 or a == b else a + (b - a) * frac
    return out


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned 64-bit numbers in the same order (NaN last, both zeros alike)."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _value(b: int) -> float:
    b = b ^ (1 << 63) if b >> 63 else b ^ ((1 << 64) - 1)
    return float(np.array([b], np.uint64).view(np.float64)[0])


def _shared_bits(a: int, b: int) -> tuple[int, int]:
    """(number of leading bits that everything from ``a`` to ``b`` shares, those bits)."""
    same = 64 - (a ^ b).bit_length()
    return same, a >> (64 - same)


def _inside(batch, brackets):
    """Yield (number, bits) of the values of a batch inside each bracket (column number, known bits, prefix)."""
    bits: dict[int, np.ndarray] = {}
    for g, (c, known, prefix) in enumerate(brackets):
        if c not in bits:
            bits[c] = ordered_bits(batch.column(c).drop_null().to_numpy(zero_copy_only=False))
        b = bits[c]
        yield g, b[b >> np.uint64(64 - known) == np.uint64(prefix)] if known else b


def _digits(d: DataFrame, brackets: list[tuple[int, int, int]]) -> dict[int, list[tuple]]:
    """For every bracket the next digits that occur in it, ascending: (rows, least and greatest bits)."""

    def run(batches):
        import pyarrow as pa

        shape = len(brackets), 1 << DIGIT
        counts, low, high = np.zeros(shape, np.int64), np.full(shape, 2**64 - 1, np.uint64), np.zeros(shape, np.uint64)
        for batch in batches:
            for g, b in _inside(batch, brackets):
                known = brackets[g][1]
                digit = (b >> np.uint64(max(0, 64 - known - DIGIT))).astype(np.int64) & ((1 << min(DIGIT, 64 - known)) - 1)
                counts[g] += np.bincount(digit, minlength=1 << DIGIT)
                np.minimum.at(low[g], digit, b)
                np.maximum.at(high[g], digit, b)
        at = np.nonzero(counts)
        # shifted to signed numbers of the same order
        lo, hi = ((x[at] ^ np.uint64(1 << 63)).view(np.int64) for x in (low, high))
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(counts[at]),
                                          pa.array(lo), pa.array(hi)], names=["g", "digit", "n", "lo", "hi"])

    got = d.mapInArrow(run, "g int, digit int, n long, lo long, hi long").groupBy("g", "digit").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    out: dict[int, list[tuple]] = {g: [] for g in range(len(brackets))}
    for g, _, n, lo, hi in sorted(zip(*[got[k].to_pylist() for k in ("g", "digit", "n", "lo", "hi")])):
        out[g].append((n, lo + (1 << 63), hi + (1 << 63)))
    return out


def _narrow(d: DataFrame, todo: list[_Target], max_select: int) -> None:
    """Shrink brackets until each holds at most ``max_select`` rows (or one value)."""
    while todo:
        keys = list(dict.fromkeys(t.key for t in todo))
        digits = _digits(d, [(d.columns.index(c), *bits) for c, bits in keys])
        for t in todo:
            for n, lo, hi in digits[keys.index(t.key)]:
                if t.below + n > t.rank:  # the digit that holds the rank
                    break
                t.below += n
            t.inside, t.low, t.high, t.bits = n, _value(lo), _value(hi), _shared_bits(lo, hi)
        todo = [t for t in todo if not t.single and t.inside > max_select]


def _select(d: DataFrame, targets: list[_Target]) -> dict[int, float]:
    """Order statistics inside each bracket (targets sharing a bracket share a group)."""
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault(t.key, []).append(t)
    keys = list(groups)
    if not keys:
        return {}
    brackets = [(d.columns.index(c), *bits) for c, bits in keys]

    def run(batches):  # one (group, value) row per value inside a group's bracket
        import pyarrow as pa

        for batch in batches:
            for g, b in _inside(batch, brackets):
                v = np.where(b >> np.uint64(63) == 1, b ^ np.uint64(1 << 63), ~b).view(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), g, np.int32)), pa.array(v)], names=["g", "v"])

    rows = d.mapInArrow(run, "g int, v double")
    wanted = F.create_map(*[x for g, k in enumerate(keys)
                            for x in (F.lit(g), F.array(*[F.lit(t.rank - t.below + 1) for t in groups[k]]))])
    # each bracket holds at most max_select values: sort them inside one task
    # and pick the wanted ranks there; only the picked values are collected
    ranked = rows.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("s"))
    picks = ranked.select("g", F.element_at(wanted, F.col("g")).alias("pos"), "s").select(
        "g", F.arrays_zip(F.col("pos").alias("rn"),
                          F.transform("pos", lambda i: F.element_at(F.col("s"), i)).alias("v")).alias("p"))
    hits = picks.select("g", F.inline("p")).collect()
    found = {(r["g"], r["rn"]): r["v"] for r in hits}
    return {id(t): found[(g, t.rank - t.below + 1)] for g, k in enumerate(keys) for t in groups[k]}


def grouped_quantile(df: DataFrame, keys: Sequence[str], column: str, q: float, out: str, *,
                     max_select: int = DEFAULT_MAX_SELECT) -> DataFrame:
    """Exact linear-interpolated quantile of ``column`` per group: ``keys..., out``, NULL where a group has no value."""
    res = grouped_quantiles(df, keys, [(column, q, out)], max_select=max_select)
    groups = df.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).distinct()
    same = [groups[f"__{i}"].eqNullSafe(res[k]) for i, k in enumerate(keys)]
    return groups.join(res, same, "left").select(*[F.col(f"__{i}").alias(k) for i, k in enumerate(keys)], out)


def _signed(x: np.ndarray) -> np.ndarray:
    """Doubles as signed longs in the same order."""
    return (ordered_bits(x) ^ np.uint64(1 << 63)).view(np.int64)


def _doubles(x: np.ndarray) -> np.ndarray:
    """The inverse of ``_signed``."""
    return np.where(x < 0, ~x ^ np.int64(-2**63), x).view(np.float64)


def _table_size(g: DataFrame, by: list[str], rows) -> tuple[int, int]:
    """Number and bytes of the ``rows`` of a bracket table."""
    texts = [F.coalesce(F.octet_length(k), F.lit(0)) for k, t in g.dtypes if k in by and t in ("string", "binary")]
    one = g.where(rows).agg(F.count(F.lit(1)).alias("n"), F.sum(sum(texts, F.lit(16 * len(g.columns)))).alias("size")).first()
    return one["n"], one["size"] or 0


def _values_in(d: DataFrame, brackets: DataFrame, by: list[str], size: int) -> DataFrame:
    """Every value of ``d`` once for each bracket (``by``, lo, hi, below) that holds it, and its next ``DIGIT`` bits.

    A bracket table of checked size is broadcast.  A larger one is repeated for every salt and a row takes the salt
    of its input partition, so that a hot group is spread over ``SALTS`` tasks.
    """
    b = brackets.select(*[F.col(k).alias(f"b_{k}") for k in by], "lo", "hi", "below",
                        F.expr(f"greatest(0, length(bin(lo ^ hi)) - {DIGIT})").alias("shift"))
    on = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in by]
    if size <= BROADCAST_BYTES:
        b = F.broadcast(b)
    else:
        d = d.withColumn("salt", F.spark_partition_id() % SALTS)
        b = b.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on.append(F.col("salt") == F.col("b_salt"))
    return d.join(b, [*on, F.col("v").between(F.col("lo"), F.col("hi"))]).select(
        *by, "lo", "hi", "below", "v", F.expr("shiftright(v, shift)").alias("digit"))


def grouped_quantiles(df: DataFrame, keys: Sequence[str], wanted: Sequence[tuple[str, float, str]], *,
                      max_select: int = DEFAULT_MAX_SELECT) -> DataFrame:
    """Exact linear-interpolated quantiles per group, all ``(column, q, out)`` in one loop: ``keys..., outs...``.

    The per-group form of :func:`exact_quantiles`, without ever holding a
    group in one task.  The brackets of all groups, columns and ranks live in a table written to the shared folder.
    Each round meets it with the values, counts them by the next ``DIGIT`` bits behind what a bracket's values share --
    added up in every task, at most ``2**DIGIT`` counts per bracket -- and keeps the digit that holds the
    rank; six rounds suffice for any values.  Brackets of at most ``max_select`` rows are sorted, each
    inside one task.  Groups without a value in any of the columns are left out.
    """
    from sparkseries.session import materialized

    import pyarrow as pa

    keys = list(keys)
    names = [f"k{i}" for i in range(len(keys))]
    cols = list(dict.fromkeys(c for c, _, _ in wanted))
    x = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)],
                  *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    values = [f"v{i}" for i in range(len(cols))]
    key_fields = x.schema.fields[:len(keys)]

    def to_bits(batches):
        for batch in batches:
            out = [batch.column(n) for n in names]
            for v in (batch.column(c) for c in values):
                bits = _signed(v.to_numpy(zero_copy_only=False).astype(np.float64))
                out.append(pa.array(bits, mask=v.is_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays(out, names=names + values)

    d = x.mapInArrow(to_bits, T.StructType(key_fields + [T.StructField(c, T.LongType()) for c in values]))
    d = d.select(*names, F.posexplode(F.array(*values)).alias("c", "v")).where("v is not null")
    by = [*names, "c"]
    # one bracket per group and wanted rank (one or two for each quantile)
    targets = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(q)).alias("q"))
                                  for t, (c, q, _) in enumerate(wanted) if c == col]) for col in cols])
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    g = g.select("*", F.inline(F.get(targets, F.col("c")))).withColumn("h", (F.col("inside") - 1) * F.col("q"))
    ranks = F.array_distinct(F.array(F.floor("h").cast("long"), F.ceil("h").cast("long")))
    rest = ["t", "u", "r", "frac"]
    g = g.withColumn("frac", F.col("h") - F.floor("h")).select("*", F.posexplode(ranks).alias("u", "r"))
    g = materialized(g.select(*by, *rest, "lo", "hi", F.lit(0).cast("long").alias("below"), "inside"), "brackets")
    bracket = [*by, "lo", "hi", "below"]

    def back(found: DataFrame, act: DataFrame) -> DataFrame:
        """The rows of ``act`` with what was found in their brackets."""
        f = found.withColumnsRenamed({c: f"f_{c}" for c in bracket})
        return act.join(f, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in bracket]).drop(*[f"f_{c}" for c in bracket])

    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > max_select)
    while True:
        many, size = _table_size(g, by, wide)
        if not many:
            break
        act = g.where(wide)
        j = _values_in(d, act.select(*bracket).distinct(), by, size)
        hist = j.groupBy(*bracket, "digit").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        w = Window.partitionBy(*bracket).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("start", F.col("below") + F.coalesce(F.sum("n").over(w), F.lit(0))).drop("digit")
        step = back(hist, act).where((F.col("start") <= F.col("r")) & (F.col("r") < F.col("start") + F.col("n")))
        step = step.select(*by, *rest, F.col("least").alias("lo"), F.col("most").alias("hi"),
                           F.col("start").alias("below"), F.col("n").alias("inside"))
        g = materialized(g.where(~wide).unionByName(step), "brackets")
    # sort the few values left inside each bracket
    act = g.where("lo < hi")
    size = _table_size(g, by, F.col("lo") < F.col("hi"))[1]
    lists = _values_in(d, act.select(*bracket).distinct(), by, size).groupBy(*bracket).agg(F.sort_array(F.collect_list("v")).alias("s"))
    at = (F.col("r") - F.col("below") + 1).cast("int")
    found = back(lists, act).select(*names, *rest, F.element_at("s", at).alias("x"))
    found = found.unionByName(g.where("lo = hi").select(*names, *rest, F.col("lo").alias("x")))
    ends = found.groupBy(*names, "t").agg(F.first("frac").alias("frac"), F.min_by("x", "u").alias("a"), F.max_by("x", "u").alias("z"))

    def between(batches):
        for batch in batches:
            frac = batch.column("frac").to_numpy()
            a, z = (_doubles(batch.column(c).to_numpy()) for c in ("a", "z"))
            with np.errstate(all="ignore"):
                v = np.where((frac == 0) | (a == z), a, a + (z - a) * frac)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in [*names, "t"]], pa.array(v)], names=[*names, "t", "v"])

    done = ends.mapInArrow(between, T.StructType(key_fields + [T.StructField("t", T.IntegerType()), T.StructField("v", T.DoubleType())]))
    return done.groupBy(*[F.col(n).alias(k) for n, k in zip(names, keys)]).agg(
        *[F.max(F.when(F.col("t") == t, F.col("v"))).alias(out) for t, (_, _, out) in enumerate(wanted)])
