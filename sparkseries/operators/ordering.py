"""Ordered operators on one long series, without a single-task window.

``Window.orderBy(ts)`` with no partition key moves the whole table into one
task.  Instead every ordered operator here runs on *chunks*: contiguous
ranges of the order key ``(ts, *tie)``.  The bounds are cut from row counts per
key range (map-side partial counts; ranges with too many rows are counted
again in pieces), so chunks hold about the same number of rows even when the
data arrives in bursts, and the chunk of a row is a deterministic expression.
A timestamp that alone holds more than a chunk of rows, NULL included, is split
further along the tie columns and the row hash.

Each chunk is placed in its own partition (``Chunked.place``).  The patterns
built on the chunks:

* bounded row frames (rolling by rows, lag/lead, diff, limited fill):
  ``apply_row_frames``.  Rows whose frame may cross a chunk boundary are the
  first ``P`` / last ``Q`` rows of a chunk (longest look-back / look-ahead);
  only those are re-evaluated over the *edge set* (the first and last
  ``P + Q`` rows of every chunk), which is numbered, cut into blocks with a halo
  of ``P`` and ``Q`` rows, and unioned back.  The row data is shuffled once for
  each of the two parts; nothing is gathered in one task.
* bounded time frames (rolling by a time offset): ``apply_time_frames``.  A
  row is also sent to the following chunks whose first timestamps lie within
  the window after it (a halo), then every chunk evaluates its own rows.
  Only for aggregates without mergeable states; the others go through
  ``timeframes.merged_time_frames``, which copies no rows.
* unbounded fills (ffill/bfill/interpolate): ``apply_carry``.  Fill inside
  the chunk, then take from each chunk its last/first non-null values (one row
  per chunk), carry them across chunks on that tiny table and broadcast-join
  the carries (size bounded by the chunk count) back by chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseries.functions.columns import epoch_us, internal

KEY = internal("key")
CHUNK = internal("chunk")
DST = internal("dst")
HOME = internal("home")
RN = internal("rn")
CNT = internal("cnt")
IDX = internal("idx")
HASH = internal("hash")
PART = internal("part")
START = internal("start")
SPLITS = internal("splits")
POS = internal("pos")
BLOCK = internal("block")

SUB_BITS = 20
SUB_LAST = (1 << SUB_BITS) - 1

DEFAULT_ROWS_PER_CHUNK = 1_000_000
MIN_ROWS_PER_CHUNK = 1_000
# Key ranges counted at first (besides four per chunk), pieces of a range that holds too many rows.
GRID, PIECES = 4096, 64
# Rows of the edge set that one task evaluates (more if a frame is longer).
EDGE_BLOCK = 100_000
# Numbers (frames x window) that one call of a block function may have to hold.
BLOCK_CELLS = 4_000_000


@dataclass
class Chunked:
    """A frame with an order key and a chunk id per row."""

    df: DataFrame
    ts: str
    tie: tuple[str, ...]
    n_rows: int
    n_chunks: int
    bounds: list[int] = field(default_factory=list)  # distinct key bounds, ascending
    heavy: list[int] = field(default_factory=list)  # keys holding more than a chunk of rows
    n_split: int = 0  # further chunks that their rows are dealt to
    # slots[i]: a bigint whose Spark hash lands in partition i of n_chunks;
    # None when heavy timestamps were split into sub-chunks
    slots: list[int] | None = None
    n_nulls: int = 0  # rows whose key is NULL
    span: int = 0  # greatest key - least key

    @property
    def order(self) -> list[Column]:
        # the row hash makes the order total: rows that still tie are identical,
        # so recomputing a lost task (or the edge branch) cannot swap distinct rows
        return ([F.col(self.ts).asc_nulls_first()] + [F.col(t).asc_nulls_first() for t in self.tie]
                + [F.col(HASH)])

    @property
    def reverse_order(self) -> list[Column]:
        return ([F.col(self.ts).desc_nulls_last()] + [F.col(t).desc_nulls_last() for t in self.tie]
                + [F.col(HASH).desc()])

    def order_struct(self) -> Column:
        return F.struct(*[F.col(self.ts)] + [F.col(t) for t in self.tie] + [F.col(HASH)])

    def local_window(self, key: str = CHUNK) -> WindowSpec:
        return Window.partitionBy(key).orderBy(*self.order)

    def place(self, df: DataFrame, index: Column | None = None, by: str = CHUNK) -> tuple[DataFrame, str]:
        """Put chunk ``index`` (0..n_chunks-1) into partition ``index``: one chunk per task.

        Returns the frame and the column to partition windows by.  Hashing a
        few chunk ids would put two chunks into some tasks; instead each chunk
        gets a partition value whose hash is its own index.  An explicit
        repartition is never coalesced by AQE.  Without slots (sub-chunks of
        hot timestamps) a range repartition on the chunk id is used.
        """
        if self.n_chunks <= 1:
            return df, by
        if self.slots is None:
            return df.repartitionByRange(self.n_chunks + self.n_split, by), by
        if index is None:
            index = F.shiftright(F.col(CHUNK), SUB_BITS)
        # bigint like the ids the slots were hashed as (an int hashes differently)
        part = F.element_at(longs(self.slots), F.greatest(index, F.lit(0)).cast("int") + 1)
        return df.withColumn(PART, part).repartition(len(self.slots), PART), PART

    def user_columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__ss_")]


def _bsearch(col: Column, bounds: Sequence, lo: int = 0, hi: int | None = None) -> Column:
    """Number of ``bounds`` (ascending) that are <= col, as a balanced CASE tree."""
    if hi is None:
        hi = len(bounds)
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(col < F.lit(bounds[mid]), _bsearch(col, bounds, lo, mid)).otherwise(
        _bsearch(col, bounds, mid + 1, hi))


def bucket_of(key: Column, bounds: Sequence[int]) -> Column:
    """Chunk number of an order key: how many bounds are <= key."""
    if not bounds:
        return F.lit(0).cast("bigint")
    return _bsearch(key, bounds).cast("bigint")


def longs(values: Sequence[int]) -> Column:
    """A constant bigint array: one text literal, folded by the optimizer."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


# Above this many bounds the chunk search is a loop over a constant array instead
# of a CASE tree, whose code would grow with the bounds.
CASE_TREE_MAX = 1024


def with_buckets(df: DataFrame, outs: dict[str, Column], bounds: Sequence[int]) -> DataFrame:
    """Add ``outs[name]`` = how many ``bounds`` are <= the given key (NULL stays NULL).

    Both forms are a binary search on bigints: a balanced CASE tree inside
    whole-stage codegen up to ``CASE_TREE_MAX`` bounds, beyond it ``aggregate``
    over the step sizes, so the expression does not grow with the chunk count.
    """
    for name, key in outs.items():
        if len(bounds) <= CASE_TREE_MAX:
            df = df.withColumn(name, F.when(key.isNotNull(), bucket_of(key, bounds)))
            continue
        steps = longs([1 << i for i in reversed(range(len(bounds).bit_length()))])
        table, src = longs(bounds), internal("search")
        found = F.aggregate(steps, F.lit(0).cast("bigint"), lambda at, step: F.when(
            F.get(table, (at + step - 1).cast("int")) <= F.col(src), at + step).otherwise(at))
        df = df.withColumn(src, key).withColumn(name, F.when(F.col(src).isNotNull(), found)).drop(src)
    return df


def _target_chunks(spark, n_rows: int, rows_per_chunk: int | None) -> int:
    per = rows_per_chunk or DEFAULT_ROWS_PER_CHUNK
    n = math.ceil(n_rows / per)
    if rows_per_chunk is None:
        cores = spark.sparkContext.defaultParallelism
        # use every core on small inputs too, but keep chunks meaningful
        n = max(n, min(cores, n_rows // MIN_ROWS_PER_CHUNK))
        if cores < n < 8 * cores:
            # few chunks per core: a whole number of waves avoids a lone tail
            n = min(math.ceil(n / cores) * cores, max(1, n_rows // MIN_ROWS_PER_CHUNK))
    return int(max(1, n))


def _ranges(x: DataFrame, lo: int, hi: int, n_chunks: int, per: int) -> tuple[np.ndarray, np.ndarray]:
    """First keys and row counts of ascending key ranges; more than ``per`` rows are in single keys only.

    The driver holds one entry per counted range, a multiple of the chunk count.
    """
    def start(origin: Column, width: int) -> Column:
        # a start below the smallest bigint is that of the smallest key
        return F.coalesce(F.try_subtract(F.col(KEY), F.pmod(origin, F.lit(width))), F.lit(lo))

    width = (hi - lo) // (GRID + 4 * n_chunks) + 1
    d = x.select(KEY).where(F.col(KEY).isNotNull())
    d = d.withColumn(START, start(F.col(KEY), width))
    starts, counts = [], []
    while True:
        got = d.groupBy(START).agg(F.count(F.lit(1)).alias(CNT)).toPandas()
        at, n = got[START].to_numpy(np.int64), got[CNT].to_numpy(np.int64)
        again = (n > per) & (width > 1)
        starts.append(at[~again])
        counts.append(n[~again])
        if not again.any():
            break
        # ranges with more than a chunk of rows: fewer than there are chunks
        heavy = x.sparkSession.createDataFrame([(int(v),) for v in at[again]], f"{START} bigint")
        width = -(-width // PIECES)
        d = d.join(F.broadcast(heavy), START).withColumn(START, start(F.col(KEY) - F.col(START), width))
    starts, counts = np.concatenate(starts), np.concatenate(counts)
    order = np.argsort(starts)
    return starts[order], counts[order]


def _ordinal(df: DataFrame, name: str) -> Column | None:
    """A double that grows (not strictly) with the column in sort order; None for types without one."""
    t, c = df.schema[name].dataType, F.col(name)
    if isinstance(t, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return epoch_us(df, name).cast("double")
    if isinstance(t, (T.StringType, T.BinaryType)):
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return None


def _split_table(x: DataFrame, tie: Sequence[str], heavy: list, per: int, most: int) -> tuple[DataFrame, Column] | None:
    """For every heavy key, the first order column that varies in it (``level``) and the values that split
    its rows into chunks; and the sub-chunk of a row joined to that table.

    The quantiles have a fixed accuracy and are merged per key from partial sketches; the table has about
    as many values as chunks.
    """
    levels = []
    for name in [*tie, HASH]:
        o = _ordinal(x, name)
        if o is None:
            break
        levels.append((name, o))
    if not levels:
        return None
    keys = x.sparkSession.createDataFrame([(k,) for k in heavy], f"{KEY} bigint").withColumnRenamed(KEY, START)
    rows = x.join(F.broadcast(keys), F.col(KEY).eqNullSafe(F.col(START))).drop(START)
    probs = [i / most for i in range(1, most)]
    n = F.count(F.lit(1))
    varies = [(F.min(c) != F.max(c)) | (F.count(c).between(1, n - 1)) for c, _ in levels]
    quantiles = [F.percentile_approx(o, probs, max(10_000, 8 * most)) for _, o in levels]
    level, splits = F.lit(len(levels) - 1), quantiles[-1]
    for i in reversed(range(len(levels) - 1)):
        level, splits = F.when(varies[i], F.lit(i)).otherwise(level), F.when(varies[i], quantiles[i]).otherwise(splits)
    stride = F.greatest(F.lit(1), F.floor(F.lit(most * per) / n))
    got = rows.groupBy(KEY).agg(level.alias("level"), splits.alias("s"), stride.alias("stride"))
    got = got.select(F.col(KEY).alias(START), "level", F.array_distinct(F.filter(
        "s", lambda v, i: (i + 1) % F.col("stride") == 0)).alias(SPLITS))
    # collected, since a sketch merged again in another order could split elsewhere
    table = x.sparkSession.createDataFrame(got.collect(), got.schema).withColumnRenamed("level", internal("level"))
    at = F.lit(None).cast("double")
    for i, (_, o) in enumerate(levels):
        at = F.when(F.col(internal("level")) == i, o).otherwise(at)
    sub = F.when(F.col(SPLITS).isNotNull(), F.size(F.filter(SPLITS, lambda v: v <= at))).otherwise(F.lit(SUB_LAST))
    return table, sub


def chunk(df: DataFrame, ts: str, tie: Sequence[str] = (), *, rows_per_chunk: int | None = None,
          split_ties: bool = True) -> Chunked:
    """Assign every row a chunk id; chunks are contiguous in ``(ts, *tie)`` order.

    Two small jobs: counts and extremes of the key, then counts per key range
    (again for ranges with too many rows; and, only when one timestamp holds
    more than a chunk of rows, quantiles of the tie columns in it).
    """
    tie = tuple(tie)
    x = df.withColumn(KEY, epoch_us(df, ts)).withColumn(HASH, F.xxhash64(*[F.col(c) for c in df.columns]))
    n_rows, keyed, lo, hi = x.agg(F.count(F.lit(1)), F.count(KEY), F.min(KEY), F.max(KEY)).first()
    n_chunks = _target_chunks(df.sparkSession, n_rows, rows_per_chunk)
    if n_chunks <= 1:
        return Chunked(x.withColumn(CHUNK, F.lit(0).cast("bigint")), ts, tie, n_rows, 1, [],
                       n_nulls=n_rows - keyed, span=hi - lo if keyed else 0)
    per = math.ceil(n_rows / n_chunks)
    bounds, heavy, most, extra = [], [], 1, 0
    if keyed:
        starts, counts = _ranges(x, lo, hi, n_chunks, per)
        large = counts > per
        # a range belongs to the chunk of its middle row; a heavy key has a chunk to itself
        index = ((np.cumsum(counts) - counts / 2) / per).astype(np.int64)
        cut = (np.diff(index) > 0) | large[1:] | large[:-1]
        bounds = [int(v) for v in starts[1:][cut]]
        heavy = [int(v) for v in starts[large]]
        if heavy:
            most, extra = math.ceil(counts[large].max() / per), int((counts[large] // per).sum())
    nulls = n_rows - keyed
    hot = heavy + ([None] if nulls > per else [])
    most, extra = max(most, math.ceil(nulls / per)), extra + nulls // per
    split = _split_table(x, tie, hot, per, most) if split_ties and hot else None
    n = len(bounds) + 1
    base = internal("base")
    if split is None:  # NULL sorts first: it is part of the first chunk
        x = with_buckets(x, {base: F.col(KEY)}, bounds)
        cid = F.coalesce(F.col(base), F.lit(0)).cast("bigint") * F.lit(1 << SUB_BITS) + F.lit(SUB_LAST)
        return Chunked(x.withColumn(CHUNK, cid).drop(base), ts, tie, n_rows, n, bounds, heavy,
                       slots=_slots(df.sparkSession, n), n_nulls=nulls, span=hi - lo if keyed else 0)
    table, sub = split
    x = x.join(F.broadcast(table), F.col(KEY).eqNullSafe(F.col(START)), "left")
    x = with_buckets(x, {base: F.col(KEY)}, bounds)
    cid = F.coalesce(F.col(base), F.lit(-1)).cast("bigint") * F.lit(1 << SUB_BITS) + sub
    x = x.withColumn(CHUNK, cid).drop(base, START, SPLITS, internal("level"))
    return Chunked(x, ts, tie, n_rows, n, bounds, heavy, extra)


def _slots(spark, n: int) -> list[int] | None:
    """For each partition index i < n, a bigint whose Spark hash lands in partition i."""
    rows = (spark.range(0, 64 * n).select("id", F.pmod(F.hash(F.col("id")), F.lit(n)).alias("p"))
            .groupBy("p").agg(F.min("id").alias("v")).collect())
    got = {r["p"]: r["v"] for r in rows}
    return [got[i] for i in range(n)] if len(got) == n else None


# --------------------------------------------------------------------------
# bounded row frames


@dataclass
class RowOutput:
    """One output column: ``fn(window)`` over a row frame looking back ``pre``
    rows and ahead ``post`` rows (at most)."""

    name: str
    fn: Callable[[WindowSpec], Column]
    pre: int = 0
    post: int = 0


def _block_values(d: DataFrame, segment: str, columns: dict[str, str], n: int, fn: Callable) -> DataFrame:
    """``d``, whose partitions hold whole segments in order, plus for every (column, output) of ``columns`` the value of
    ``fn`` over the last ``n`` rows of the segment: NULL where there are fewer, or one of them is NULL."""
    schema = T.StructType([*d.schema.fields, *[T.StructField(o, T.DoubleType()) for o in columns.values()]])

    def run(batches):
        import pyarrow as pa

        at = np.empty(0, np.int64)  # the last n - 1 rows of the batches before: their segments, values and NULLs
        tails = {s: (np.empty(0), np.empty(0, bool)) for s in columns}
        for b in batches:
            seg = b.column(b.schema.get_field_index(segment)).cast(pa.int64()).to_numpy(zero_copy_only=False)
            seg = np.concatenate([at, seg])
            full = np.arange(len(at), len(seg))
            full = full[full >= n - 1]
            full = full[seg[full - n + 1] == seg[full]]
            outs = []
            for s in columns:
                col = b.column(b.schema.get_field_index(s))
                v = np.concatenate([tails[s][0], col.cast(pa.float64()).to_numpy(zero_copy_only=False)])
                null = np.concatenate([tails[s][1], col.is_null().to_numpy(zero_copy_only=False)])
                before = np.concatenate([[0], np.cumsum(null)])
                good = full[before[full + 1] == before[full - n + 1]]
                got = np.full(len(seg), np.nan)
                step = max(1, BLOCK_CELLS // n)
                for i in range(0, len(good), step):
                    part = good[i:i + step]
                    first = part[0] - n + 1
                    frames = np.lib.stride_tricks.sliding_window_view(v[first:part[-1] + 1], n)
                    got[part] = fn(frames[part - n + 1 - first] if len(frames) > len(part) else frames)
                known = np.zeros(len(seg), bool)
                known[good] = True
                outs.append(pa.array(got[len(at):], pa.float64(), mask=~known[len(at):]))
                tails[s] = v[len(v) - min(n - 1, len(v)):], null[len(v) - min(n - 1, len(v)):]
            at = seg[len(seg) - min(n - 1, len(seg)):]
            yield pa.RecordBatch.from_arrays([*b.columns, *outs], names=[*b.schema.names, *columns.values()])

    return d.mapInArrow(run, schema)


def apply_block_frames(c: Chunked, columns: Sequence[str], n: int, fn: Callable, keep: Sequence[str]) -> DataFrame:
    """``fn`` over the last ``n`` rows of every row, for many frames per call (:class:`block_agg`).

    Chunks stream through their tasks as Arrow batches; a task keeps the last ``n - 1`` rows of a batch for the next and
    looks at all frames through one strided view.  The first ``n - 1`` rows of a chunk are evaluated over
    the edge rows, as in :func:`apply_row_frames`.
    """
    outs = {s: internal(f"out_{i}") for i, s in enumerate(columns)}

    def evaluate(d: DataFrame, w: WindowSpec, segment: str, order: Sequence[Column]) -> DataFrame:
        return _block_values(d.sortWithinPartitions(segment, *order), segment, outs, n, fn)

    return apply_row_frames(c, [RowOutput(s, None, pre=n - 1) for s in columns], keep, evaluate)


def apply_row_frames(c: Chunked, outputs: Sequence[RowOutput], keep: Sequence[str],
                     evaluate: Callable | None = None) -> DataFrame:
    """Evaluate row-frame outputs per chunk and fix up rows near chunk edges.

    With ``P`` = the longest look-back and ``Q`` = the longest look-ahead, a
    row whose frame may leave its chunk is one of the first ``P`` or last
    ``Q`` rows of the chunk (the *zone*).  The *edge set* -- the first and
    last ``P + Q`` rows of every chunk -- contains every zone row's whole
    frame, also across small chunks, so evaluating the outputs over the edge
    set in global order is exact for zone rows.  Rows outside the zone keep
    their chunk-local values.  Edge rows are numbered through their chunks'
    counts and evaluated in blocks of at least ``P + Q`` numbers; the last ``P``
    and first ``Q`` rows of a block are copied to its neighbours.  ``evaluate(d, window, segment, order)`` may
    stand in for the outputs' window functions.
    """
    x, key = c.place(c.df)
    wl = c.local_window(key)
    x = x.withColumn(RN, F.row_number().over(wl)).withColumn(CNT, F.count(F.lit(1)).over(Window.partitionBy(key)))
    src = c.user_columns()
    order_out = list(keep) + [o.name for o in outputs if o.name not in keep]
    tmp = {o.name: internal("out_" + str(i)) for i, o in enumerate(outputs)}

    def by_window(d: DataFrame, w: WindowSpec, segment: str, order: Sequence[Column]) -> DataFrame:
        more = [k for k in (HOME, BLOCK) if k in d.columns]
        return d.select(*src, RN, CNT, *more, *[o.fn(w).alias(tmp[o.name]) for o in outputs])

    evaluate = evaluate or by_window

    def project(d: DataFrame) -> DataFrame:
        cols = {o.name: F.col(tmp[o.name]).alias(o.name) for o in outputs}
        return d.select(*[cols.get(k, F.col(k)) for k in order_out])

    pre = max([o.pre for o in outputs] + [0])
    post = max([o.post for o in outputs] + [0])
    if c.n_chunks <= 1 or pre + post == 0:
        return project(evaluate(x, wl, key, c.order))
    zone = (F.col(RN) <= pre) | (F.col(RN) > F.col(CNT) - post)
    reach = pre + post
    edge = x.filter((F.col(RN) <= reach) | (F.col(RN) > F.col(CNT) - reach))
    # one row per chunk: the broadcast is bounded by the chunk count
    kept = c.df.groupBy(CHUNK).agg(F.least(F.count(F.lit(1)), F.lit(2 * reach)).alias(CNT))
    earlier = F.sum(CNT).over(Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.join(F.broadcast(kept.select(CHUNK, earlier.alias("__ss_off"))), CHUNK, "left")
    left_out = F.when(F.col(RN) > reach, F.greatest(F.lit(0), F.col(CNT) - 2 * reach)).otherwise(0)
    edge = edge.withColumn(POS, F.coalesce("__ss_off", F.lit(0)) + F.col(RN) - 1 - left_out)
    size = max(EDGE_BLOCK, reach)
    home, at = F.floor(F.col(POS) / size), F.col(POS) % size
    edge = edge.withColumn(HOME, home).withColumn(BLOCK, F.explode(F.sequence(
        home - (at < post).cast("bigint"), home + (at >= size - pre).cast("bigint"))))
    wg = Window.partitionBy(BLOCK).orderBy(POS)
    inner = project(evaluate(x, wl, key, c.order).filter(~zone))
    if evaluate is not by_window:  # a window brings the rows of a block together by itself
        edge = edge.repartition(BLOCK)
    fixed = evaluate(edge, wg, BLOCK, [F.col(POS)])
    return inner.unionByName(project(fixed.filter(zone & (F.col(BLOCK) == F.col(HOME)))))


# --------------------------------------------------------------------------
# bounded time frames


def apply_time_frames(c: Chunked, outputs: dict[str, Callable[[WindowSpec], Column]],
                      width_us: int, keep: Sequence[str]) -> DataFrame:
    """Evaluate outputs over the frame ``(t - width, t]`` of every row."""
    # time frames use the plain key bounds: rows sharing a timestamp stay together
    key = DST
    if c.n_chunks <= 1:
        x = c.df.withColumn(HOME, F.lit(0).cast("bigint")).withColumn(DST, F.col(HOME))
    else:
        # a row is inside the frames of rows up to width-1 µs later: copy it to
        # every chunk that starts within that span
        x = _home_and_reach(c, c.df, width_us)
        x, key = c.place(x, F.col(DST), by=DST)
    w = Window.partitionBy(key).orderBy(F.col(KEY)).rangeBetween(-(width_us - 1), 0)
    tmp = {k: internal("out_" + str(i)) for i, k in enumerate(outputs)}
    y = x.select(*[F.col(k) for k in c.user_columns()], HOME, DST,
                 *[fn(w).alias(tmp[k]) for k, fn in outputs.items()])
    y = y.filter(F.col(DST) == F.col(HOME))
    order_out = list(keep) + [k for k in outputs if k not in keep]
    return y.select(*[F.col(tmp[k]).alias(k) if k in tmp else F.col(k) for k in order_out])


def _home_and_reach(c: Chunked, df: DataFrame, width_us: int) -> DataFrame:
    """``HOME`` = chunk of the key; one row per ``DST`` chunk the key's frames reach."""
    last = internal("last")
    x = with_buckets(df, {HOME: F.col(KEY), last: F.col(KEY) + F.lit(width_us - 1)}, c.bounds)
    x = x.withColumn(HOME, F.coalesce(F.col(HOME), F.lit(-1).cast("bigint")))
    reach = F.greatest(F.col(HOME), F.coalesce(F.col(last), F.col(HOME)))
    return x.withColumn(DST, F.explode(F.sequence(F.col(HOME), reach))).drop(last)


# --------------------------------------------------------------------------
# unbounded carries (ffill / bfill / interpolate)


def with_row_index(c: Chunked) -> tuple[DataFrame, str]:
    """``c.df`` placed one chunk per task, plus ``IDX``: the 0-based global
    position in ``(ts, *tie)`` order.  Returns the frame and its window key.

    Positions come from per-chunk counts (one row per chunk, prefix-summed on
    that tiny table and broadcast) plus the row number inside the chunk.
    """
    counts = c.df.groupBy(CHUNK).agg(F.count(F.lit(1)).alias(CNT))
    offsets = counts.select(
        CHUNK, (F.sum(CNT).over(Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)))
        .alias("__ss_off"))
    placed, key = c.place(c.df.join(F.broadcast(offsets), CHUNK, "left"))
    rn = F.row_number().over(c.local_window(key))
    return placed.withColumn(IDX, F.coalesce(F.col("__ss_off"), F.lit(0)) + rn - 1).drop("__ss_off"), key


def apply_carry(c: Chunked, df: DataFrame, forward: dict[str, Column], backward: dict[str, Column],
                combine: Callable[[dict[str, Column], dict[str, Column]], list[Column]],
                placed_by: str | None = None) -> DataFrame:
    """Chunk-local running values completed with carries from other chunks.

    ``forward[name]`` is an expression whose last non-null value up to the
    current row is wanted; ``backward[name]`` one whose first non-null value
    from the current row on is wanted.  ``combine(prev, next)`` builds the
    output columns from the completed running values.
    """
    # ``placed_by``: df is already placed one chunk per task (with_row_index)
    placed, key = (df, placed_by) if placed_by else c.place(df)
    fwd_w = c.local_window(key).rowsBetween(Window.unboundedPreceding, 0)
    # "first non-null from here on" as a growing frame over the reversed order:
    # Spark re-aggregates an unbounded-following frame for every row (O(n^2)),
    # a growing frame incrementally (O(n))
    bwd_w = Window.partitionBy(key).orderBy(*c.reverse_order).rowsBetween(Window.unboundedPreceding, 0)
    loc = {f"__ss_p{i}": F.last(e, ignorenulls=True).over(fwd_w) for i, e in enumerate(forward.values())}
    loc.update({f"__ss_n{i}": F.last(e, ignorenulls=True).over(bwd_w) for i, e in enumerate(backward.values())})
    y = placed.select("*", *[v.alias(k) for k, v in loc.items()])
    pnames = {name: f"__ss_p{i}" for i, name in enumerate(forward)}
    nnames = {name: f"__ss_n{i}" for i, name in enumerate(backward)}
    if c.n_chunks > 1:
        # per chunk: last non-null of each forward expr, first non-null of each
        # backward expr -> one row per chunk
        order_key = c.order_struct()
        aggs = [F.max_by(e, F.when(e.isNotNull(), order_key)).alias(pnames[k]) for k, e in forward.items()]
        aggs += [F.min_by(e, F.when(e.isNotNull(), order_key)).alias(nnames[k]) for k, e in backward.items()]
        per_chunk = df.groupBy(CHUNK).agg(*aggs)
        before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        after = Window.orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)
        carries = per_chunk.select(
            CHUNK,
            *[F.last(pnames[k], ignorenulls=True).over(before).alias("__ss_cp_" + pnames[k]) for k in forward],
            *[F.first(nnames[k], ignorenulls=True).over(after).alias("__ss_cn_" + nnames[k]) for k in backward])
        # one row per chunk: the broadcast side is bounded by the chunk count
        y = y.join(F.broadcast(carries), CHUNK, "left")
        for k in forward:
            y = y.withColumn(pnames[k], F.coalesce(F.col(pnames[k]), F.col("__ss_cp_" + pnames[k])))
        for k in backward:
            y = y.withColumn(nnames[k], F.coalesce(F.col(nnames[k]), F.col("__ss_cn_" + nnames[k])))
    prev = {k: F.col(v) for k, v in pnames.items()}
    nxt = {k: F.col(v) for k, v in nnames.items()}
    return y.select(*combine(prev, nxt))
