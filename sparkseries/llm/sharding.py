"""Reproducible shuffle and sharding by a Feistel permutation over global row numbers.

Every row gets a global number that depends only on the rows themselves; a keyed permutation of
``0 .. n-1`` moves it to a place; the place gives the shard (``place mod shards``) and the slot in
the shard (``place div shards``).  Shard sizes differ by at most one and slots have no gaps.  The
permutation can be evaluated for one number at a time, in both directions, so a reader can compute
which row stands in any (shard, slot) without a lookup table.

Cases: null text counts as empty; rows that are equal in id and text are interchangeable; null ids
are numbered like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
BUCKETS = 4096


class Feistel:
    """Keyed permutation of 0 .. n-1: a balanced Feistel network over the next even power of two,
    walked along its cycle until the value is below ``n`` again."""

    def __init__(self, n: int, key: int = 0, rounds: int = ROUNDS):
        self.n = max(1, n)
        self.half = np.uint64(max(1, ((self.n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        # round keys: the splitmix sequence started at the key
        self.keys = [np.uint64(((key + 1) * 0x9E3779B97F4A7C15 * (i + 1)) & (2**64 - 1)) for i in range(rounds)]

    @staticmethod
    def _round(x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))

    def _pass(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (self._round(right, k) & self.mask)
        # halves swapped, so that the same pass with reversed keys undoes it
        return (right << self.half) | left

    def _walk(self, x, keys) -> np.ndarray:
        y = self._pass(np.atleast_1d(np.asarray(x, np.uint64)), keys)
        out = np.flatnonzero(y >= self.n)
        while len(out):
            y[out] = self._pass(y[out], keys)
            out = out[y[out] >= self.n]
        return y.astype(np.int64)

    def place(self, row) -> np.ndarray:
        return self._walk(row, self.keys)

    def row(self, place) -> np.ndarray:
        return self._walk(place, self.keys[::-1])


def row_numbers(df: DataFrame, order: list[str], out: str = "row", buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Global numbers 0 .. n-1, and n.  Rows are dealt to ``buckets`` by a hash of ``order`` and
    numbered inside each; bucket offsets come from one row per bucket.  No sampling is involved, so
    a recomputed task gives every row the same number again."""
    x = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = x.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `buckets` rows
    before, n = {}, 0
    for r in sorted(sizes, key=lambda r: r["__b"]):
        before[r["__b"]] = n
        n += r["n"]
    start = F.element_at(F.lit(np.array([before.get(b, 0) for b in range(buckets)], np.int64)), F.col("__b") + 1)
    w = Window.partitionBy("__b").orderBy(*order)
    return x.withColumn(out, F.row_number().over(w).cast("long") - 1 + start).drop("__b"), n


def assign_shards(df: DataFrame, order: list[str], shards: int, key: int = 0) -> DataFrame:
    """Adds ``row``, ``shard`` and ``slot`` under the law that row counts differ by at most one."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    numbered, n = row_numbers(df, order)
    net = Feistel(n, key)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(net.place(row.to_numpy()))

    return (numbered.withColumn("__place", place("row"))
            .withColumn("shard", F.pmod("__place", F.lit(shards)).cast("int"))
            .withColumn("slot", F.expr(f"__place div {shards}"))
            .drop("__place"))


def shard_documents(docs: DataFrame, shards: int = 16, key: int = 0) -> DataFrame:
    """Shard, slot, size and checksum of every document; only these narrow columns are shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
                         F.xxhash64(text).alias("__text"))
    out = assign_shards(narrow, ["doc_id", "text_crc32", "size", "__text"], shards, key)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "row")
