"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to blocks: each goes to the nearest of at most ``PIVOTS`` pivots (a bounded sample by hash),
and a pivot's vectors are split further by hash into blocks of about ``BLOCK`` rows, so a common vector or a
dense region is no hot block.  In every block a task builds a cover tree: a node has a centre and a covering
radius; its children are centred at points more than half that radius apart (at most ``FANOUT`` of them; points beyond
go to the nearest, whose radius grows accordingly).  The queries are dealt to groups of about ``GROUP``, and each
group builds a tree of its own.  Query tree and block tree are walked together: a pair of nodes is left out if

    q·c + |q| r_c + |c| r_q + r_q r_c  <  the worst k-th score among the queries of the node,

an upper bound on any inner product between the two.  The first k-th scores come from the pivots, which are
candidates themselves; the trees of a block that no query of a group needs are not built.  Only strictly smaller
bounds prune (with slack for rounding), so results are exact, ties included.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
shorter vectors are read as padded with zeros; equal scores go to the smaller id; rows with the query's
own id are not its candidates; an id is one query and one candidate, however many rows have it: the score of two ids
is the largest of any of their rows, and ranks hold distinct ids; fewer candidates than k give fewer rows; scores are exact integers within
64 bits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseries.llm.tables import arrow_map, written

PIVOTS = 256
BLOCK, GROUP = 8192, 2048
LEAF, FANOUT = 128, 32


class CoverTree:
    """Nodes as arrays: centre, radius, first and last point of the reordered points, children."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.center, self.radius, self.span, self.children = [], [], [], []
        self.x = x
        if len(x):
            self._node(x.mean(axis=0), 0, len(x), leaf)
        self.x = x[self.order]

    def _node(self, center: np.ndarray, lo: int, hi: int, leaf: int) -> int:
        rows = self.order[lo:hi]
        dist = np.sqrt(((self.x[rows] - center) ** 2).sum(axis=1))
        me = len(self.center)
        radius = float(dist.max())
        self.center.append(center)
        self.radius.append(radius)
        self.span.append((lo, hi))
        self.children.append([])
        if hi - lo <= leaf or radius == 0:
            return me
        pts = self.x[rows]
        near = np.full(len(rows), np.inf)
        home = np.zeros(len(rows), np.int64)
        centers = []
        nxt = int(np.argmin(dist))
        while len(centers) < FANOUT:
            centers.append(pts[nxt])
            d = np.sqrt(((pts - pts[nxt]) ** 2).sum(axis=1))
            closer = d < near
            near[closer], home[closer] = d[closer], len(centers) - 1
            nxt = int(np.argmax(near))
            if near[nxt] <= radius / 2:
                break
        by = np.argsort(home, kind="stable")
        self.order[lo:hi] = rows[by]
        cut = lo + np.searchsorted(home[by], np.arange(len(centers) + 1))
        for c, a, b in zip(centers, cut[:-1], cut[1:]):
            if b > a:
                self.children[me].append(self._node(c, int(a), int(b), leaf))
        return me


class Search:
    """Best k candidates of a group of queries, over any number of blocks."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, worst: np.ndarray, k: int):
        self.tree = CoverTree(x, 64)
        o = self.tree.order
        self.ids, self.k, self.exact = ids[o], k, x[o].astype(np.int64)
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = worst[o].astype(float)  # known lower bound of each k-th score
        self.center = np.array(self.tree.center)
        self.norm = np.sqrt((self.center ** 2).sum(axis=1))

    def block(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(x) or not len(self.ids):
            return
        mean = x.mean(axis=0)
        reach = float(np.sqrt(((x - mean) ** 2).sum(axis=1)).max())
        top = self.center[0] @ mean + self.norm[0] * reach + np.sqrt(mean @ mean) * self.tree.radius[0] + self.tree.radius[0] * reach
        if top + 1e-9 * abs(top) + 1e-3 < self.floor.min():
            return
        tree = CoverTree(x)
        cand, exact = ids[tree.order], x[tree.order].astype(np.int64)
        repeats = len(np.unique(ids)) < len(ids)
        big = float(np.abs(x).max(initial=0)) * float(np.abs(self.exact).max(initial=0)) * x.shape[1] >= 2**53
        center = np.array(tree.center)
        norm = np.sqrt((center ** 2).sum(axis=1))
        radius, qr = np.array(tree.radius), np.array(self.tree.radius)
        stack = [(0, 0)]
        while stack:
            q, c = stack.pop()
            lo, hi = self.tree.span[q]
            need = float(self.floor[lo:hi].min())
            top = float(self.center[q] @ center[c]) + self.norm[q] * radius[c] + norm[c] * qr[q] + qr[q] * radius[c]
            if top + 1e-9 * abs(top) + 1e-3 < need:
                continue
            kids_q, kids_c = self.tree.children[q], tree.children[c]
            if not kids_q and not kids_c:
                a, b = tree.span[c]
                self._base(lo, hi, cand[a:b], exact[a:b] if big else tree.x[a:b], big, repeats)
            elif kids_c and (not kids_q or radius[c] >= qr[q]):
                order = np.argsort(center[kids_c] @ self.center[q])  # the most promising is popped first
                stack += [(q, kids_c[i]) for i in order]
            else:
                stack += [(k, c) for k in kids_q]

    def _base(self, lo: int, hi: int, ids: np.ndarray, x: np.ndarray, big: bool, repeats: bool) -> None:
        q = self.exact[lo:hi]
        s = (q @ x.T) if big else (q.astype(float) @ x.T).astype(np.int64)
        s = np.where(ids[None, :] == self.ids[lo:hi, None], np.iinfo(np.int64).min, s)
        rows = np.flatnonzero((s >= self.floor[lo:hi, None]).any(axis=1))
        if not len(rows):
            return
        score = np.concatenate([self.score[lo:hi][rows], s[rows]], axis=1)
        found = np.concatenate([self.found[lo:hi][rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        found = np.where(score == np.iinfo(np.int64).min, np.iinfo(np.int64).max, found)
        if repeats:  # of each id only the largest score stays
            by = np.lexsort((~score, found), axis=1)
            score, found = np.take_along_axis(score, by, 1), np.take_along_axis(found, by, 1)
            again = np.zeros(found.shape, bool)
            again[:, 1:] = found[:, 1:] == found[:, :-1]
            score[again], found[again] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        best = np.lexsort((found, ~score), axis=1)[:, :self.k]  # ~ reverses the order without overflow
        self.score[lo + rows] = np.take_along_axis(score, best, 1)
        self.found[lo + rows] = np.take_along_axis(found, best, 1)
        self.floor[lo + rows] = np.maximum(self.floor[lo + rows], self.score[lo + rows, -1].astype(float))

    def rows(self):
        ok = self.found != np.iinfo(np.int64).max
        q = np.broadcast_to(self.ids[:, None], ok.shape)
        return q[ok], self.found[ok], self.score[ok]


def quantised(vectors: DataFrame, factor: float = 256.0) -> DataFrame:
    """(vec_id, v): integer components of the vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    x = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
    x = x.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("e"))
    return x.where(F.forall("e", finite)).select("vec_id", F.transform("e", lambda c: F.floor(c * F.lit(factor)).cast("long")).alias("v"))


def _matrix(col, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros."""
    size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def top_k(vectors: DataFrame, is_query, k: int = 5, factor: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for every row where ``is_query`` holds."""
    x = quantised(vectors, factor)
    s = x.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = s["n"], max(1, s["dim"] or 1)
    pivots = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()  # bounded
    pivots = list({r["vec_id"]: r for r in pivots}.values())  # a repeated id must not lift the bounds
    pid = np.array([r["vec_id"] for r in pivots], np.int64)
    pv = np.zeros((len(pivots), dim))
    for i, r in enumerate(pivots):
        pv[i, :len(r["v"])] = r["v"]

    def assign():
        half = (pv ** 2).sum(axis=1) / 2

        def run(batch):
            m = _matrix(batch.column(1), dim)
            score = m @ pv.T
            ids = batch.column(0).to_numpy()
            own = ids[:, None] == pid[None, :]
            known = np.sort(np.where(own, -np.inf, score), axis=1)
            # rounding must not lift a bound: it is taken a little lower
            worst = known[:, -k] - 1e-9 * np.abs(known[:, -k]) - 1 if known.shape[1] >= k else np.full(len(m), -np.inf)
            yield {"vec_id": ids, "v": list(m.astype(np.int64)), "query": batch.column(2).to_pylist(),
                   "pivot": np.argmax(score - half, axis=1), "worst": worst}

        return run

    rows = x.withColumn("query", F.coalesce(is_query, F.lit(False)))
    placed = written(arrow_map(rows, assign, "vec_id long, v array<long>, query boolean, pivot int, worst double"), "placed")
    per = {r["pivot"]: (r["n"], r["q"]) for r in placed.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("query").cast("int")).alias("q")).collect()}  # one row per pivot
    salts = F.element_at(F.lit([max(1, math.ceil(per.get(p, (0, 0))[0] / BLOCK)) for p in range(max(1, len(pid)))]), F.col("pivot") + 1)
    blocks = placed.withColumn("block", F.concat_ws("-", "pivot", F.pmod(F.xxhash64("vec_id"), salts)))
    groups = max(1, math.ceil(sum(q for _, q in per.values()) / GROUP))
    queries = placed.where("query").withColumn("grp", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(groups)).cast("int"))
    return _searched(blocks, queries, groups, dim, k)


def _searched(blocks: DataFrame, queries: DataFrame, groups: int, dim: int, k: int) -> DataFrame:
    packed_q = written(queries.groupBy("grp").agg(F.collect_list(F.struct("vec_id", "v", "worst")).alias("qs")), "queries")
    packed_b = blocks.groupBy("block").agg(F.collect_list(F.struct("vec_id", "v")).alias("cs"))
    # every query group meets every block, in blocks; the trees decide what is compared
    pairs = packed_b.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(packed_q, "grp")

    def make():
        def run(batch):
            for i in range(batch.num_rows):
                qs, cs = batch.column(0)[i].values, batch.column(1)[i].values
                search = Search(qs.field("vec_id").to_numpy(), _matrix(qs.field("v"), dim), qs.field("worst").to_numpy(), k)
                search.block(cs.field("vec_id").to_numpy(), _matrix(cs.field("v"), dim))
                a, b, c = search.rows()
                yield {"query_id": a, "vec_id": b, "score": c}

        return run

    found = arrow_map(pairs.select("qs", "cs"), make, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
