"""Ranked lexical search: document FP-trees searched depth first, branch and bound for every item.

Terms, weights and scores are integers: ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` summed over an item's terms, where
``w`` falls with the document frequency and ``m`` grows with the document's length.

1. *Statistics.*  One pass counts documents, terms and the document frequency of the items' terms, added up inside every task.
2. *Trees.*  A task keeps blocks of at most ``BLOCK`` documents (``BLOCK_TERMS`` words).  A document is restricted to
   the items' terms, put in frequency order (rarest first), and the blocks' vectors are laid into a trie: documents with
   the same rarest terms share a path.  Paths without branches are one node; subtrees of fewer than ``LEAF`` documents are
   joined with their neighbours.  A node keeps the largest tf of every term, the least m and the least id below it.
3. *Search.*  For every item the tree is walked depth first, best child first.  What a subtree could score at most
   follows from its maxima and its least m; a subtree that cannot pass the item's worst kept score (at an equal score: with a
   smaller id) is cut off.  Documents below the other leaves are scored exactly.  The kept results go on to the task's
   next block, so the bound rises.  Every task returns at most ``k`` rows for each item, ranked in Spark.

Items are sent with the tasks, so a benchmark of more than ``PART_BYTES`` of text is searched in several parts.

Cases: null and empty texts have no terms and are never found; items without known terms have no results; terms that an item
repeats count as often; a repeated item has results for each of its rows; a repeated document row is a document of its own; null ids
come last among equal scores; an empty table gives no rows; texts are read whole; other columns are ignored.  Terms are told apart by
64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseries.llm.tables import arrow_map
from sparkseries.llm.text import WholeHasher, pieces

K = 10
BLOCK, BLOCK_TERMS, LEAF = 8192, 4_000_000, 16
PART_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max  # null ids

# Fixed values of the score: scale of tf, its share of length, length normalisation in hundredths.
SCALE, TF, LENGTH, FLAT = 1_000_000_000, 1000, 8, 75


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 8 * m); grows with tf and falls with m."""
    return (SCALE * tf) // (TF * tf + LENGTH * m)


class Items:
    """A bounded set of items: the sorted hashes of their terms, and every item's terms with repeats."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids = ids
        self.hashes = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.of = []
        for w in words:
            t, n = np.unique(np.searchsorted(self.hashes, w), return_counts=True)
            self.of.append((t, n))

    def weighted(self, documents: int, terms: int, df: np.ndarray) -> "Weights":
        return Weights(self, documents, terms, df)


class Weights:
    """Items with the corpus statistics: terms are numbered in frequency order, rarest first."""

    def __init__(self, items: Items, documents: int, terms: int, df: np.ndarray):
        self.ids, self.documents, self.terms = items.ids, documents, terms
        order = np.argsort(df, kind="stable")
        self.rank = np.empty(len(df), np.int64)
        self.rank[order] = np.arange(len(df))
        self.hashes = items.hashes
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        # a rank and a weight (with repeats) for every term of an item that some document holds
        self.of = [(self.rank[t[df[t] > 0]], (weight[t] * n)[df[t] > 0]) for t, n in items.of]

    def m(self, n: np.ndarray) -> np.ndarray:
        return 100 - FLAT + (FLAT * n * self.documents) // max(1, self.terms)


def item_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES):
    """Yield Items of bounded size, in a fixed order."""
    x = benchmark.select("item_id", "text")
    size = x.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    hasher = WholeHasher()
    for k in range(parts):
        rows = x.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # about part_bytes
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        h, first = hasher.words([(r["text"] or "").encode("utf-8", "replace") for r in rows])
        yield Items([r["item_id"] for r in rows], list(np.split(h, first[1:-1])) if rows else [])


def statistics(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, document frequency of every item term): sums of one row per task and term."""

    def make():
        hasher, total = WholeHasher(), np.zeros(len(items.hashes) + 2, np.int64)

        def run(batch):
            if batch is None:
                at = np.flatnonzero(total)
                yield {"term": at - 2, "n": total[at]}
                return
            for _, texts in pieces(batch.column(0).to_pylist()):
                h, first = hasher.words(texts)
                n = np.diff(first)
                total[0] += np.count_nonzero(n)
                total[1] += len(h)
                doc, term, _ = restricted(h, first, items.hashes)
                total[2:] += np.bincount(term, minlength=len(items.hashes))

        return run

    got = arrow_map(docs.select("text"), make, "term int, n long", last=True).groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(items.hashes) + 2, np.int64)
    for r in got:  # one row for each term of a bounded part
        total[r["term"] + 2] = r["n"]
    return int(total[0]), int(total[1]), total[2:]


def restricted(h: np.ndarray, first: np.ndarray, known: np.ndarray, rank: np.ndarray | None = None):
    """(document, term, tf) of the known terms, sorted by document and term (by the term's rank, if given)."""
    if not len(known) or not len(h):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = np.flatnonzero(known[at] == h)
    doc = np.searchsorted(first, hit, "right") - 1
    term = at[hit] if rank is None else rank[at[hit]]
    key, tf = np.unique(doc * len(known) + term, return_counts=True)
    return key // len(known), key % len(known), tf


class Tree:
    """The FP-tree of a block: documents in path order, nodes with subtree maxima and minima."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, vocabulary: int,
                 leaf: int = LEAF):
        self.vocabulary = vocabulary
        start = np.searchsorted(doc, np.arange(len(ids) + 1))
        paths = [term[a:b].astype(">u4").tobytes() for a, b in zip(start[:-1], start[1:])]
        order = sorted(range(len(ids)), key=paths.__getitem__)
        self.ids, self.m = ids[order], m[order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        by = np.argsort(place[doc], kind="stable")  # entries in path order; terms stay in frequency order
        self.doc, self.term, self.tf = place[doc][by], term[by], tf[by]
        self.keys = self.doc * vocabulary + self.term
        self.first = np.searchsorted(self.doc, np.arange(len(ids) + 1))
        shared = self._shared()
        self.low, self.high, self.parent = self._nodes(shared, leaf)
        self._bounds()

    def _shared(self) -> np.ndarray:
        """Length of the path that each document shares with the one before it."""
        n = len(self.ids)
        size = np.diff(self.first)
        out = np.zeros(n, np.int64)
        if n < 2:
            return out
        least = np.minimum(size[1:], size[:-1])
        alive, depth = np.flatnonzero(least > 0) + 1, 0
        while len(alive):
            same = self.term[self.first[alive] + depth] == self.term[self.first[alive - 1] + depth]
            alive = alive[same]
            depth += 1
            out[alive] = depth
            alive = alive[least[alive - 1] > depth]
        return out

    def _nodes(self, shared: np.ndarray, leaf: int):
        """(first document, end, parent) of every node; parents stand before their children, a leaf has no children."""
        low, high, parent = [0], [len(shared)], [-1]
        stack = [0]
        while stack:
            v = stack.pop()
            a, b = low[v], high[v]
            if b - a <= leaf:
                continue
            inner = shared[a + 1:b]
            least = inner.min()
            cut = np.concatenate([[a], np.flatnonzero(inner == least) + a + 1, [b]])
            if least == inner.max() and (self.first[a + 1] - self.first[a]) == least and len(cut) > 2 and np.all(
                    np.diff(self.first[a:b + 1]) == least):
                cut = np.arange(a, b + 1)  # equal paths: no branches, so cut by number alone
            # branches below `leaf` documents are joined with their neighbours
            kept, at = [a], a
            for x, y in zip(cut[:-1], cut[1:]):
                if y - x >= leaf:
                    if x > at:
                        kept.append(int(x))
                    kept.append(int(y))
                    at = y
                elif y - at >= leaf:
                    kept.append(int(y))
                    at = y
            if kept[-1] != b:
                kept.append(b)
            for x, y in zip(kept[:-1], kept[1:]):
                low.append(x)
                high.append(y)
                parent.append(v)
                if len(kept) > 2:
                    stack.append(len(low) - 1)
        return np.array(low), np.array(high), np.array(parent)

    def _bounds(self):
        """Per node the least m and id, and the largest tf of every term (sorted keys of node and term)."""
        nodes = len(self.low)
        depth = np.zeros(nodes, np.int64)
        for v in range(1, nodes):
            depth[v] = depth[self.parent[v]] + 1
        self.child = np.searchsorted(self.parent, np.arange(-1, nodes + 1)) if np.all(np.diff(self.parent) >= 0) else None
        kids: list[list[int]] = [[] for _ in range(nodes)]
        for v in range(1, nodes):
            kids[self.parent[v]].append(v)
        self.kids = [np.array(k, np.int64) for k in kids]
        leaves = np.array([v for v in range(nodes) if not kids[v]], np.int64)
        self.is_leaf = np.zeros(nodes, bool)
        self.is_leaf[leaves] = True
        of = np.full(len(self.ids), 0, np.int64)
        for v in leaves:
            of[self.low[v]:self.high[v]] = v
        self.least_m, self.least_id = np.full(nodes, NO_ID), np.full(nodes, NO_ID)
        np.minimum.at(self.least_m, of, self.m)
        np.minimum.at(self.least_id, of, self.ids)
        done_keys, done_top = [], []
        waiting: dict[int, list] = {}

        def settle(keys, tf):
            by = np.argsort(keys, kind="stable")
            keys, tf = keys[by], tf[by]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            return keys[at], np.maximum.reduceat(tf, at) if len(at) else tf

        keys, tf = settle(of[self.doc] * self.vocabulary + self.term, self.tf)
        at_depth = depth[keys // self.vocabulary]
        for d in range(int(depth.max()), -1, -1):
            mine = [(keys[at_depth == d], tf[at_depth == d]), *waiting.pop(d, [])]
            k, t = settle(np.concatenate([x for x, _ in mine]), np.concatenate([x for _, x in mine]))
            done_keys.append(k)
            done_top.append(t)
            here = np.flatnonzero(depth == d)
            if d:
                up = self.parent[k // self.vocabulary] * self.vocabulary + k % self.vocabulary
                waiting[d - 1] = [(up, t)]
                np.minimum.at(self.least_m, self.parent[here], self.least_m[here])
                np.minimum.at(self.least_id, self.parent[here], self.least_id[here])
        keys, top = np.concatenate(done_keys), np.concatenate(done_top)
        by = np.argsort(keys)
        self.node_keys, self.node_top = keys[by], top[by]

    @staticmethod
    def _lookup(keys, values, wanted):
        if not len(keys):
            return np.zeros(wanted.shape, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0)

    def bound(self, nodes: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        tf = self._lookup(self.node_keys, self.node_top, nodes[:, None] * self.vocabulary + terms[None, :])
        return saturation(tf, self.least_m[nodes][:, None]) @ weight

    def scores(self, docs: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        tf = self._lookup(self.keys, self.tf, docs[:, None] * self.vocabulary + terms[None, :])
        return saturation(tf, self.m[docs][:, None]) @ weight

    def search(self, terms: np.ndarray, weight: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int = K):
        """``best`` (scores, ids; sorted, at most ``k``) after the block's documents have had their turn."""
        score, ids = best
        stack = [(0, None)]
        while stack:
            v, bound = stack.pop()
            full = len(score) == k
            if bound is not None and full and (bound < score[-1] or (bound == score[-1] and self.least_id[v] > ids[-1])):
                continue
            kids = self.kids[v] if not self.is_leaf[v] else np.array([v])
            b = self.bound(kids, terms, weight)
            ok = b > 0
            if full:
                ok &= (b > score[-1]) | ((b == score[-1]) & (self.least_id[kids] <= ids[-1]))
            kids, b = kids[ok], b[ok]
            leaf = self.is_leaf[kids]
            if leaf.any():
                at = kids[leaf]
                by = np.argsort(-b[leaf], kind="stable")
                at, top = at[by], b[leaf][by]
                i = 0
                while i < len(at):  # best leaves first, some together
                    if len(score) == k and top[i] < score[-1]:
                        break
                    docs = np.concatenate([np.arange(self.low[u], self.high[u]) for u in at[i:i + 4]])
                    s = self.scores(docs, terms, weight)
                    some = np.flatnonzero(s > 0 if len(score) < k else s >= score[-1])
                    if len(some):
                        score, ids = np.concatenate([score, s[some]]), np.concatenate([ids, self.ids[docs[some]]])
                        first = np.lexsort((ids, -score))[:k]
                        score, ids = score[first], ids[first]
                    i += 4
            deeper = np.flatnonzero(~leaf)
            for i in deeper[np.argsort(b[deeper], kind="stable")]:  # the best one is taken next
                stack.append((int(kids[i]), int(b[i])))
        return score, ids


def block_results(docs: DataFrame, weights: Weights, k: int, block: int = BLOCK, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, score, doc_id): the best ``k`` of every item in every task."""

    def make():
        hasher = WholeHasher()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in weights.ids]
        held: list[tuple] = []
        size = [0, 0]

        def flush():
            if not held:
                return
            ids, m = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            before = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
            doc = np.concatenate([x[2] + n for x, n in zip(held, before)])
            tree = Tree(ids, m, doc, np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held]), len(weights.hashes))
            for i, (terms, weight) in enumerate(weights.of):
                if len(terms):
                    best[i] = tree.search(terms, weight, best[i], k)
            held.clear()
            size[:] = 0, 0

        def run(batch):
            if batch is None:
                flush()
                for i, (score, ids) in enumerate(best):
                    if len(score):
                        yield {"item": [i] * len(score), "score": score, "doc_id": [None if d == NO_ID else int(d) for d in ids]}
                return
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for start, texts in pieces(batch.column(1).to_pylist()):
                h, first = hasher.words(texts)
                n = np.diff(first)
                doc, term, tf = restricted(h, first, weights.hashes, weights.rank)
                some = np.unique(doc)  # documents without any item's term are never found
                held.append((ids[start + some], weights.m(n[some]), np.searchsorted(some, doc), term, tf.astype(np.int64)))
                size[0] += len(some)
                size[1] += len(h)
                if size[0] >= block or size[1] >= block_terms:
                    flush()
            yield from ()

        return run

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(x, make, "item int, score long, doc_id long", last=True)


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = K, part_bytes: int = PART_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: every item's ``k`` best documents."""
    spark = docs.sparkSession
    out = None
    for items in item_parts(benchmark, part_bytes):
        weights = items.weighted(*statistics(docs, items))
        found = block_results(docs, weights, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
        found = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
