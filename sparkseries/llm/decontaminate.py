"""Benchmark decontamination: a BM25 inverted index of test items searched with block-max WAND.

Every training text is cut into overlapping passages (windows of twice the longest item, one longest
item apart, so each place where an item could stand lies inside a passage).  Each passage is a query against the
index of items: an item's BM25 score for the passage's distinct terms, divided by the item's score for its own
text, must reach ``THRESHOLD``; all such items are retrieved.  Items are kept in blocks with the largest impact of
each term per block.  The sum of a passage's block maxima bounds every score in the block; blocks whose
bound stays below the threshold are skipped, the items of the others are scored exactly.  Terms that occur in most blocks
prune nothing, so they enter the bound as one constant per block.

A retrieved item is then verified: shares ``OVERLAP`` of the word pairs of its question and of its answer must
stand in the passage.  The question ends at the item's last question mark; without one (or with nothing behind it) the
last quarter of its words is the answer.

The index is sent with the tasks, so its size is checked: a benchmark of more than ``PART_BYTES`` of text
is searched in several parts, one at a time (document frequencies always come from all items).

Cases: null or empty items and texts match nothing; repeated items are items of their own; repeated documents
give repeated rows; an empty table gives no rows; texts are searched whole, in pieces; ids may be null.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseries.llm.tables import arrow_map, free, slices, written
from sparkseries.llm.text import Hasher, mix, pieces

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.6, 0.5
BLOCK = 8
PART_BYTES = 32 << 20


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, asked): hashes of the item's words, and how many of them are its question."""

    def make():
        hasher = Hasher()

        def run(batch):
            ids = batch.column(0).to_pylist()
            texts = [(t or "") for t in batch.column(1).to_pylist()]
            h, first = hasher.words([t.encode("utf-8", "replace") for t in texts])
            q, qf = hasher.words([t[:t.rfind("?") + 1].encode("utf-8", "replace") for t in texts])
            n, asked = np.diff(first), np.diff(qf)
            asked = np.where((asked > 0) & (asked < n), asked, n - np.maximum(1, n // 4))
            yield {"item_id": ids, "words": [x.view(np.int64) for x in np.split(h, first[1:-1])], "asked": asked}

        return run

    return arrow_map(benchmark.select("item_id", "text"), make, "item_id long, words array<long>, asked int")


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; a single word stands for itself."""
    return mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) if len(h) > 1 else h


class Index:
    """Inverted index of a bounded set of items with block maxima."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], frequency: dict[int, int], total: int,
                 mean_length: float, threshold: float = THRESHOLD, overlap: float = OVERLAP, stride: int | None = None):
        items = sorted(items, key=lambda x: (-1 if x[0] is None else x[0]))
        self.items, self.threshold, self.overlap = items, threshold, overlap
        self.stride = stride or max((len(w) for _, w, _ in items), default=1)
        self.terms = np.unique(np.concatenate([w for _, w, _ in items])) if items else np.zeros(0, np.uint64)
        term, item, impact = [], [], []
        for i, (_, words, _) in enumerate(items):
            t, tf = np.unique(words, return_counts=True)
            df = np.array([frequency[int(x)] for x in t.view(np.int64)], float)
            idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
            term.append(np.searchsorted(self.terms, t))
            item.append(np.full(len(t), i))
            impact.append(w / w.sum())
        cat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
        term, item, impact = cat(term, np.int64), cat(item, np.int64), cat(impact, float)
        order = np.lexsort((item, term))
        term, self.post_item, self.post_impact = term[order], item[order], impact[order]
        self.post_start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # block maxima: one entry per term and block
        self.blocks = math.ceil(len(items) / BLOCK)
        key = term * max(1, self.blocks) + self.post_item // BLOCK
        u, at = np.unique(key, return_index=True)
        top = np.maximum.reduceat(self.post_impact, at) if len(at) else np.zeros(0)
        bt, bb = u // max(1, self.blocks), u % max(1, self.blocks)
        spread = np.bincount(bt, minlength=len(self.terms))
        wide = spread > max(4, self.blocks // 5)  # terms in most blocks: a constant per block
        rest = np.bincount(self.post_item, self.post_impact * wide[term], len(items))
        self.rest = np.array([rest[i * BLOCK:(i + 1) * BLOCK].max() for i in range(self.blocks)])
        keep = ~wide[bt]
        self.block_of, self.block_max = bb[keep], top[keep]
        self.block_start = np.searchsorted(bt[keep], np.arange(len(self.terms) + 1))
        self.pairs = [(np.unique(pair_hashes(w[:q])), np.unique(pair_hashes(w[q:]))) for _, w, q in items]

    def search(self, h: np.ndarray, first: np.ndarray):
        """Yield (text, item, score, question share, answer share, first word of the passage) of every match."""
        if not len(self.terms) or not len(h):
            return
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.where(self.terms[at] == h, at, -1)
        n = np.diff(first)
        segs = -(-n // self.stride)
        seg_first = np.concatenate([[0], np.cumsum(segs)])
        word = np.flatnonzero(known >= 0)
        text = np.searchsorted(first, word, "right") - 1
        seg = seg_first[text] + (word - first[text]) // self.stride
        term = known[word]
        count = self.block_start[term + 1] - self.block_start[term]
        post = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.block_start[term], count)
        bound = np.bincount(np.repeat(seg, count) * self.blocks + self.block_of[post], self.block_max[post],
                            int(seg_first[-1]) * self.blocks).reshape(-1, self.blocks)
        pair = bound.copy()
        pair[:-1] += bound[1:]
        last = seg_first[1:][n > 0] - 1
        pair[last] = bound[last]  # a text's last passage has one part
        may = np.flatnonzero((pair + self.rest >= self.threshold - 1e-9).any(axis=1))
        for s in may:
            t = int(np.searchsorted(seg_first, s, "right") - 1)
            lo = int(first[t] + (s - seg_first[t]) * self.stride)
            hi = int(min(first[t + 1], lo + 2 * self.stride))
            terms = np.unique(known[lo:hi])
            terms = terms[terms >= 0]
            c = self.post_start[terms + 1] - self.post_start[terms]
            p = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.post_start[terms], c)
            score = np.bincount(self.post_item[p], self.post_impact[p], len(self.items))
            for i in np.flatnonzero(score >= self.threshold):
                here = pair_hashes(h[lo:hi])
                words = h[lo:hi]
                q, a = self.pairs[i]
                qs = np.isin(q, words if self.items[i][2] == 1 else here).mean() if len(q) else 1.0
                single = len(self.items[i][1]) - self.items[i][2] == 1
                as_ = np.isin(a, words if single else here).mean() if len(a) else 1.0
                if qs >= self.overlap and as_ >= self.overlap:
                    yield t, int(i), float(score[i]), float(qs), float(as_), lo - int(first[t])


def build_indexes(benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
                  part_bytes: int = PART_BYTES):
    """Yield (index, whether it is the only one): the index of all items, in as many parts as its size asks for, one
    at a time.  The passages are those of the longest of all items, so results do not depend on the parts."""
    items = item_words(benchmark).where(F.size("words") > 0)
    s = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("words"),
                  F.max(F.size("words")).alias("longest")).first()
    if not s["n"]:
        return
    parts = max(1, math.ceil(8 * s["words"] / part_bytes))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)))
    terms = items.select("part", F.explode(F.array_distinct("words")).alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for k in range(parts):  # one part of bounded size at a time
        rows = items.where(F.col("part") == k).select("item_id", "words", "asked").collect()
        here = terms.where(F.col("part") == k).select("term").distinct()
        frequency = {r["term"]: r["df"] for r in df.join(here, "term").collect()}
        packed = [(r["item_id"], np.array(r["words"], np.int64).view(np.uint64), r["asked"]) for r in rows]
        yield Index(packed, frequency, s["n"], s["words"] / s["n"], threshold, overlap, s["longest"]), parts == 1


def matches(docs: DataFrame, index: Index) -> DataFrame:
    """One row per document and item found in it, with the best passage."""

    def make():
        hasher = Hasher()

        def run(batch):
            ids = batch.column(0).to_pylist()
            for start, texts in pieces(batch.column(1)):
                h, first = hasher.words(texts)
                best: dict[tuple[int, int], tuple] = {}
                for t, i, *found in index.search(h, first):
                    if (t, i) not in best or found[0] > best[t, i][0]:
                        best[t, i] = tuple(found)
                rows = [(ids[start + t], index.items[i][0], *f) for (t, i), f in best.items()]
                cols = list(zip(*rows)) or [()] * 6
                yield dict(zip(("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"), cols))

        return run

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, item_id long, score double, "
                     "question_overlap double, answer_overlap double, first_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every (document, benchmark item) match; those of each part are written before the next part is read."""
    out = None
    for index, alone in build_indexes(benchmark, **options):
        found = matches(docs, index) if alone else written(matches(docs, index), "matches")
        out = found if out is None else out.unionByName(found)
    return matches(docs, Index([], {}, 0, 1.0)) if out is None else out


def clean_rows(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, in one pass for each part of the index, written
    before the next part is read."""
    import pyarrow as pa

    names, width = docs.columns, len(docs.columns)
    place = names.index("text") if "text" in names else width  # a text goes to the task once
    for index, alone in build_indexes(benchmark, **options):
        def run(batches, index=index):
            hasher = Hasher()
            for b in (s for batch in batches for s in slices(batch, place)):
                bad = np.zeros(b.num_rows, bool)
                for start, texts in pieces(b.column(place)):
                    h, first = hasher.words(texts)
                    for t, *_ in index.search(h, first):
                        bad[start + t] = True
                kept = b.filter(pa.array(~bad))
                yield pa.RecordBatch.from_arrays(kept.columns[:width], names=kept.schema.names[:width])

        sent = docs if "text" in names else docs.select("*", F.col("text").alias(free(docs, "__text")))
        docs = sent.mapInArrow(run, docs.schema)
        docs = docs if alone else written(docs, "clean")
    return docs
