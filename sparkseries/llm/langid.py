"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of 1 to 3 code points of the lower-cased text (letters; anything else counts as
one space), hashed into ``2**BITS`` columns.  Weights are ``(1 + ln tf) * idf``, scaled to unit length; document
frequencies come from *all* rows that may be learned from.  The model is trained with
follow-the-regularised-leader (proximal, per-coordinate rates) under an elastic-net penalty, whose L1
part leaves most coefficients exactly zero, on a sample of at most ``SAMPLE`` rows (evenly over the
languages, by a hash of the id).  A disjoint part of the sample, one row in four, calibrates a single
softmax temperature by log loss.

Cases: a text that is null or has no letter is ``und`` with score 0; so is every text when there is nothing to learn
from; rows without a language or id are not learned from but are predicted; ties between
languages go to the first in sorted order; texts are read whole; other columns are never inputs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseries.llm.tables import arrow_map, fold, free, held_out, slices

BITS = 16
ORDERS = (1, 2, 3)
#: Bound of the rows the classifier is fitted on.
SAMPLE = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.01
UNKNOWN = "und"
#: Share of the way from an even guess to the lowest score of the held-back rows that a score must reach for
#: a language to count as recognised.
CONFIDENT = 0.5
#: A character that counts as a letter, as a regular expression of Spark.
LETTER = r"\p{L}|[\x{10000}-\x{10FFFF}]"


class Grams:
    """Hashed n-gram counts of a text."""

    def __init__(self, bits: int = BITS, orders=ORDERS):
        self.size, self.orders, self.shift = 1 << bits, orders, np.uint64(64 - bits)
        self.table = np.array([ord(chr(i)) if chr(i).isalpha() else 32 for i in range(1 << 16)], np.uint64)
        self.seeds = [np.uint64(0x9E3779B97F4A7C15 * (2 * n + 1) & (2**64 - 1)) for n in range(max(orders))]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(columns, counts); both empty if there is no letter."""
        code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        code = self.table[np.minimum(code, len(self.table) - 1)] if len(code) == 0 or code.max() < 1 << 16 else \
            np.where(code < 1 << 16, self.table[np.minimum(code, (1 << 16) - 1)], code.astype(np.uint64))
        letter = code != 32
        if not letter.any():
            return np.zeros(0, np.int64), np.zeros(0)
        keep = letter.copy()  # runs of other characters count as one space
        keep[1:] |= letter[:-1]
        code = np.concatenate([[np.uint64(32)], code[keep], [np.uint64(32)]])
        cols = []
        for n in self.orders:
            if len(code) < n:
                continue
            h = np.zeros(len(code) - n + 1, np.uint64)
            for j in range(n):
                h = (h ^ code[j:len(code) - n + 1 + j]) * self.seeds[j] + np.uint64(n)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            cols.append((h >> self.shift).astype(np.int64))
        counts = np.bincount(np.concatenate(cols), minlength=self.size)
        at = np.flatnonzero(counts)
        return at, counts[at]


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Proximal follow-the-regularised-leader for a softmax over ``classes``."""

    def __init__(self, size: int, classes: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        pull = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, pull / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        new = n + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(n)) / self.alpha * w
        self.n[at] = new


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on held-back rows (a fine grid, then refined)."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.02, 20, 61)
    for _ in range(3):
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        k = int(np.argmin(loss))
        best = grid[k]
        grid = np.linspace(grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)], 21)
    return float(best)


def document_frequencies(learn: DataFrame, bits: int = BITS) -> tuple[int, np.ndarray]:
    """Rows with a letter, and for each column the rows that have it, over all of ``learn``: each task
    adds up its rows, so the tasks' sums have at most ``2**bits`` columns each."""

    def make():
        grams = Grams(bits)

        def run(batch):
            df, n = np.zeros(grams.size, np.int64), 0
            for t in batch.column(0):
                at, _ = grams(t.as_py())
                df[at] += 1
                n += len(at) > 0
            k = np.flatnonzero(df)
            yield {"col": np.append(k, -1), "df": np.append(df[k], n)}

        return run

    sums = arrow_map(learn.select("text"), make, "col int, df long").groupBy("col").agg(F.sum("df").alias("df"))
    out, n = np.zeros(1 << bits, np.int64), 0
    for r in sums.collect():  # at most 2**bits + 1 rows
        if r["col"] < 0:
            n = r["df"]
        else:
            out[r["col"]] = r["df"]
    return n, out


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id")).isNotNull() & (fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull())


def train(docs: DataFrame, bits: int = BITS, sample: int = SAMPLE, epochs: int = EPOCHS) -> dict | None:
    """The model, from rows of ``docs`` that may be learned from; None if there are none."""
    learn = learnable(docs)
    per = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not per:
        return None
    langs = sorted(per)
    n, df = document_frequencies(learn, bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    # even over the languages: of each, the rows whose hash lies below a share of the hash's range
    quota = max(1, sample // len(langs))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, 0.9 * quota / per[k]))])
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / (1 << 20)
    few = learn.where(place < share[F.col("lang")]).select("lang", "text", F.xxhash64("doc_id", F.lit(3)).alias("h"))

    def make():
        grams = Grams(bits)

        def run(batch):
            rows = [(la, h, *grams(t)) for la, t, h in zip(*(c.to_pylist() for c in batch.columns))]
            rows = [r for r in rows if len(r[2])]
            for i in range(0, len(rows), 200):
                la, h, at, counts = zip(*rows[i:i + 200])
                yield {"lang": la, "h": h, "at": at, "counts": counts}

        return run

    rows = arrow_map(few, make, "lang string, h long, at array<int>, counts array<float>")
    # at most `sample` rows of at most 2**bits columns, in a fixed order and as arrays: as Python numbers they take ten times the room
    rows = _vectors(rows.orderBy("h", "lang").limit(sample).toArrow(), idf)
    if not rows:
        return None
    model = Ftrl(1 << bits, len(langs))
    fit, kept = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if i % 4 == 0]
    for _ in range(epochs):
        for _, lang, at, x in fit or kept:
            model.learn(at, x, langs.index(lang))
    w = model.weights()
    z = np.array([x @ w[at] for _, _, at, x in kept])
    t = temperature(z, np.array([langs.index(r[1]) for r in kept]))
    lowest = float(softmax(z / t).max(axis=1).min())
    used = np.flatnonzero(np.abs(w).sum(axis=1))
    return {"langs": langs, "idf": idf.astype(np.float32), "used": used, "w": w[used].astype(np.float32), "t": t,
            "bits": bits, "lowest": lowest}


def _vectors(got, idf: np.ndarray) -> list[tuple]:
    """(hash, language, columns, weights) of every collected row."""
    out = []
    for b in got.to_batches():
        langs, h = b.column("lang").to_pylist(), b.column("h").to_pylist()
        lists = [b.column(n) for n in ("at", "counts")]
        at, counts = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        ends = np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))
        for i, (lo, hi) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
            out.append((h[i], langs[i], at[lo:hi], weigh(counts[lo:hi].astype(np.float64), idf[at[lo:hi]])))
    return out


def predict(docs: DataFrame, model: dict | None, keep: list[str] = ("doc_id",),
            out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns plus the predicted language and its score, named ``out``, of every row."""
    import pyarrow as pa
    from pyspark.sql import types as T

    keep = list(keep)
    x = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(free(docs, "__text")))
    place = keep.index("text") if "text" in keep else len(keep)  # a text goes to the task once
    schema = T.StructType([*x.schema.fields[:len(keep)], T.StructField(out[0], T.StringType()),
                           T.StructField(out[1], T.DoubleType())])

    def run(batches):
        if model is not None:
            grams = Grams(model["bits"])
            w = np.zeros((grams.size, len(model["langs"])), np.float32)
            w[model["used"]] = model["w"]
        for b in (s for batch in batches for s in slices(batch, place)):
            lang, score = [], []
            for t in b.column(place):
                at, counts = grams(t.as_py()) if model is not None else ((), ())
                if not len(at):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                p = softmax((weigh(counts, model["idf"][at]) @ w[at]).astype(float) / model["t"])
                lang.append(model["langs"][int(np.argmax(p))])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], names=[*keep, *out])

    return x.mapInArrow(run, schema)


def least_score(model: dict) -> float:
    """The smallest calibrated score with which a language counts as recognised."""
    even = 1 / len(model["langs"])
    return even + CONFIDENT * (model["lowest"] - even)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, learned from the rows not held out."""
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
