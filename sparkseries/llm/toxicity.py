"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two words by the subsequences of three symbols they share, contiguous or not: a
subsequence that spans ``s`` symbols weighs ``DECAY**s``, spans up to ``SPAN`` count, a mark stands before the
word's first letter, and the kernel is normalised, so inserted characters and gaps lower it only gradually.
One or two inserted letters still take most words below the threshold, so a word that becomes a repeated
positive word of the training when they are left out has at least that word's margin; three or more do not count.
A text is toxic if one of its words is: its margin is the largest margin of its words (those below
-1 count as -1).  The machine learns from single words, with labels inferred from the labelled texts, and not from
sentences: a text that is toxic only by several harmless words together is not found.

Training, on at most ``SAMPLE`` labelled texts (evenly over the labels, by a hash of the id):

1. Half of the sample gives word counts by label, and from them the log odds of every subsequence.  Words of
   toxic texts only whose subsequences lean to toxic are the first positive examples; clean words that lean
   that way and common clean words are the negative ones.
2. Landmarks are words of these three kinds chosen farthest-first under the kernel.  The Nyström map sends a
   word to ``K(word, landmarks) K(landmarks, landmarks)^(-1/2)``; a linear machine with squared hinge loss is
   trained there.
3. The clean words that the machine scores highest become further negative examples and it is trained again,
   twice.
4. The other half of the sample calibrates the text margin to a probability.

Because the machine is linear in the landmarks, it folds into one weight per subsequence; scoring a
word is a sum over its subsequences, divided by its own norm.

Words are runs without white space, lower-cased, with characters that are neither letters nor digits
taken out (``i.d-i*o_t`` is ``idiot``); three or more single letters in a row are joined (``i d i o t``).

Cases: null and empty texts have no words and get the score of the lowest margin; without labelled
rows of both kinds every score is 0; labels of one id that disagree count as toxic; null labels are left out;
rows without id are scored, not learned from; texts are scored whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseries.llm.tables import arrow_map, dropped, fold, held_out, slices, written
from sparkseries.llm.text import mix

#: Bound of the labelled texts the classifier is fitted on.
SAMPLE = 9000
#: Bound of the words of either kind that the machine is fitted on.
WORDS = 8000
LANDMARKS = 512
RIDGE = 1.0
#: Mean log odds from which a word of toxic texts is a first positive example, and their shrinkage.
LEAN, SHRINK = 1.0, 8.0
SPAN, DECAY = 6, 0.7
THRESHOLD = 0.7
#: Positive words that are also found with one or two inserted letters: those that so many toxic texts repeat, of
#: so many symbols (two letters are looked past from one symbol more).
REPEATED, SHORTEST, LONGEST = 3, 4, 32
SLICE = 1 << 19  # symbols handled at a time
#: Words whose dense rows the driver holds at a time, and subsequences of a block of the kernel matrix.
BLOCK, COLUMNS = 500, 4096
_OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_SYMBOL_BITS = 6


def _symbols() -> np.ndarray:
    """Symbol of each code point below 2**16: 0 white space, 1 left out, 3.. letters and digits (2 is the mark)."""
    t = np.ones(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            t[i] = 0
        elif "a" <= c <= "z":
            t[i] = 3 + i - 97
        elif "0" <= c <= "9":
            t[i] = 29 + i - 48
        elif c.isalnum():
            t[i] = 39 + (i * 7) % 25
    return t


class Words:
    """Distinct words of many texts as rows of symbols."""

    def __init__(self):
        self.table = _symbols()
        self.power = np.full(SLICE, 0x9E3779B97F4A7C15, np.uint64)
        self.power[0] = 1
        self.power = np.multiply.accumulate(self.power)
        inverse = np.full(SLICE, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)

    def groups(self, texts: list):
        """Yield (indices of texts, texts) of about ``SLICE`` symbols; a longer text comes in parts cut
        at white space, all with its index.  An Arrow column is turned into Python's texts group by group."""
        idx, held, size = [], [], 0
        for i, t in enumerate(texts):
            t = ((t.as_py() if hasattr(t, "as_py") else t) or "").lower()
            at = 0
            while True:
                end = at + SLICE // 2
                if end >= len(t):
                    end = len(t)
                else:
                    cut = max(t.rfind(" ", at, end), t.rfind("\n", at, end))
                    end = cut + 1 if cut > at else end
                if size + end - at + 1 > SLICE - 2 and held:
                    yield idx, held
                    idx, held, size = [], [], 0
                idx.append(i)
                held.append(t[at:end])
                size += end - at + 1
                at = end
                if at >= len(t):
                    break
        if held:
            yield idx, held

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols without gaps, first symbol of every word plus the end, text of every word, hash)."""
        code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
        sym = self.table[np.minimum(code, (1 << 16) - 1)]
        sym = np.where(code >= 1 << 16, np.uint8(39), sym) if code.max(initial=0) >= 1 << 16 else sym
        bounds = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(bounds, np.flatnonzero(sym > 1), "right")
        at = np.flatnonzero(sym > 1)  # places of letters and digits
        if not len(at):
            return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        gaps = np.cumsum(sym == 0)[at]  # white space seen so far: changes between words
        new = np.ones(len(at), bool)
        new[1:] = gaps[1:] != gaps[:-1]
        first = np.append(np.flatnonzero(new), len(at))
        single = (np.diff(first) == 1) & (sym[at[first[:-1]]] < 29 + 0 * first[:-1])
        # runs of three or more single letters in one text become one word
        if single.any():
            t = text[first[:-1]]
            joined = single.copy()
            joined[1:] &= single[:-1] & (t[1:] == t[:-1])
            joined[0] = False
            run = np.cumsum(~joined)
            long = np.bincount(run)[run] >= 3
            keep = ~(joined & long)
            first = np.append(first[:-1][keep], len(at))
        s = sym[at]
        total = np.concatenate([[np.uint64(0)], np.cumsum(s.astype(np.uint64) * self.power[:len(s)])])
        lo, hi = first[:-1], first[1:]
        return s, first, text[lo], mix((total[hi] - total[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64))


def subsequences(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of every marked subsequence occurrence of the words."""
    n = np.diff(first)
    width = n + 1  # with the mark
    start = np.cumsum(width) - width
    s = np.full(int(width.sum()), 2, np.int64)
    body = np.ones(len(s), bool)
    body[start] = False
    s[body] = sym[first[0]:first[-1]]
    word = np.repeat(np.arange(len(n)), width)
    words, codes, weights = [], [], []
    for i, j in _OFFSETS:
        if len(s) <= j:
            break
        ok = np.flatnonzero(word[:-j] == word[j:])
        words.append(word[ok])
        codes.append((s[ok] << 2 * _SYMBOL_BITS) | (s[ok + i] << _SYMBOL_BITS) | s[ok + j])
        weights.append(np.full(len(ok), DECAY ** (j + 1), np.float32))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(words), np.concatenate(codes), np.concatenate(weights)


def features(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised explicit features of words: (word, code, value), one row per word and code."""
    word, code, weight = subsequences(sym, first)
    key = word << 3 * _SYMBOL_BITS | code
    u, inv = np.unique(key, return_inverse=True)
    value = np.bincount(inv, weight, len(u))
    word, code = u >> 3 * _SYMBOL_BITS, u & ((1 << 3 * _SYMBOL_BITS) - 1)
    norm = np.sqrt(np.bincount(word, value * value, len(first) - 1))
    return word, code, value / np.maximum(norm[word], 1e-12)


class Kernel:
    """Gap-weighted kernel values between word lists, through the sparse features of the right-hand list."""

    def __init__(self, words: Words):
        self.words = words

    def sparse(self, names: list[str]):
        out = self.words.split(names)
        return features(out[0], out[1]), len(names)

    def dense(self, names: list[str], columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of features of the names over the codes in ``columns`` (or over their own codes)."""
        (w, c, v), n = self.sparse(names)
        columns = np.unique(c) if columns is None else columns
        at = np.minimum(np.searchsorted(columns, c), max(len(columns) - 1, 0))
        ok = columns[at] == c if len(columns) else np.zeros(len(c), bool)
        m = np.zeros((n, len(columns)), np.float32)
        m[w[ok], at[ok]] = v[ok]
        return m, columns

    def gram(self, names: list[str]) -> np.ndarray:
        """Kernel values between all names, added up over blocks of their codes."""
        (w, c, v), n = self.sparse(names)
        columns, at = np.unique(c, return_inverse=True)
        out = np.zeros((n, n), np.float32)
        for i in range(0, len(columns), COLUMNS):
            ok = (at >= i) & (at < i + COLUMNS)
            m = np.zeros((n, min(COLUMNS, len(columns) - i)), np.float32)
            m[w[ok], at[ok] - i] = v[ok]
            out += m @ m.T
        return out


def squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float, steps: int = 60) -> np.ndarray:
    """Linear machine with bias, by Newton steps with backtracking on the primal:
    min reg/2 |w|^2 + sum weight * max(0, 1 - y f)^2 / 2.  Beside ``z`` only ``BLOCK`` of its rows are held."""
    ridge = np.full(z.shape[1] + 1, reg)
    ridge[-1] = 1e-6

    def gaps(w):
        return np.maximum(0, 1 - y * (z @ w[:-1] + w[-1]))

    def loss(w):
        gap = gaps(w)
        return (ridge * w * w).sum() / 2 + (weight * gap * gap).sum() / 2

    w = np.zeros(z.shape[1] + 1)
    now = loss(w)
    for _ in range(steps):
        active = np.flatnonzero(gaps(w) > 0)
        square, right = np.diag(ridge), np.zeros(len(w))
        for i in range(0, len(active), BLOCK):
            part = active[i:i + BLOCK]
            x = np.hstack([z[part], np.ones((len(part), 1))])
            s = weight[part][:, None] * x
            square += x.T @ s
            right += s.T @ y[part]
        step = np.linalg.solve(square, right) - w
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now <= 1e-9 * before:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with a small ridge; the slope is not negative."""
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])
    pos = max(float(y.sum()), 1.0)
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) + 1e-3 * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


class Scorer:
    """Margins of texts under a folded model: one weight per subsequence and a bias.  Words that become one of
    the ``known`` words when one or two letters are left out have at least its margin."""

    def __init__(self, beta: np.ndarray, bias: float, known: list[str] = ()):
        self.words, self.beta, self.bias = Words(), beta, bias
        self.known = [w for w in known if SHORTEST <= len(w) <= LONGEST]
        self.longest = max(map(len, self.known), default=0)
        h = self.words.split(self.known)[3] if self.known else np.zeros(0, np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.own = np.zeros(0)
        self.own = self.margins(self.known)[self.order] if self.known else self.own

    def margins(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), -1.0)
        for idx, part in self.words.groups(texts):
            sym, first, text, h = self.words.split(part)
            if not len(h):
                continue
            _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
            m = self.word_margins(sym, first, one)
            if self.longest and len(self.own):
                m = np.maximum(m, self.inserted(*_pick(sym, first, one)))
            m = m[inverse]
            new = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            best = np.maximum.reduceat(m, new)
            np.maximum.at(out, np.asarray(idx)[text[new]], best)
        return out

    def word_margins(self, sym: np.ndarray, first: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact margins of the words that can exceed -1; the others get -1."""
        sym, first = _pick(sym, first, which)
        word, code, weight = subsequences(sym, first)
        n = len(which)
        top = np.bincount(word, weight * self.beta[code], n)
        # occurrences of one subsequence add up, so the norm is at least the root of their squares
        low = np.sqrt(np.bincount(word, weight.astype(np.float64) ** 2, n))
        bound = np.maximum(top, 0) / np.maximum(low, 1e-12) + self.bias
        out = np.full(n, -1.0)
        may = np.flatnonzero(bound > -1)
        if len(may):
            s, f = _pick(sym, first, may)
            w, c, v = features(s, f)
            out[may] = np.maximum(np.bincount(w, v * self.beta[c], len(may)) + self.bias, -1.0)
        return out


    def inserted(self, sym: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The largest margin of the known words that each word becomes without one or two letters, else -1."""
        power, inverse = self.words.power, self.words.inverse
        total = np.concatenate([[np.uint64(0)], np.cumsum(sym.astype(np.uint64) * power[:len(sym)])])
        n = np.diff(first)
        out = np.full(len(n), -1.0)
        for size in range(SHORTEST + 1, self.longest + 3):
            which = np.flatnonzero(n == size)
            cuts = [(1, *(np.tile(np.arange(size), (2, 1))))]
            if size - 2 > SHORTEST:
                cuts.append((2, *np.triu_indices(size, 1)))
            for drop, i, j in cuts:
                step = max(1, SLICE // len(i))
                for part in np.split(which, np.arange(step, len(which), step)):
                    lo = first[part][:, None]
                    raw = (total[lo + i] - total[lo]) * inverse[lo]
                    if drop == 2:
                        raw = raw + (total[lo + j] - total[lo + i + 1]) * inverse[lo + 1]
                    raw = raw + (total[lo + size] - total[lo + j + 1]) * inverse[lo + drop]
                    h = mix(raw + np.uint64(size - drop))
                    row, col = np.nonzero(self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)])
                    h = h[row, col]
                    at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                    hit = np.flatnonzero(self.hashes[at] == h)
                    np.maximum.at(out, part[row[hit]], self.own[at[hit]])
        return out


def _pick(sym: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)[which]
    start = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(start, n) + np.repeat(first[:-1][which], n)
    return sym[at], np.append(start, int(n.sum()))


def spell(sym: np.ndarray) -> str:
    """A word that has these symbols: enough to stand for it under the kernel."""
    return "".join(chr(94 + s) if s < 29 else chr(19 + s) if s < 39 else _LETTERS[s - 39] for s in sym.tolist())


def _letters() -> list[str]:
    """For each symbol from 39 on, the first letter beyond ASCII that has it."""
    out: dict[int, str] = {}
    for i in range(192, 1 << 12):
        if chr(i).isalnum() and chr(i).lower() == chr(i):
            out.setdefault((i * 7) % 25, chr(i))
    return [out[i] for i in range(25)]


_LETTERS = _letters()


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, toxic texts with it, clean texts with it) of a bounded sample, pre-added in each task."""

    def make():
        words = Words()

        def run(batch):
            seen: dict[str, list[int]] = {}
            toxic = batch.column(1).to_pylist()
            for idx, part in words.groups(batch.column(0)):
                sym, first, text, h = words.split(part)
                key = mix(h + mix(text.astype(np.uint64)))
                for k in np.unique(key, return_index=True)[1]:
                    w = spell(sym[first[k]:first[k + 1]])
                    seen.setdefault(w, [0, 0])[1 - toxic[idx[text[k]]]] += 1
            yield {"word": list(seen), "toxic": [v[0] for v in seen.values()], "clean": [v[1] for v in seen.values()]}

        return run

    return (arrow_map(sample.select("text", "toxic"), make, "word string, toxic long, clean long")
            .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def farthest_first(k: np.ndarray, count: int) -> list[int]:
    """Rows of a kernel matrix chosen so that each is least like the ones before it, in steady order."""
    chosen, near = [0], k[0].copy()
    while len(chosen) < min(count, len(k)):
        i = int(np.argmin(near))
        if near[i] > 0.98:
            break
        chosen.append(i)
        near = np.maximum(near, k[i])
    return chosen


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame | None:
    """(text, toxic, half) of at most ``size`` labelled rows that may be learned from."""
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    y = y.where(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    y = y.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    per = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    if not per.get(0) or not per.get(1):
        return None
    quota = {1: size // 3, 0: size - size // 3}
    share = F.when(F.col("toxic") == 1, min(1.0, 0.95 * quota[1] / per[1])).otherwise(min(1.0, 0.95 * quota[0] / per[0]))
    place = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) / (1 << 20)
    few = y.where(place < share).orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id").limit(size).collect()
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in few], "doc_id long, toxic int")
    # at most `size` ids, so this side always fits a broadcast
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(
        "text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(37)), F.lit(2)).alias("half"))


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, landmarks: int = LANDMARKS) -> dict | None:
    sample = labelled_sample(docs, labels, size)
    if sample is None:
        return None
    counts = written(word_counts(sample.where("half = 0")), "toxicity-words")
    sums = subsequence_counts(counts)
    only = F.col("clean") * 20 <= F.col("toxic")
    rated = written(rate_words(counts, *sums), "toxicity-rated")
    dropped(counts)
    # first positive examples: words that toxic texts repeat, or that lean to toxic
    telling = F.greatest(F.log(F.col("toxic") / 2), F.col("lean") - LEAN)
    best = rated.where(only & (telling > 0)).orderBy(F.desc(telling), "word").limit(WORDS // 2).collect()
    telling = [r["word"] for r in best]
    near = rated.where(~only).orderBy(F.desc("lean"), "word").limit(WORDS // 2).collect()
    common = rated.where(~only).orderBy(F.desc("clean"), "word").limit(WORDS // 2).collect()
    plain = [r["word"] for r in common]
    if not telling or not plain:
        return None
    kernel = Kernel(Words())

    def landmarks_of(names: list[str], count: int) -> list[str]:
        return [names[i] for i in farthest_first(kernel.gram(names), count)]

    marks = (landmarks_of(telling[:1500], landmarks // 2) + landmarks_of([r["word"] for r in near[:600]], landmarks // 4)
             + landmarks_of(plain[:600], landmarks // 4))
    lm, columns = kernel.dense(marks)
    values, vectors = np.linalg.eigh((lm @ lm.T).astype(np.float64))
    keep = values > 1e-6
    whiten = (vectors[:, keep] / np.sqrt(values[keep]))  # K(landmarks, landmarks)^(-1/2)

    def fit(names: list[str], pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, float]:
        """The machine on words with a weight for either side, folded into subsequence weights."""
        p, n = np.flatnonzero(pos), np.flatnonzero(neg)
        names = [names[i] for i in (*p, *n)]
        z = np.empty((len(names), whiten.shape[1]))
        for i in range(0, len(names), BLOCK):
            z[i:i + BLOCK] = kernel.dense(names[i:i + BLOCK], columns)[0] @ lm.T @ whiten
        y = np.concatenate([np.ones(len(p)), -np.ones(len(n))])
        w = squared_hinge(z, y, np.concatenate([pos[p], neg[n]]), reg=RIDGE)
        folded = np.zeros(1 << 3 * _SYMBOL_BITS)
        folded[columns] = (whiten @ w[:-1]) @ lm
        return folded, float(w[-1])

    def refit(pos: list) -> tuple[np.ndarray, float]:
        rows = list({r["word"]: r for r in pos + near + common}.values())
        is_pos = np.arange(len(rows)) < len(pos)
        up = np.array([np.sqrt(r["toxic"]) for r in rows]) * is_pos
        down = np.array([np.sqrt(max(r["clean"], 1)) for r in rows]) * ~is_pos
        return fit([r["word"] for r in rows], up / up.sum() * down.sum() / 3, down)

    beta, bias = refit(best)
    for _ in range(2):  # clean words that it scores highest are further negative examples
        hard = score_words(rated.where(~only).select("word", "toxic", "clean"), beta, bias)
        near += hard.orderBy(F.desc("margin"), "word").limit(WORDS // 2).collect()
        beta, bias = refit(best)
    dropped(rated)
    known = [r["word"] for r in best if r["toxic"] >= REPEATED]
    pairs = text_margins(sample.where("half = 1").select("text", "toxic"), beta, bias, known).select("toxic", "margin").collect()
    y = np.array([p["toxic"] for p in pairs], float)
    m = np.array([p["margin"] for p in pairs], float)
    slope, offset = platt(m, y) if len(set(y)) == 2 else (4.0, 0.0)
    used = np.flatnonzero(beta)
    return {"used": used, "beta": beta[used].astype(np.float32), "bias": bias, "known": known, "slope": slope, "offset": offset}


def subsequence_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each subsequence stands in words of toxic and of clean texts, over all counted words."""

    def make():
        words = Words()

        def run(batch):
            names, toxic, clean = (c.to_pylist() for c in batch.columns)
            t, c = np.zeros(1 << 3 * _SYMBOL_BITS), np.zeros(1 << 3 * _SYMBOL_BITS)
            for i in range(0, len(names), 20_000):
                part = slice(i, i + 20_000)
                sym, first, _, _ = words.split(names[part])
                w, code, _ = features(sym, first)
                t += np.bincount(code, np.asarray(toxic[part], float)[w], len(t))
                c += np.bincount(code, np.asarray(clean[part], float)[w], len(c))
            k = np.flatnonzero(t + c)
            yield {"code": k, "toxic": t[k], "clean": c[k]}

        return run

    sums = arrow_map(counts.select("word", "toxic", "clean"), make, "code int, toxic double, clean double")
    # at most 2**18 codes, as arrays: as Python rows they take ten times the room
    rows = sums.groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    t, c = np.zeros(1 << 3 * _SYMBOL_BITS), np.zeros(1 << 3 * _SYMBOL_BITS)
    t[rows["code"].to_numpy()], c[rows["code"].to_numpy()] = rows["toxic"].to_numpy(), rows["clean"].to_numpy()
    return t, c


def rate_words(counts: DataFrame, t: np.ndarray, c: np.ndarray) -> DataFrame:
    """The counted words with the mean log odds of their subsequences (weighted by squared features), as
    the *other* words show them, shrunk to 0."""
    share = max(t.sum() / max(c.sum(), 1.0), 1e-9)
    t, c = t.astype(np.float32), c.astype(np.float32)

    def make():
        words = Words()

        def run(batch):
            names, toxic, clean = (x.to_pylist() for x in batch.columns)
            for i in range(0, len(names), 20_000):
                part = slice(i, i + 20_000)
                sym, first, _, _ = words.split(names[part])
                w, code, v = features(sym, first)
                others = t[code] - np.asarray(toxic[part], np.float32)[w], c[code] - np.asarray(clean[part], np.float32)[w]
                lean = np.log((others[0] + SHRINK * share) / (others[1] + SHRINK) / share)
                yield {"word": names[part], "toxic": toxic[part], "clean": clean[part],
                       "lean": np.bincount(w, v * v * lean, len(names[part]))}

        return run

    return arrow_map(counts.select("word", "toxic", "clean"), make, "word string, toxic long, clean long, lean double")


def score_words(words: DataFrame, beta: np.ndarray, bias: float) -> DataFrame:
    """The counted words with their margins."""
    return text_margins(words.withColumn("text", F.col("word")), beta, bias)


def text_margins(texts: DataFrame, beta: np.ndarray, bias: float, known: list[str] = (), text: str = "text") -> DataFrame:
    """All columns of ``texts`` but ``text``, with the ``margin`` of the texts in column ``text``, which may be named
    otherwise and then stays."""
    import pyarrow as pa
    from pyspark.sql import types as T

    keep = [c for c in texts.columns if c != "text"]
    place = keep.index(text) if text in keep else len(keep)
    used = np.flatnonzero(beta)
    vals = beta[used].astype(np.float32)
    schema = T.StructType([*texts.select(*keep).schema.fields, T.StructField("margin", T.DoubleType())])

    def run(batches):
        full = np.zeros(1 << 3 * _SYMBOL_BITS, np.float32)
        full[used] = vals
        scorer = Scorer(full, bias, known)
        for b in (s for batch in batches for s in slices(batch, place)):
            m = scorer.margins(b.column(place))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(m, pa.float64())], names=[*keep, "margin"])

    return texts.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)


def score(docs: DataFrame, model: dict | None, keep: list[str] = ("doc_id",), out: str = "score") -> DataFrame:
    """``keep`` columns plus the score (0 to 1), named ``out``, of every row."""
    keep = list(keep)
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias(out))
    beta = np.zeros(1 << 3 * _SYMBOL_BITS, np.float32)
    beta[model["used"]] = model["beta"]
    names = [f"__{i}" for i in range(len(keep))]  # the caller's columns may be called anything
    text = names[keep.index("text")] if "text" in keep else "text"  # a text goes to the task once
    x = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], *([] if text in names else [F.col("text")]))
    x = text_margins(x, beta, model["bias"], model["known"], text)
    p = 1 / (1 + F.exp(-(F.lit(model["slope"]) * F.col("margin") + F.lit(model["offset"]))))
    return x.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], p.alias(out))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    s = score(docs, train(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"))
