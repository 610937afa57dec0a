"""Phrase collocation mining by Toivonen's method: a sample proposes, a full pass decides, failures expand.

A text is lower-cased (A-Z), split at ``. , ; : ! ?`` and line breaks into pieces and these at blanks and tabs into words.
Phrases are 1 to ``LONGEST`` neighbouring words of a piece; everything is counted per language.

1. *Sample.*  One document in ``SAMPLE`` (by hash of id and text) proposes the phrases that reach a lowered threshold
   in it: words and pairs first, then longer ones made of such pairs.
2. *Full pass.*  Over all documents every proposed phrase and the whole negative border are counted exactly: a phrase is
   counted if it lacks its first, and if it lacks its last, word is proposed (single words always).  So the proposed set with
   its border is never listed; what occurs of it is met in the texts.
3. *Expansion.*  Frequent phrases that had not been proposed are border failures.  They join the proposed
   set and another full pass counts the phrases this adds, until a pass finds no failure.  Then every frequent phrase has been
   counted: a shortest one that had not would have all its parts proposed, hence lie in the border.

Tasks look the proposed set up in a bitmap of at most ``2**MOST_BITS`` bits (a Bloom filter, two probes).  Its
size is bounded whatever the corpus; a wrong hit only has a phrase counted that need not be, and a fuller bitmap prunes less.
A counting pass comes in two halves: the first adds up hashes alone (40 bits, as sorted gaps), in far fewer bytes; phrases of one hash
share a count, so it is never too low.  The second counts by (language, words), and only phrases whose hash reached the threshold: these
counts are exact.  Both combine in every task over bounded buffers (``HASHED``, ``BUFFER``) before the shuffle, so a hot
language or phrase is a few rows per task.  Inside a buffer of the second half phrases are told apart by hash and length.

Scores, ranks and the dropping of contained phrases are joins over frequent phrases alone.  A phrase is dropped if a longer frequent one
that contains it occurs as often; as counts only fall with growing length it is enough to look one word further.

Cases: null text has no words; null language is ``und``; repeated documents count again; ties of the score go by count,
then by UTF-8 order; an empty table gives no rows; texts are read whole, in pieces; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseries.llm.tables import arrow_map, written
from sparkseries.llm.text import Hasher, WholeHasher, mix, pieces

LONGEST, LEAST, TOP = 5, 100, 2000
SAMPLE, MARGIN = 8, 1.5
#: Bits of the bitmap: 16 for each proposed phrase within these powers of two.
LEAST_BITS, MOST_BITS, BITS_EACH = 20, 28, 16
BUFFER, GATHER = 1_000_000, 1 << 16
#: Rows of a batch that are turned into Python texts at a time.
ROWS = 500
#: Hashes that a task combines before it passes them on.
HASHED = 3_000_000
#: Hashes are told apart by their upper bits in the counts by hash; the first of these bits are the range that is shuffled as one.
KEPT_BITS, RANGE_BITS = 40, 12
UNKNOWN = "und"

# Bytes that end a piece, and bytes that separate words inside one.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"


def word_hasher() -> Hasher:
    """Word positions and hashes where every byte but ENDS and GAPS belongs to a word; A-Z counts as a-z."""
    hasher = WholeHasher()
    t = np.arange(256).astype(np.uint8)
    t[65:91] = np.arange(97, 123)
    t[0] = 65  # zero marks separators; the upper-case letters are free
    t[list(ENDS + GAPS)] = 0
    hasher.table = t
    return hasher


class Words:
    """The words of some texts: where they stand, their hashes (with the language's), and which of them share a piece."""

    def __init__(self, hasher: Hasher, texts: list[bytes], seeds: np.ndarray):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        inside = hasher.table[raw] != 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        h, first = hasher.words(texts)
        self.raw, self.first = raw, first
        self.text = np.repeat(np.arange(len(texts)), np.diff(first))
        self.hash = mix(h + seeds[self.text]) if len(h) else h
        breaks = np.cumsum(np.isin(raw, np.frombuffer(ENDS, np.uint8)))
        self.piece = breaks[self.start] if len(h) else self.start

    def lower(self) -> np.ndarray:
        low = self.raw.copy()
        low[(low >= 65) & (low <= 90)] += 32
        return low


def lengthen(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of its last word."""
    return mix(h * np.uint64(0xD6E8FEB86659FD93) + last)


class Bitmap:
    """Which phrases are proposed: two bits for each, in ``2**bits`` bits."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def places(self, h: np.ndarray):
        shift = np.uint64(64 - self.bits)
        yield (h >> shift).astype(np.int64)
        yield (mix(h + np.uint64(0xA24BAED4963EE407)) >> shift).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.places(h):
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def known(sent) -> Bitmap | None:
    """The bitmap of a broadcast variable; only its array is sent, tasks build the rest."""
    return Bitmap(*sent.value) if sent else None


def levels(w: Words, old: Bitmap | None, new: Bitmap | None, proposed: int, upto: int):
    """Yield (length, places, hashes) of the phrases to count: those that ``new`` lets through and ``old`` did not.

    ``proposed`` is the greatest length the bitmaps know; longer phrases are let through by their parts alone.
    """
    h = w.hash
    here, before = np.arange(len(h)), np.zeros(len(h), bool) if old is None else np.ones(len(h), bool)
    yield 1, here[~before], h[~before]
    for m in range(2, upto + 1):
        # places whose phrase of m - 1 words is proposed (now, before)
        if m - 1 <= proposed and new is not None:
            ok = new.has(h)
            if old is not None:
                before = before[ok] & old.has(h[ok])
            else:
                before = before[ok]
            here, h = here[ok], h[ok]
        if not len(here):
            return
        follows = np.flatnonzero(here[1:] == here[:-1] + 1)  # the phrase one word on is proposed too
        end = here[follows] + m - 1
        follows = follows[w.piece[end] == w.piece[here[follows]]]
        before = before[follows] & before[follows + 1]
        h, here = lengthen(h[follows], w.hash[here[follows] + m - 1]), here[follows]
        yield m, here[~before], h[~before]


class Counter:
    """Counts of phrases with their words, merged by hash and length; bounded by BUFFER entries."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, h, n, lang, m, start, size, raw):
        """Entries whose words are ``raw[start:start + size]``; equal ones may repeat."""
        self.parts.append(merge(h, n, lang, m, start, size, raw))
        self.held += len(self.parts[-1][0])

    def shrink(self):
        if len(self.parts) > 1:
            cat = [np.concatenate([p[i] for p in self.parts]) for i in range(4)]
            shift = np.cumsum([0] + [len(p[6]) for p in self.parts[:-1]])
            start = np.concatenate([p[4] + s for p, s in zip(self.parts, shift)])
            size, raw = np.concatenate([p[5] for p in self.parts]), np.concatenate([p[6] for p in self.parts])
            self.parts = [merge(*cat, start, size, raw)]
            self.held = len(self.parts[0][0])

    def take(self):
        self.shrink()
        out, self.parts, self.held = self.parts, [], 0
        return out[0] if out else None


def merge(h, n, lang, m, start, size, raw):
    key = h ^ (size.astype(np.uint64) << np.uint64(48))
    order = np.argsort(key)
    s = key[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    one = order[at]
    start, size = start[one], size[one]
    upto = np.cumsum(size)
    words = np.empty(int(upto[-1]) if len(upto) else 0, np.uint8)
    for i in range(0, len(one), GATHER):  # positions take eight times the room of the bytes
        some = slice(i, i + GATHER)
        lo, hi = upto[i] - size[i], upto[some][-1]
        words[lo:hi] = raw[np.repeat(start[some] - (upto[some] - size[some]), size[some]) + np.arange(lo, hi)]
    return (h[one], np.add.reduceat(n[order], at, dtype=np.int64) if len(at) else n, lang[one], m[one], upto - size, size, words)


def counted(docs: DataFrame, old=None, new=None, proposed: int = 0, span: tuple[int, int] = (1, LONGEST), only=None) -> DataFrame:
    """(lang, m, phrase, n): exact counts of the phrases of ``span`` words that the bitmaps let through (and whose hash is
    in ``only``); m = 0 counts all words of a language.  ``old``, ``new`` and ``only`` are broadcast bitmaps (words, bits)."""
    x = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")

    def make():
        import pyarrow as pa

        hasher, counter = word_hasher(), Counter()
        a, b, wanted = known(old), known(new), known(only)
        names: dict[str, int] = {}

        def rows(entries, step=1 << 16):
            h, n, lang, m, start, size, raw = entries
            order = list(names)
            for i in range(0, len(h), step):
                part = slice(i, i + step)
                lo, hi = start[i], start[part][-1] + size[part][-1]
                offsets = np.concatenate([start[part] - lo, [hi - lo]]).astype(np.int32)
                words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw[lo:hi].tobytes()))
                yield {"lang": [order[k] for k in lang[part]], "m": m[part], "phrase": words, "n": n[part]}

        def run(batch):
            if batch is None:  # the task's last entries
                left = counter.take()
                yield from rows(left) if left is not None else ()
                return
            for i in range(0, batch.num_rows, ROWS):
                yield from some(batch.slice(i, ROWS))

        def some(batch):
            langs = [names.setdefault(v, len(names)) for v in batch.column(0).to_pylist()]
            for first, texts in pieces(batch.column(1).to_pylist()):
                of = np.array(langs[first:first + len(texts)], np.int32)
                w = Words(hasher, texts, seeds(list(names))[of])
                if not len(w.hash):
                    continue
                low, begin = normal(w)
                for m, at, h in levels(w, a, b, proposed, span[1]):
                    if wanted is not None:
                        ok = wanted.has(kept(h))
                        at, h = at[ok], h[ok]
                    if m < span[0] or not len(at):
                        continue
                    start = begin[at]
                    counter.add(h, np.ones(len(at), np.int32), of[w.text[at]], np.full(len(at), m, np.int8), start,
                                begin[at + m] - 1 - start, low)
                if a is None and span[0] == 1:
                    total = np.bincount(of[w.text], minlength=len(names))
                    k = np.flatnonzero(total)
                    counter.add(k.astype(np.uint64), total[k], k, np.zeros(len(k), np.int8), np.zeros(len(k), np.int64),
                                np.zeros(len(k), np.int64), np.zeros(0, np.uint8))
                if counter.held > BUFFER:
                    counter.shrink()
                    if counter.held > BUFFER // 2:
                        yield from rows(counter.take())

        return run

    parts = arrow_map(x, make, "lang string, m byte, phrase string, n long", last=True)
    # tasks have combined already: a second hash table before the shuffle would hold nearly every entry again
    return parts.repartition("lang", "m", "phrase").groupBy("lang", "m", "phrase").agg(F.sum("n").alias("n"))


def kept(h: np.ndarray) -> np.ndarray:
    """The hashes with all but their upper ``KEPT_BITS`` bits cleared."""
    shift = np.uint64(64 - KEPT_BITS)
    return h >> shift << shift


def shorten(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The numbers of every run ``x[first:end]`` in the fewest bytes each that hold the run's greatest."""
    b = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    most = np.maximum.reduceat(x, first)
    width = sum((most >= np.uint64(1 << 8 * i)).astype(int) for i in range(1, 8)) + 1
    return [b[lo:hi, :w].tobytes() for lo, hi, w in zip(first.tolist(), end.tolist(), width.tolist())]


def widen(raw: bytes, size: int) -> np.ndarray:
    """The ``size`` numbers of one run of ``shorten``."""
    out = np.zeros((size, 8), np.uint8)
    out[:, :len(raw) // size] = np.frombuffer(raw, np.uint8).reshape(size, -1)
    return out.view("<u8").ravel()


def added(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order with their total counts."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.add.reduceat(n, at)


def hashed(docs: DataFrame, new=None, proposed: int = 0, span: tuple[int, int] = (1, LONGEST), least: int = 1) -> DataFrame:
    """(h, n): the counts of ``counted`` by hash alone (``kept``), those of at least ``least``.  Different phrases of one
    hash are added together, so no count is too low.  A task passes on its hashes range by range, ascending, as the gaps
    between them, in about a third of the room of single rows; ranges are added up one after the other."""
    x = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    rest, low = np.uint64(64 - RANGE_BITS), np.uint64(64 - KEPT_BITS)

    def make():
        hasher, b = word_hasher(), known(new)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = [0]

        def shrink():
            held[:] = [added(*(np.concatenate([p[i] for p in held]) for i in range(2)))]
            size[0] = len(held[0][0])

        def take():
            h, n = held.pop()
            size[0] = 0
            part = h >> rest
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            end = np.append(first[1:], len(h))
            gaps = (h - (part << rest)) >> low
            gaps[1:] -= np.where(part[1:] == part[:-1], gaps[:-1], np.uint64(0))
            yield {"part": part[first].astype(np.int32), "size": (end - first).astype(np.int32),
                   "gaps": shorten(gaps, first, end), "counts": shorten(n.astype(np.uint64), first, end)}

        def run(batch):
            if batch is None:
                if held:
                    shrink()
                    yield from take()
                return
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                langs = part.column(0).to_pylist()
                names = sorted(set(langs))
                of = np.searchsorted(names, langs)
                for first, texts in pieces(part.column(1).to_pylist()):
                    w = Words(hasher, texts, seeds(names)[of[first:first + len(texts)]])
                    for m, _, h in levels(w, None, b, proposed, span[1]):
                        if m >= span[0] and len(h):
                            u, n = np.unique(kept(h), return_counts=True)
                            held.append((u, n))
                            size[0] += len(u)
                    if size[0] > HASHED:
                        shrink()
                        if size[0] > HASHED // 2:
                            yield from take()

        return run

    def merge_ranges():
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = [None]

        def total():
            h, n = added(*(np.concatenate([p[i] for p in held]) for i in range(2)))
            held.clear()
            ok = n >= least
            yield {"h": h[ok].view(np.int64), "n": n[ok]}

        def run(batch):
            for part, size, gaps, counts in zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else ():
                if part != now[0] and held:
                    yield from total()
                now[0] = part
                h = (np.cumsum(widen(gaps, size)) << low) + (np.uint64(part) << rest)
                held.append((h, widen(counts, size).view(np.int64)))
            if batch is None and held:
                yield from total()

        return run

    parts = arrow_map(x, make, "part int, size int, gaps binary, counts binary", last=True)
    parts = parts.repartition("part").sortWithinPartitions("part")
    return arrow_map(parts, merge_ranges, "h long, n long", last=True)


def decided(docs: DataFrame, least: int, old=None, new=None, proposed: int = 0, span: tuple[int, int] = (1, LONGEST)) -> DataFrame:
    """``counted`` phrases with n >= ``least``, and the words of each language (m = 0).  The first pass counts by hash; only
    phrases whose hash reaches ``least`` are counted again by their words, exactly."""
    only = None
    if old is None:
        often = written(hashed(docs, new, proposed, span, least).select("h"), "hashes")
        bits = size_bits(often.count())
        only = docs.sparkSession.sparkContext.broadcast((bitmap(often, bits), bits))
    return counted(docs, old, new, proposed, span, only).where((F.col("n") >= least) | (F.col("m") == 0))


def seeds(names: list[str]) -> np.ndarray:
    """One hash for each language, whatever its characters."""
    return np.array([int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") for t in names], np.uint64)


def normal(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words in lower case with one blank after each, and where each begins (the end is appended)."""
    size = w.end - w.start + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(w.start - upto[:-1], size) + np.arange(int(upto[-1]))
    out = w.lower()[np.minimum(place, len(w.raw) - 1)]
    out[upto[1:] - 1] = 32
    return out, upto


def phrase_hashes(hasher: Hasher, batch):
    """Yield (slice of the batch, phrases, hashes) of (lang, m, phrase) rows: the hashes that ``levels`` finds in texts."""
    langs, m = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    for first, texts in pieces(batch.column(2).to_pylist()):
        part = slice(first, first + len(texts))
        names = sorted(set(langs[part]))
        w = Words(hasher, texts, seeds(names)[np.searchsorted(names, langs[part])])
        at = w.first[:-1]
        h = w.hash[at]
        for k in range(1, LONGEST):
            more = np.flatnonzero(m[part] > k)
            h[more] = lengthen(h[more], w.hash[at[more] + k])
        yield part, texts, h


def bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """The bits of (lang, m, phrase) or (h) rows: or-ed in Spark, at most ``2**bits / 64`` rows come to the driver."""
    given = phrases.columns == ["h"]

    def make():
        hasher = word_hasher()

        def run(batch):
            for h in [batch.column(0).to_numpy().view(np.uint64)] if given else (x[2] for x in phrase_hashes(hasher, batch)):
                at = np.concatenate(list(Bitmap(None, bits).places(h)))
                word, back = np.unique(at >> 6, return_inverse=True)
                mask = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(mask, back, np.uint64(1) << (at & 63).astype(np.uint64))
                yield {"word": word, "mask": mask.view(np.int64)}

        return run

    masks = arrow_map(phrases if given else phrases.select("lang", "m", "phrase"), make, "word long, mask long")
    got = masks.groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    out = np.zeros((1 << bits) >> 6, np.uint64)
    out[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return out


def size_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, BITS_EACH * n)))))


def proposals(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """Phrases frequent in the sample under the lowered threshold: (lang, m, phrase)."""
    spark = docs.sparkSession
    x = docs.select("doc_id", "lang", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0)
    x = written(x, "sample")
    mean = least / sample
    low = max(2, math.floor(mean - MARGIN * math.sqrt(mean)))
    short = written(decided(x, low, span=(1, 2)).where("m > 0").drop("n"), "proposed")
    bits = size_bits(short.count())
    sent = spark.sparkContext.broadcast((bitmap(short, bits), bits))
    long = decided(x, low, new=sent, proposed=2, span=(3, LONGEST)).drop("n")
    return short.unionByName(written(long, "proposed"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """(lang, m, phrase, n) of every phrase with n >= ``least``, and m = 0: the words of each language."""
    spark = docs.sparkSession
    first = proposals(docs, least, sample)
    bits = size_bits(2 * first.count())
    old, new = None, spark.sparkContext.broadcast((bitmap(first, bits), bits))
    out = None
    while True:
        found = written(decided(docs, least, old, new, proposed=LONGEST), "counted")
        out = found if out is None else out.unionByName(found)
        failed = failures(found, new)
        if failed.isEmpty():
            return out
        more = new.value[0] | bitmap(failed, bits)
        old, new = new, spark.sparkContext.broadcast((more, bits))


def failures(found: DataFrame, new) -> DataFrame:
    """Frequent phrases of the border that had not been proposed (and could be part of longer ones)."""

    def make():
        hasher, proposed = word_hasher(), known(new)

        def run(batch):
            langs, m = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for part, texts, h in phrase_hashes(hasher, batch):
                miss = np.flatnonzero(~proposed.has(h))
                yield {"lang": [langs[part][i] for i in miss], "m": m[part][miss], "phrase": [texts[i].decode() for i in miss]}

        return run

    x = found.where(F.col("m").between(1, LONGEST - 1)).select("lang", "m", "phrase")
    return arrow_map(x, make, "lang string, m byte, phrase string")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    f = frequent_phrases(docs, least, sample)
    totals = f.where("m = 0").select("lang", F.col("n").alias("total"))
    f = f.where("m > 0")
    parts = F.split("phrase", " ")
    cut = f.where("m > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cut = cut.select("lang", "m", "phrase", F.col("n").alias("a"), "k",
                     F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("left"),
                     F.array_join(F.slice(parts, F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("right"))
    part = f.select("lang", F.col("phrase"), F.col("n"))
    cut = cut.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cut = cut.join(totals, "lang")
    dec = "decimal(19,0)"
    score = F.expr(f"(cast(a as {dec}) * cast(total as decimal(18,0)) * 1000bd) div (cast(l as {dec}) * cast(r as decimal(18,0)))")
    cut = written(cut.withColumn("score", score), "cuts")
    best = cut.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # one word less at either end, and as often
    inner = cut.where("m >= 3 and k = m - 1 and a >= l").select("lang", F.col("left").alias("phrase")).unionByName(
        cut.where("m >= 3 and k = 1 and a >= r").select("lang", F.col("right").alias("phrase"))).distinct()
    kept = best.join(inner, ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    x = kept.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("total").alias("n"),
                    F.col("b.score").alias("score"))
    x = x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return x.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
