"""Token ids of a corpus in ORC files: integer run-length encoding, stripes, row indexes and a Bloom filter.

Layout.  A folder of ORC files in ascending ``doc_id`` order: the rows of part 0 come before those of part 1, and so
on; a file holds one part, sorted.  Columns: ``doc_id``, ``part`` (number of the file), ``at`` (ids of the documents
before it in its part), ``n_tokens`` (its ids, with the end id) and ``ids``.  Integers are run-length encoded by ORC;
stripes of ``STRIPE`` bytes are the unit that readers take in parallel; the row index keeps least and greatest
``doc_id`` of every ``STRIDE`` rows, and a Bloom filter on ``doc_id`` prunes what lies between them, so a lookup of
a few documents reads only the row groups that may hold them (the filter is pushed to the scan).

Writing.  Narrow statistics give the number of parts (``PART_BYTES`` of text each, but enough for all cores); texts
are range-partitioned and sorted by (doc_id, hash of the text), so rows that share one id can be split too, and encoded
inside the sorted tasks.  No count has to be known before the files are written: the global position of a document is
the total of the earlier parts, read back as one row per file, plus ``at``.

Encoding is that of the tokenizers library on whole texts.  For byte-level BPE, whose pattern begins a new
piece at every space that a non-space follows, the text is cut there first and every distinct cut of a task is
encoded once; texts with a special token's string, and other kinds of tokenizers, go to the library whole.

Cases: null and empty texts have the end id alone; null ids come first; rows with equal ids are ordered by the hash of
their text (equal rows are interchangeable); an empty table gives an empty folder and no rows; very long texts are
encoded whole; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import math
import re
import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseries.llm.tables import arrow_map
from sparkseries.session import scratch_path

END_ID = 0
PART_BYTES, LEAST_PART_BYTES = 256 << 20, 4 << 20
STRIPE, STRIDE, BLOOM_FPP = 16 << 20, 1000, 0.01
#: Distinct cuts of text a task remembers at a time, and characters encoded together.
REMEMBERED, TOGETHER = 700_000, 1 << 20
# Cuts are kept without the space they begin with; those that begin without one are marked by BARE, or begin with a line break.
BARE = "\r"
BARE_STARTS = ("", "\r", "\n")
CUT = re.compile(r"(?= \S)").split
#: One word of letters in any Unicode version.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z").match
#: A letter and the marks behind it at the end of a cut (not the apostrophe, which may begin a contraction).
MARKED = re.compile(r"([^\n]*[A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~]+)\Z").match
SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"


def byte_letters() -> list[str]:
    """The letter by which byte-level models know each byte: printable ones of Latin-1 stand for themselves, the others
    are numbered from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def whole(cut: str) -> str:
    """The text of a kept cut."""
    return cut[1:] if cut[:1] == BARE else cut if cut[:1] == "\n" else " " + cut


class Encoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, tokenizer_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = (spec["model"].get("type", "BPE") == "BPE" and not spec.get("normalizer") and not spec["model"].get("dropout")
                     and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True))
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda t: None
        self.forget()

    def forget(self):
        """``known`` maps a cut to its number, ``start[number]`` is where its ids begin in ``flat``."""
        self.known: dict[str, int] = {}
        self.flat, self.start, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0

    def _keep(self, cuts: list[str], ids: np.ndarray, size: np.ndarray):
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(cuts) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[n + 1:n + 1 + len(cuts)] = self.used + np.cumsum(size)
        self.used += len(ids)
        self.known.update(zip(cuts, range(n, n + len(cuts))))

    def _gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered cuts one after the other, how many of them end with each cut)."""
        size = self.start[index + 1] - self.start[index]
        upto = np.cumsum(size)
        return self.flat[np.repeat(self.start[index] - (upto - size), size) + np.arange(int(size.sum()))], upto

    def _ask(self, cuts: list[str], together: int = 1024):
        """Have the library encode new cuts: one plain word is one piece and goes to the model, others take the whole way."""
        plain, rest = [], []
        for c in cuts:
            (plain if PLAIN(c) else rest).append(c)
        if plain:
            tokenize, letters = self.library.model.tokenize, byte_letters()
            space, table = letters[32], {c: "".join(letters[b] for b in chr(c).encode()) for c in range(192, 256)}
            ids = [[t.id for t in tokenize(space + (c if c.isascii() else c.translate(table)))] for c in plain]
            self._keep(plain, np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids]))
        for i in range(0, len(rest), together):
            part = rest[i:i + together]
            e = self.library.encode([whole(c) for c in part], is_pretokenized=True, add_special_tokens=False)
            self._keep(part, np.array(e.ids, np.int32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))

    def learn(self, cuts: set[str]):
        """Remember new cuts; a word and the marks behind it (a letter before a mark always ends a piece) are two cuts."""
        ends = [(c, c[:k], BARE + c[k:]) for c in cuts if (m := MARKED(c)) and (k := m.start(2))]
        asked = cuts.difference(c for c, _, _ in ends)
        asked.update(x for _, *two in ends for x in two)
        self._ask(list(asked.difference(self.known)))
        if ends:
            at = np.array([(self.known[a], self.known[b]) for _, a, b in ends], np.int64)
            ids, upto = self._gather(at.ravel())
            self._keep([c for c, _, _ in ends], ids, np.diff(upto[1::2], prepend=0))

    def cut(self, text: str) -> list[str]:
        """Parts of a text at whose borders a piece always begins: at a space before a non-space; where every white
        space is a single space or line break, at all of them."""
        if " ".join(text.split()) == text.replace("\n", " "):
            return (BARE + text.replace("\n", " \n")).split(" ")
        return [c[1:] if c[:1] == " " and c[1:2] not in BARE_STARTS else BARE + c for c in CUT(text) if c]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        if not self.cuts or any(map(self.special, texts)):  # some texts at a time
            ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)
        if len(self.known) > REMEMBERED:
            self.forget()
        parts = [self.cut(t) for t in texts]
        cuts = [c for p in parts for c in p]
        index = np.fromiter(map(self.known.get, cuts, repeat(-1)), np.int64, len(cuts))
        miss = np.flatnonzero(index < 0)
        if len(miss):
            new = [cuts[i] for i in miss]
            self.learn(set(new))
            index[miss] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        ids, upto = self._gather(index)
        ends = np.cumsum([len(p) for p in parts])
        return ids, np.diff(np.concatenate([[0], upto])[np.concatenate([[0], ends])])


def together(texts, limit: int = TOGETHER):
    """Yield (first index, texts) with about ``limit`` characters each; null is empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = (t.as_py() if hasattr(t, "as_py") else t) or ""
        if held and size + len(t) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, part_bytes: int = PART_BYTES,
                      end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) into ORC files under ``path``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes),
                min(math.ceil(size / LEAST_PART_BYTES), 4 * spark.sparkContext.defaultParallelism))
    order = ["doc_id", "__h"]
    x = docs.select("doc_id", "text").withColumn("__h", F.xxhash64("text"))
    x = x.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__h")

    def make():
        from pyspark import TaskContext

        encoder, part, at = Encoder(tokenizer_path), TaskContext.get().partitionId(), 0

        def run(batch):
            nonlocal at
            import pyarrow as pa

            doc_ids = batch.column(0)
            for first, texts in together(batch.column(1)):
                gc.disable()  # no cycles here, and a million small objects to look through for them
                try:
                    ids, n = encoder.encode(texts)
                finally:
                    gc.enable()
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                upto = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pa.array(ids, pa.int32()))
                yield {"doc_id": doc_ids.slice(first, len(texts)), "part": np.full(len(n), part, np.int32),
                       "at": at + upto - n, "n_tokens": n, "ids": lists}
                at += int(upto[-1])

        return run

    (arrow_map(x, make, SCHEMA).write.option("compression", "zstd")
     .option("orc.stripe.size", STRIPE).option("orc.create.index", "true").option("orc.row.index.stride", STRIDE)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP).orc(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on ``doc_id`` reach row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def part_starts(files: DataFrame) -> np.ndarray:
    """Ids before each part: one row per file comes to the driver."""
    rows = files.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n")).collect()
    totals = np.zeros(max([r["part"] for r in rows], default=-1) + 2, np.int64)
    for r in rows:
        totals[r["part"] + 1] = r["n"]
    return np.cumsum(totals)


def positions(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the checksum of its ids as little-endian 32-bit."""
    starts = part_starts(files.select("part", "at", "n_tokens"))

    def make():
        def run(batch):
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            n = batch.column("n_tokens").to_numpy()
            end = np.cumsum(lists.value_lengths().to_numpy()).tolist()
            crc = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip([0, *end[:-1]], end)]
            yield {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_crc32": crc,
                   "start": starts[batch.column("part").to_numpy()] + batch.column("at").to_numpy()}

        return run

    return arrow_map(files, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the corpus to a fresh folder of the shared directory and describe every document from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens-orc")
    write_token_files(docs, tokenizer_path, path)
    return positions(read_token_files(spark, path))
