"""Token files, phrase mining and ranked search against plain versions, on small tables with odd cases."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.llm import lexical, orc_tokens, phrases
from sparkseries.llm.oracle import SQL
from sparkseries.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, part string, score string, rank int, n int"


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "é", "don't", "x1", "of", "of", "the", "the", "the", "zeta-eta"]
    texts = [None, "", "...", "the\x00the", "<|endoftext|> of the", "  of \t the\r\n\n", "a" * 5000, "the " * 3000]
    texts += [prose(rng, words, rng.randint(1, 60)) for _ in range(120)]
    texts += [texts[20]] * 30  # a hot group of copies
    rows = [(i, t, [None, "en", "de", "und"][i % 4], "p", "s", i, 1) for i, t in enumerate(texts)]
    rows += [(None, "the of gamma", "en", None, None, None, None), (3, "the\x00the", "und", None, None, None, None)]
    rows += [(3, "the\x00the", "und", None, None, None, None), (40, "of another text", None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


# token files

def test_cut_encoding_is_that_of_the_library():
    from tokenizers import Tokenizer

    encoder, library = orc_tokens.Encoder(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert encoder.cuts
    rng = random.Random(3)
    pool = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "\x85", "\x1c", " ", "　", "don't", "'s", "<|endoftext|>", "naïve", "½",
            "12", "日本", "\x00", "😀", "​", "﻿", "word", ".", "!!", "́", "Ᲊ", "Ɤ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + ["x" * 200_000, " y" * 50_000]
    ids, n = encoder.encode(texts)
    for text, part in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert part.tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_cut_encoding_every_code_point():
    from tokenizers import Tokenizer

    encoder, library = orc_tokens.Encoder(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    points = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x30000)]]
    texts = ["".join(f"a {c}{c} b{c} {c}1" for c in points[i:i + 400]) for i in range(0, len(points), 400)]
    ids, n = encoder.encode(texts)
    want = [i for e in library.encode_batch(texts, add_special_tokens=False) for i in e.ids]
    assert ids.tolist() == want and n.sum() == len(want)


def test_whole_texts_go_to_other_tokenizers():
    from tokenizers import Tokenizer

    encoder, library = orc_tokens.Encoder(vocabulary("word_bpe_49k.json")), Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids, _ = encoder.encode(["Two  words here", "ÀB c"])
    assert ids.tolist() == [i for t in ("Two  words here", "ÀB c") for i in library.encode(t, add_special_tokens=False).ids]


def test_token_files(spark, docs, none, corpus, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    path = str(tmp_path / "orc")
    orc_tokens.write_token_files(docs, vocabulary("byte_bpe_50k.json"), path, part_bytes=8000)
    files = orc_tokens.read_token_files(spark, path)
    assert files.select("part").distinct().count() > 3
    got = [tuple(r) for r in orc_tokens.positions(files).orderBy("start").collect()]
    text, at = {}, 0
    for i, t, *_ in corpus:
        text.setdefault(i, []).append(t or "")
    assert [g[0] for g in got] == sorted((r[0] for r in corpus), key=lambda i: (i is not None, i or 0))
    for doc_id, start, n, crc in got:
        hits = []
        for t in text[doc_id]:
            ids = library.encode(t, add_special_tokens=False).ids + [orc_tokens.END_ID]
            hits.append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert (start, n, crc) in hits
        at += n
    empty = orc_tokens.token_file_digests(none, vocabulary("byte_bpe_50k.json"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_token_file_layout(spark, docs, tmp_path):
    from pyarrow import orc

    path = str(tmp_path / "orc")
    orc_tokens.write_token_files(docs, vocabulary("byte_bpe_50k.json"), path, part_bytes=8000)
    files = orc_tokens.read_token_files(spark, path)
    wanted = files.where("doc_id = 21")
    assert "EqualTo(doc_id,21)" in wanted._jdf.queryExecution().toString() and wanted.count() == 1
    some = sorted((tmp_path / "orc").glob("*.orc"))
    f = orc.ORCFile(str(some[0]))
    assert f.nrows and f.row_index_stride == orc_tokens.STRIDE and f.compression == "ZSTD"


# phrases

def plain_collocations(rows, least, top):
    counts, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[i:i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    often = {k: n for k, n in counts.items() if n >= least}
    out = []
    for (lang, p), a in often.items():
        if len(p) < 2 or any(n >= a and len(q) > len(p) and lang == g and any(
                q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), n in often.items()):
            continue
        cuts = [(1000 * a * total[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, often[lang, p[:k]], often[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


@pytest.mark.parametrize("least,top,sample", [(5, 2000, 2), (5, 7, 10_000_000), (30, 50, 1)])
def test_collocations(docs, none, corpus, least, top, sample):
    """With one document in ten million as the sample nothing is proposed, so all is found by expansion."""
    got = phrases.collocations(docs, least, top, sample)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(corpus, least, top)
    if top == 7:
        assert phrases.collocations(none, least, top, sample).count() == 0


def test_small_buffers_and_full_bitmaps(docs, corpus, monkeypatch):
    monkeypatch.setattr(phrases, "BUFFER", 50)
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    monkeypatch.setattr(phrases, "MOST_BITS", 6)  # 64 bits: nearly everything looks proposed
    got = phrases.collocations(docs, 6, 2000, 3)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(corpus, 6, 2000)


@pytest.mark.parametrize("buffer", [300, 3_000_000])
def test_hashes_leave_tasks_packed(docs, corpus, monkeypatch, buffer):
    """The counts by hash are those of the phrases; a task passes on ranges of hashes, not one row for each."""
    monkeypatch.setattr(phrases, "HASHED", buffer)
    counts = Counter()
    for _, text, lang, *_ in corpus:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts.update((lang or "und", tuple(w[i:i + m])) for m in (1, 2) for i in range(len(w) - m + 1))
    h, n = zip(*phrases.hashed(docs, span=(1, 2)).collect())
    assert len(set(h)) == len(h) and sorted(n) == sorted(counts.values())
    assert all(x % (1 << 64 - phrases.KEPT_BITS) == 0 for x in h)
    often = phrases.hashed(docs, span=(1, 2), least=9).collect()
    assert sorted(often) == sorted((a, b) for a, b in zip(h, n) if b >= 9)
    rng = np.random.default_rng(1)
    h = phrases.kept(np.unique(rng.integers(0, 1 << 64, 300_000, np.uint64)))
    part = h >> np.uint64(64 - phrases.RANGE_BITS)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    gaps = (h >> np.uint64(64 - phrases.KEPT_BITS)) % np.uint64(1 << phrases.KEPT_BITS - phrases.RANGE_BITS)
    gaps[1:] -= np.where(part[1:] == part[:-1], gaps[:-1], np.uint64(0))
    end = np.append(first[1:], len(h))
    packed = phrases.shorten(gaps, first, end)
    assert sum(map(len, packed)) < 4 * len(h)
    assert all((phrases.widen(b, int(hi - lo)) == gaps[lo:hi]).all() for b, lo, hi in zip(packed, first, end))
    odd = np.array([0, 255, 256, 1 << 40, (1 << 64) - 1, 7], np.uint64)
    for b, x in zip(phrases.shorten(odd, np.array([0, 2, 3, 5]), np.array([2, 3, 5, 6])), np.split(odd, [2, 3, 5])):
        assert phrases.widen(b, len(x)).tolist() == x.tolist()


def test_words_before_any_marks_are_encoded_alone():
    """The library sees a word and its marks once each, whatever marks (but apostrophes) stand behind it."""
    from tokenizers import Tokenizer

    encoder, library = orc_tokens.Encoder(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    marks = [m for m in map(chr, range(33, 127)) if not m.isalnum()]
    texts = [f"{w}{m} {w}{m}{m}.{m} it's{m} {w}'{m} {w}{m}s {w}{m}'s \n{w}{m}" for w in ("abcqxz", "schönqxé", "q1é") for m in marks]
    ids, n = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [
        library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.forget()
    encoder.encode(["x plain*** größé_$"])
    assert {"plain", "plain***", "größé", orc_tokens.BARE + "***", orc_tokens.BARE + "_$"} <= set(encoder.known)


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    row = spark.sql(f"select cast({big} as decimal(19,0)) * cast({big * 10} as decimal(18,0)) * 1000bd "
                    f"div (cast({big} as decimal(19,0)) * cast({big + 1} as decimal(18,0))) as s").first()
    assert row.s == 1000 * big * big * 10 // (big * (big + 1))


def test_words_longer_than_a_piece():
    hasher = phrases.word_hasher()
    long = b"a" * ((1 << 21) + 5)
    h, first = hasher.words([b"x " + long + b" y " + long, long])
    assert first.tolist() == [0, 4, 5] and h[1] == h[3] == h[4]


# ranked search

def plain_ranked(rows, items, k=10):
    terms = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
                       for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    texts = [(i, Counter(terms(t))) for i, t, *_ in rows]
    texts = [(i, c) for i, c in texts if c]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        hits = []
        for doc_id, c in texts:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                hits.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, h[3], -h[0]) for r, h in enumerate(sorted(hits)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "the gamma of Alpha alpha"), (2, None), (3, ""), (4, "unknownword"), (5, "é"), (6, "don't x1 x1 zeta"), (7, "the the"),
         (1, "beta"), (None, "another gamma")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in ITEMS], "item_id long, text string, score int, rank int")


@pytest.mark.parametrize("part_bytes", [1 << 20, 20])
def test_ranked(docs, none, items, corpus, part_bytes):
    got = lexical.ranked(docs, items, part_bytes=part_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_ranked(corpus, ITEMS)
    if part_bytes > 20:
        assert lexical.ranked(none, items).count() == 0 and lexical.ranked(docs, items.where("item_id > 99")).count() == 0


def test_tree_search_is_exact_and_cuts():
    """Random blocks, tiny leaves: equal to scoring all documents, while most documents are never scored."""
    rng = np.random.default_rng(5)
    n, vocabulary = 3000, 400
    rows = [np.unique((vocabulary * rng.random(rng.integers(1, 30)) ** 0.5).astype(int)) for _ in range(n)]
    rows[500:900] = [rows[3]] * 400
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    term, tf = np.concatenate(rows), rng.integers(1, 5, sum(map(len, rows)))
    m, ids = rng.integers(25, 300, n), rng.permutation(n)
    tree = lexical.Tree(ids, m, doc, term, tf, vocabulary, leaf=4)
    scored = []
    plain_scores = lexical.Tree.scores
    for q in range(40):
        terms = np.unique(rng.integers(0, vocabulary, 12))
        weight = (9000 - 20 * terms).astype(np.int64)
        tree.scores = lambda d, t, w: scored.append(len(d)) or plain_scores(tree, d, t, w)
        got = tree.search(terms, weight, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
        s = plain_scores(tree, np.arange(n), terms, weight)
        best = np.lexsort((tree.ids, -s))[:10]
        best = best[s[best] > 0]
        assert got[0].tolist() == s[best].tolist() and got[1].tolist() == tree.ids[best].tolist()
    assert sum(scored) < 0.5 * 40 * n


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
