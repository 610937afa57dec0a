"""The dealt operators against plain versions, on small tables with nulls, empty texts, ties and repeats."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.llm import bpe, chat, decontaminate, langid, licenses, near_dedup, queries, sharding, token_counts, topk, toxicity
from sparkseries.llm.queries import vocabulary, word_pattern

BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix green potions behind an old barn"
TEXTS = [None, "", "...", BASE, BASE, BASE + " today", "Don't STOP now <|endoftext|> 12 naïve ½ \x00\x01",
         "x" * 5000, BASE.upper().replace(" ", "\n"), "MIT License and mit-license, CC BY-NC 4.0", "a b c d"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(None, BASE, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_near_duplicates(docs, none):
    got = rows(near_dedup.near_duplicates(docs))

    def bag(t):
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, min(1, len(w)))))

    for i, a in enumerate(TEXTS):
        for j, b in enumerate(TEXTS):
            if a is None or b is None:
                continue
            x, y = bag(a), bag(b)
            both = sum((x & y).values())
            alike = a == b or (both and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both))
            assert (got[i]["class_id"] == got[j]["class_id"]) == bool(alike), (i, j)
    assert got[None]["class_id"] == 3 and got[0]["class_id"] == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["class_id"] for r in got.values()})
    assert near_dedup.near_duplicates(none).count() == 0
    clash = docs.withColumn("__n", F.lit(7)).withColumn("__id", F.lit(1)).withColumn("__node", F.lit("x"))
    kept = near_dedup.keep_one(clash)
    assert kept.columns == clash.columns and {r["__n"] for r in kept.collect()} == {7}


def test_near_duplicates_of_a_large_bucket(spark, monkeypatch):
    """Hundreds of texts share buckets, at similarities from 0.3 to 1, over several blocks and rounds."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    rng = np.random.default_rng(3)
    texts = []
    for family in range(2):
        words = [f"w{family}x{i}" for i in range(120)]
        for _ in range(240):
            w = list(words)
            for at in rng.integers(0, 120, rng.integers(0, 9)):
                w[at] = f"z{rng.integers(0, 10 ** 9)}"
            texts.append(" ".join(w))
    texts += [" ".join(words * 30)] * 2 + [" ".join(words * 30 + ["end"])]
    got = rows(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)))
    bags = []
    for t in texts:
        w = t.split()
        bags.append(Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)))
    label = list(range(len(texts)))
    for i, x in enumerate(bags):
        for j in range(i):
            both = sum((x & bags[j]).values()) if label[i] != label[j] else 0
            if both and both >= 0.8 * (sum(x.values()) + sum(bags[j].values()) - both):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if c == hi else c for c in label]
    assert len(set(label)) > 20 and max(Counter(label).values()) > 50
    assert [got[i]["class_id"] for i in range(len(texts))] == label


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    key = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    sig = near_dedup.signatures(np.repeat([0, 1], 60), np.tile(key, 2), np.concatenate([a, b]), 2, 8192)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def test_codes_far_below_expectation_do_not_lose_a_link(spark):
    def member(node, differing):
        bits = np.zeros(near_dedup.M, np.uint64)
        bits[:differing] = 1
        shift = np.arange(0, 64, 2, dtype=np.uint64)
        c = np.bitwise_or.reduce(bits.reshape(-1, 32) << shift, axis=1).view(np.int64).tolist()
        return (0, 7, bytearray(node), bytearray(node), 100, [7] + [node[0] * 100 + i for i in range(1, near_dedup.BANDS)], *c)

    q, p, m = 0.15, 0.85, near_dedup.M  # at a similarity of 0.8 a component's code differs with probability 0.15
    five = int(m * q + 5 * np.sqrt(m * q * p))
    rows_ = [member(b"a", 0), member(b"b", five)]
    members = spark.createDataFrame(rows_, "band int, key int, node binary, label binary, size long, keys array<int>, "
                                    + ", ".join(f"c{i} long" for i in range(near_dedup.CODES)))
    assert near_dedup.candidates(members, F.lit(True), 0.8).count() == 1


def test_bpe_equals_the_tokenizers_library(docs, none):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    full, digest = rows(bpe.encode_documents(docs, path)), rows(bpe.encode_digests(docs, path))
    for i, text in enumerate(TEXTS):
        e = t.encode(text or "", add_special_tokens=False)
        ids, back = " ".join(map(str, e.ids)), t.decode(e.ids, skip_special_tokens=False)
        assert (full[i]["ids"], full[i]["decoded"], full[i]["n_tokens"]) == (ids, back, len(e.ids))
        assert digest[i]["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encode_digests(none, path).count() == 0


def test_language(spark, docs, none):
    de, en = "der hund und die katze schlafen nicht auf dem stuhl ", "the dog and the cat do not sleep on that chair "
    many = spark.createDataFrame([(i, (de if i % 2 else en) * (1 + i % 3), "de" if i % 2 else "en") for i in range(60)]
                                 + [(100, None, "en"), (101, "!!! 12", "de"), (None, en, "en")], "doc_id long, text string, lang string")
    got = rows(langid.identify(many))
    assert all(got[i]["lang_pred"] == ("de" if i % 2 else "en") and 0 <= got[i]["score"] <= 1 for i in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[None]["lang_pred"] == "en"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(60))
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).replace("", None, ["lang"])).collect()} == {"und"}


def test_language_stage(spark):
    rng = np.random.default_rng(0)
    odd = [" ".join("".join(rng.choice(list(alphabet), rng.integers(2, 9))) for _ in range(60))
           for alphabet in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрст", "αβγδεζηθικ")] + ["漢字仮名" * 20, "12 !!", "", None]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    extra = spark.createDataFrame([(-1 - i, None, t) for i, t in enumerate(odd)], "doc_id long, lang string, text string")
    many = given.unionByName(extra)
    ids = sorted(r["doc_id"] for r in given.collect())
    kept = queries.keep_identified(spark, many, None)
    assert kept.columns == many.columns and sorted(r["doc_id"] for r in kept.collect()) == ids
    none = many.withColumn("lang", F.lit(None).cast("string"))  # nothing to learn: whatever has a letter stays
    assert sorted(r["doc_id"] for r in queries.keep_identified(spark, none, None).collect()) == [-4, -3, -2, -1, *ids]


def test_stages_keep_columns_with_any_name(spark):
    item = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate([BASE, item, BASE + " a", BASE + " b"] * 9)],
                               "doc_id long, text string, lang string")
    for name in ("__text", "___text", "__lang", "__score", "__SCORE_", "margin"):
        df = df.withColumn(name, F.lit(7))
    kept = decontaminate.clean_rows(df, bench)
    assert kept.columns == df.columns and kept.count() == 27 and {r["__text"] for r in kept.collect()} == {7}
    assert queries.free(df, "__text") == "____text" and queries.free(df, "__Score") == "___Score"
    kept = queries.keep_identified(spark, df, None)
    assert kept.columns == df.columns and {(r["__text"], r["__lang"], r["__score"]) for r in kept.collect()} <= {(7, 7, 7)}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, rule):
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=word_pattern(), mergeable_ranks=token_counts.load_ranks(path), special_tokens={})
    got = token_counts.section_token_counts(docs, path, word_pattern(), rule).where("doc_id is not null").collect()
    for i, text in enumerate(TEXTS):
        mine = [r for r in got if r["doc_id"] == i]
        ids = enc.encode_ordinary(text or "")
        assert abs(sum(r["n_tokens"] for r in mine) - len(ids)) < 1e-9
        assert "".join((text or "")[r["start_char"]:r["end_char"]] for r in sorted(mine, key=lambda r: r["section"])) == (text or "")
        if rule == "start":
            at, want = 0, Counter()
            for t in ids:
                want[(text[:len(text.encode()[:at].decode("utf-8", "ignore"))]).count("\n")] += 1
                at += len(enc.decode_single_token_bytes(t))
            assert {r["section"]: r["n_tokens"] for r in mine if r["n_tokens"]} == want


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(700, 6)).round(2)
    v[300:400] = v[0]  # one very common vector
    data = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(800, None), (850, [1.0, None]), (900, [float("nan")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    q = np.floor(256 * v).astype(np.int64)
    for i in range(0, 700, 50):
        s = q @ q[i]
        best = sorted((-s[j], j) for j in range(700) if j != i)[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i)
        assert mine == [(k + 1, j, -x) for k, (x, j) in enumerate(best)]
    assert len(got) == 14 * 5
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_top_k_with_repeated_ids(spark, same):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 6)).round(2)
    ids = np.arange(400) % 150  # each id two or three times
    if same:
        v = v[ids]
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    q = np.floor(256 * v).astype(np.int64)
    s = q @ q.T
    for i in range(0, 150, 50):
        best = sorted((-s[np.ix_(ids == i, ids == j)].max(), j) for j in range(150) if j != i)[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i)
        assert mine == [(k + 1, j, -x) for k, (x, j) in enumerate(best)]
    assert len(got) == 3 * 5


def test_chat_round_trip(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "</s>[INST]"), (2, 5, None, "a</s>"),
            (2, 6, "[/INST]", "<\\/s> <\\\\s>[\\INST] <s>"), (3, 0, "assistant", "é😀"), (None, None, "user", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = rows(chat.chat_digest(chat.trap(df)), "conv_id")
    full = rows(chat.format_chats(chat.trap(df)), "conv_id")
    assert all(r["round_trip"] for r in out.values()) and len(out) == 5
    assert len({r["formatted"] for r in full.values()}) == 5 and full[3]["formatted"] == "[INST]assistant[/INST]é😀</s>"
    said = "user\nhi\nassistant\n\nassistant\n</s>[INST]\n"
    assert out[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and out[1]["n_turns"] == 3
    assert out[-7]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() and out[-7]["loss_chars"] == 21
    assert out[3]["loss_chars"] == 2 and out[2]["loss_chars"] == 0


def test_decontamination(spark):
    item = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(1, item), (2, "is it so? " + BASE), (3, None), (4, "")], "item_id long, text string")
    edited = item.replace("w7 ", "v7 ").replace("w30 ", "v30 ")
    filler = " ".join(f"z{i}" for i in range(300))
    texts = [filler + " " + item + " " + filler, edited, BASE, filler, None, "", " ".join(f"w{i}" for i in range(10)), item]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(0, 1), (1, 1), (7, 1)}
    parts = decontaminate.contaminated(df, bench, part_bytes=64).select("doc_id", "item_id").collect()
    assert {tuple(r) for r in parts} == got
    kept = decontaminate.clean_rows(df, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 6] and kept.columns == df.columns
    assert decontaminate.contaminated(df, bench.where("item_id < 0")).count() == 0


def test_decontamination_in_parts_gives_the_same_rows(spark):
    rng = np.random.default_rng(4)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 60, n)) for n in (8, 12, 20, 35, 50, 90)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [" ".join(f"z{x}" for x in rng.integers(0, 99, n)) + " " + t + " " + " ".join(f"w{x}" for x in rng.integers(0, 60, 200))
             for t in items for n in (3, 37, 160)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda size: sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["question_overlap"], r["answer_overlap"],
                                 r["first_word"]) for r in decontaminate.contaminated(df, bench, part_bytes=size).collect())
    assert found(1 << 20) == found(256) == found(64) != []
    kept = lambda size: sorted(r["doc_id"] for r in decontaminate.clean_rows(df, bench, part_bytes=size).collect())
    assert kept(1 << 20) == kept(64)


def test_decontamination_against_a_plain_bm25(spark):
    rng = np.random.default_rng(6)
    items = [[f"w{x}" for x in rng.integers(0, 40, n)] for n in (9, 14, 14, 20, 26, 30)]
    texts = []
    for w in items:
        for changed in (0, 0.15, 0.3, 0.5):
            edited = [f"w{rng.integers(0, 40)}" if rng.random() < changed else x for x in w]
            texts.append([f"z{x}" for x in rng.integers(0, 9, rng.integers(0, 50))] + edited + [f"w{x}" for x in rng.integers(0, 40, 15)])
    df = {t: sum(t in w for w in items) for w in items for t in w}
    mean, stride = np.mean([len(w) for w in items]), max(map(len, items))

    def impact(t, w):
        idf = np.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5))
        return idf * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))

    def share(part, passage):
        pairs = set(zip(part, part[1:])) if len(part) > 1 else set(part)
        return len(pairs & (set(zip(passage, passage[1:])) if len(part) > 1 else set(passage))) / len(pairs)

    want = {}
    for d, text in enumerate(texts):
        for i, w in enumerate(items):
            asked = len(w) - max(1, len(w) // 4)
            for lo in range(0, len(text), stride):
                here = text[lo:lo + 2 * stride]
                score = sum(impact(t, w) for t in set(w) & set(here)) / sum(impact(t, w) for t in set(w))
                if score >= 0.6 and share(w[:asked], here) >= 0.5 and share(w[asked:], here) >= 0.5:
                    want[d, i] = max(want.get((d, i), 0), score)
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], f"{name} long, text string")
    got = decontaminate.contaminated(frame(texts, "doc_id"), frame(items, "item_id")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want) and len(got) == len(want) > 6
    assert all(abs(r["score"] - want[r["doc_id"], r["item_id"]]) < 1e-9 for r in got)


def test_toxicity(spark, docs):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("bdgklmnprst"), 2)[i] + rng.choice(list("aeiou")) for i in range(2)) for _ in range(300)]
    data, labels = [], []
    for i in range(600):
        t = list(rng.choice(words, 30))
        if i % 4 == 0:
            t[5:5] = list(rng.choice(["zwyrx", "quozhj"], 2))
        data.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    df = spark.createDataFrame(data + [(700, None), (701, ""), (None, "zwyrx")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(700, None)], "doc_id long, toxic int")
    got = rows(toxicity.classify(df, lab))
    held = [i for i in range(600) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.97
    assert got[700]["predicted"] == got[701]["predicted"] == 0 and got[None]["predicted"] == 1
    assert {r["score"] for r in toxicity.classify(docs.select("doc_id", "text"), lab.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_fit_holds_no_copies():
    """Beside its matrix the fit on the driver holds only blocks of rows, and finds the least loss."""
    import tracemalloc

    rng = np.random.default_rng(5)
    z, weight = rng.normal(size=(12_000, 64)), rng.uniform(0.5, 2, 12_000)
    y = np.sign(z[:, 0] + 0.5 * z[:, 1] + rng.normal(size=12_000))
    tracemalloc.start()
    w = toxicity.squared_hinge(z, y, weight, reg=1.0)
    most = tracemalloc.get_traced_memory()[1]
    names = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 12)) for _ in range(400)]
    kernel = toxicity.Kernel(toxicity.Words())
    tracemalloc.stop()
    assert most < 0.5 * z.nbytes
    x = np.hstack([z, np.ones((len(z), 1))])
    gap = np.maximum(0, 1 - y * (x @ w))
    slope = np.append(np.ones(64), 1e-6) * w - x.T @ (weight * gap * y)
    assert np.abs(slope).max() < 1e-3
    m, _ = kernel.dense(names)
    assert m.shape[1] > toxicity.COLUMNS and np.allclose(kernel.gram(names), m @ m.T, atol=1e-5)


def test_texts_of_a_batch_are_read_group_by_group(monkeypatch):
    """A task never holds all texts of an Arrow batch as Python's."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from sparkseries.llm.text import pieces

    words = [c * 100 for c in "abcdefg"]
    texts = [None, "", *(" ".join(words[(i + k) % 7] for k in range(100)) for i in range(3000))]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    monkeypatch.setattr(bpe, "arrow_map", lambda df, make, schema: make)
    encode = bpe.encode_digests(SimpleNamespace(select=lambda *names: None), vocabulary("word_bpe_49k.json"))()
    first = lambda groups: next(iter(groups))
    for run in (encode, lambda b: toxicity.Words().groups(b.column(1)), lambda b: pieces(b.column(1))):
        tracemalloc.start()
        first(run(batch))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < batch.nbytes / 2
    assert [t for _, part in pieces(batch.column(1)) for t in part] == [(t or "").encode() for t in texts]
    held = [(i, t) for at, part in toxicity.Words().groups(batch.column(1)) for i, t in zip(at, part)]
    assert held == [(i, t or "") for i, t in enumerate(texts)]


def test_stages_send_a_text_once_and_return_slices(spark, tmp_path):
    """Language, toxicity and decontamination send each text to the tasks once; rows come back in slices of the batch."""
    import pyarrow as pa

    from sparkseries.llm.tables import slices

    rows = [("s", t, i) for i, t in enumerate([*TEXTS, "what is the tallest mountain? it is mount everest by far"])]
    spark.createDataFrame(rows, "source string, text string, doc_id long").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    benchmark = spark.createDataFrame([(1, "what is the tallest mountain? it is mount everest")], "item_id long, text string")
    model = {"used": np.array([1]), "beta": np.ones(1, np.float32), "bias": -1.0, "known": [], "slope": 1.0, "offset": 0.0}
    for x in (langid.predict(docs, None, docs.columns), toxicity.score(docs, model, docs.columns, out="s"),
              decontaminate.clean_rows(docs, benchmark)):
        sent = x._jdf.queryExecution().optimizedPlan().toString().partition("MapInArrow")[2].split("\n")[1]
        assert sent.count("text#") == 1, sent
        assert x.columns[:3] == docs.columns
        assert {tuple(r)[:3] for r in x.collect()} in (set(rows), set(rows[:-1]))
    assert x.count() == len(rows) - 1
    texts = [None, "", "é" * 30, "x" * 500, *("y" * (i % 50) for i in range(400)), None]
    batch = pa.record_batch({"n": list(range(len(texts))), "text": texts})
    parts = list(slices(batch, 1, 100))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 50
    assert all(sum(len(t.encode()) for t in p.column(1).to_pylist()[1:] if t) <= 100 for p in parts)
    assert list(slices(batch.slice(0, 0), 1)) == []


def test_toxicity_with_inserted_letters(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("bdgklmnprst"), 2)[i] + rng.choice(list("aeiou")) for i in range(2)) for _ in range(300)]
    data, labels = [], []
    for i in range(600):
        t = list(rng.choice(words, 30))
        if i % 4 == 0:
            t[5:5] = list(rng.choice(["zwyrx", "quozhj"], 2))
        data.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    odd = []
    for w in ("zwyrx", "quozhj"):
        for k in (1, 2):
            for _ in range(8):
                x = w
                for _ in range(k):
                    at = int(rng.integers(0, len(x) + 1))
                    x = x[:at] + "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)] + x[at:]
                odd.append(x)
    data += [(1000 + i, " ".join([*rng.choice(words, 20), w])) for i, w in enumerate(odd)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(toxicity.classify(df, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert [w for i, w in enumerate(odd) if not got[1000 + i]["predicted"]] == []
    assert np.mean([got[i]["predicted"] for i in range(600) if i % 4]) < 0.03


def test_inserted_letters_against_a_brute_force():
    rng = np.random.default_rng(8)
    known = ["".join(rng.choice(list("abc"), n)) for n in (4, 5, 5, 6, 7, 9)]
    s = toxicity.Scorer(rng.normal(size=1 << 18), 0.0, known)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 12))) for _ in range(3000)]
    sym, first, _, _ = s.words.split(words)
    own = dict(zip(known, toxicity.Scorer(s.beta, 0.0).margins(known)))

    def best(w):
        one = {w[:i] + w[i + 1:] for i in range(len(w))}
        two = {x[:i] + x[i + 1:] for x in one for i in range(len(x))}
        return max([own[k] for k in known if k in one or len(k) > toxicity.SHORTEST and k in two], default=-1.0)

    # single letters in a row are joined by the splitter: compare the words as it read them
    read = [toxicity.spell(sym[a:b]) for a, b in zip(first[:-1], first[1:])]
    assert np.allclose(s.inserted(sym, first), [best(w) for w in read]) and any(best(w) > -1 for w in read)


def test_licenses(docs, none):
    got = rows(licenses.scan_licenses(docs))
    r = got[9]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (10, 3, 0, 5, "cc-by,mit")
    assert set(r["labels"].split(",")) >= {"cc-by", "mit"} and 0 <= r["score"] <= 1
    assert got[0]["n_words"] == 0 and got[0]["first_word"] is None and got[0]["labels"] == ""
    assert licenses.scan_licenses(none).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(5)
    seqs = [rng.integers(0, 4, 30).tolist() for _ in range(4)]
    a = licenses.SuffixAutomaton()
    for i, s in enumerate(seqs):
        a.add(s, i)
    a.settle()
    text = rng.integers(0, 5, 200).tolist()
    has = lambda s, x: [e for e in range(len(x) - 1, len(s)) if s[e - len(x) + 1:e + 1] == x]
    for i, (n, state) in enumerate(a.matches(text)):
        longest = max(k for k in range(i + 2) if k == 0 or any(has(s, text[i + 1 - k:i + 1]) for s in seqs))
        assert n == longest
        if n:
            x = text[i + 1 - n:i + 1]
            assert a.ends[state] == {j: has(s, x)[0] for j, s in enumerate(seqs) if has(s, x)}


@pytest.mark.parametrize("seed", range(6))
def test_license_matches_and_chains_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    runs = [rng.integers(0, 5, n).tolist() for n in (12, 14, 9, 20)]
    word = lambda xs: " ".join("abcdefg"[x] for x in xs)
    text = rng.integers(0, 6, 60).tolist() + runs[0] + [5] + runs[3][:9] + [5, 5] + runs[3][10:] + runs[1]
    s = licenses.Scanner([(f"n{i}", word(r)) for i, r in enumerate(runs)], {}, 2, 0.6, [])
    h, _ = s.hasher.words([word(text).encode()])
    ids = s.known(h)
    got = s.matches(ids)
    want = {}
    for name, r in enumerate(runs):
        runs_of = {(t, n) for t in range(len(text)) for n in range(2, len(r) + 1) if t + n <= len(text)
                   and any(r[p:p + n] == text[t:t + n] for p in range(len(r) - n + 1))}
        most = {(t, n) for t, n in runs_of if (t, n + 1) not in runs_of and (t - 1, n + 1) not in runs_of}
        want[name] = {(t, p, n) for t, n in most for p in range(len(r) - n + 1) if r[p:p + n] == text[t:t + n]}
    assert {k: set(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    strong = [(t, t + n, k) for k, v in want.items() for t, _, n in v if n >= 0.6 * len(runs[k])]

    def best(name):
        value = {}
        for t, p, n in sorted(want[name]):  # ascending, so all that may stand before have their value
            value[t, p, n] = n
            for (a, b, m), v in list(value.items()):
                cut = max(0, a + m - t, b + m - p)
                gap = t + cut - a - m
                crossed = any(x <= a + m - 1 and y > t + cut for x, y, k in strong if k != name)
                if a < t and b < p and cut < n and gap <= licenses.MAX_GAP and not crossed:
                    value[t, p, n] = max(value[t, p, n], v + n - cut - gap)
        return max(value.values())

    assert {k: v for k, (v, _) in s.chains(ids).items()} == {k: best(k) for k, v in want.items() if v}


def test_license_variants():
    notice = {label: text for label, text in reversed(licenses.NOTICES)}
    gnu = ("This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License "
           "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    want = {notice["apache"]: "apache,apache-2.0", notice["apache-2.0"]: "apache,apache-2.0", gnu.format("program", "", 3): "gpl",
            gnu.format("program", "", 2): "gpl", gnu.format("library", "Lesser ", "2.1"): "lgpl", gnu.format("program", "Lesser ", 3): "lgpl",
            gnu.format("program", "Affero ", 3): "agpl", notice["gpl-3.0"]: "gpl,gpl-3.0", notice["gpl-2.0"]: "gpl,gpl-2.0",
            cc.format(""): "cc-by", cc.format("-ShareAlike"): "cc-by-sa", cc.format("-NoDerivatives"): "cc-by-nd",
            cc.format("-NonCommercial"): "cc-by-nc", cc.format("-NonCommercial-ShareAlike"): "cc-by-nc-sa",
            cc.format("-NonCommercial-NoDerivatives"): "cc-by-nc-nd"}
    s = licenses.Scanner()
    for text, labels in want.items():
        h, _ = s.hasher.words([("Some words before. " + text + " And some behind.").encode()])
        assert s.scan(s.known(h))[4] == labels, text
    far = notice["mit"].split()
    far = " ".join(far[:30] + ["zzz"] * 200 + far[30:])  # parts far from each other are not one notice
    h, _ = s.hasher.words([far.encode()])
    assert s.scan(s.known(h))[5] < 1


def test_license_bodies_without_their_opening():
    from importlib.resources import files

    s = licenses.Scanner()
    text = {n: files("sparkseries.llm").joinpath("notices", f"{n}.txt").read_text() for n in licenses.BODIES}

    def labels(t):
        h, _ = s.hasher.words([t.encode()])
        out = s.scan(s.known(h))
        return {x[0] for x in out[6]}

    for name, t in text.items():
        want = licenses.BODIES[name]
        words = t.split()
        assert want in labels(" ".join(words[len(words) // 2:])), name  # the second half alone
    assert labels(text["mit"]) == {"mit"} and labels(text["isc"]) == {"isc"} and labels(text["bsd"]) == {"bsd"}
    assert labels(text["unlicense"]) == {"unlicense"}
    assert labels("redistribution is fine. THE SOFTWARE IS PROVIDED" + text["mit"].split("THE SOFTWARE IS PROVIDED")[1]) == {"mit"}
    for name, own in (("apache-2.0", {"apache", "apache-2.0"}), ("mpl-2.0", {"mpl"}), ("gpl-3.0", {"gpl", "gpl-3.0"}),
                      ("gpl-2.0", {"gpl", "gpl-2.0"}), ("lgpl-2.1", {"lgpl"}), ("lgpl-3.0", {"lgpl"})):
        assert labels(text[name]) == own, name


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, 4).collect()
    assert len(got) == len(TEXTS) + 1
    per = Counter(r["shard"] for r in got)
    assert max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        assert (by[i]["size"], by[i]["text_crc32"]) == (len(b) + 1, zlib.crc32(b))
    net = sharding.Feistel(len(got))
    assert [int(net.row(r["slot"] * 4 + r["shard"])[0]) for r in got] == [r["row"] for r in got]
    assert {tuple(r) for r in sharding.shard_documents(docs.repartition(7), 4).collect()} == {tuple(r) for r in got}
    assert sharding.shard_documents(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 17, 1000])
def test_feistel_is_a_permutation(n):
    p = sharding.Feistel(n, key=3)
    assert sorted(p.place(np.arange(n))) == list(range(n)) and (p.row(p.place(np.arange(n))) == np.arange(n)).all()
