"""Near-duplicate classes by BagMinHash signatures, banding and exact verification.

A text is the multiset of its five-word shingles.  Two texts are linked if their weighted Jaccard
similarity ``sum min / sum max`` of counts is at least 0.8, and classes are the connected components of links.

1. *Signature.*  The weight axis of a shingle is discretised at the integers and split hierarchically into the
   blocks ``[0,1) [1,2) [2,4) [4,8) ...``; each block carries its own Poisson process whose points
   (arrival, weight level inside the block, signature component) are drawn from the hash of shingle and
   block.  A text uses the points below its count of the shingle; each of the ``M`` components keeps the
   smallest arrival.  Two texts agree in a component with probability equal to their weighted Jaccard similarity.
   Points come in order of arrival, so a process stops at the largest value still needed.
2. *Banding.*  ``BANDS`` bands of ``ROWS`` components are the keys of candidate buckets: two texts of similarity
   0.8 miss each other in all of them with probability below 1e-4.
3. *Verification.*  A bucket of at most ``SMALL`` texts has its pairs listed.  In a larger one a hash gives every text a place;
   first about one text is compared with all others, then the places are cut into blocks of at most ``BLOCK`` texts (fewer,
   if the bucket holds long texts) and ever more blocks (1, then ``GROWTH`` times as many) are compared with all blocks.  After each round
   the classes are joined along the links, the compared texts leave the bucket, and buckets whose remaining texts are of one
   class are closed.  So every pair of a bucket is decided, most of them by already being in one class: a bucket of n copies
   needs about n comparisons.  Two blocks meet inside one task: what arrives there is the texts of both, what leaves it is
   a forest of links, never the pairs.  There is no cap on buckets, candidates or rounds.  A comparison first looks at
   the sizes (exact) and at the agreement of 2-bit codes of the signatures (a link of exactly 0.8 fails this with probability
   below 1e-8, at six standard deviations); what remains is verified by exact multiset overlap.

Equal texts are one node from the start (by MD5), so a group of exact copies costs one signature's worth
of rows.  Nothing of this is collected on the driver.

Cases: null texts are never duplicates of anything (class of their own id); texts without words are
linked to equal texts only; texts of fewer than five words are one shingle; a class is named by its smallest
doc_id; null ids are ignored in that minimum; repeated rows are copies; texts are read whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseries.llm.components import relabel
from sparkseries.llm.tables import arrow_map, dropped, written
from sparkseries.llm.text import Hasher, mix, numbered, pieces, shingles

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Signature components: the first BANDS * ROWS make the bands, all of them the estimate.
M = 384
CODES = M // 32  # 2-bit codes in longs
SMALL, GROWTH = 8, 8
#: Texts of a block, and shingles of a block if a bucket holds long texts.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21


def bag(texts: list, hasher: Hasher, k: int = SHINGLE):
    """Distinct shingles of each text: (text index ascending, shingle hash, count)."""
    h, first = hasher.words(texts)
    s, doc = shingles(h, first, k)
    order, start = numbered(s, doc)
    count = np.diff(np.append(start, len(order)))
    at = order[start]
    by = np.argsort(doc[at], kind="stable")
    return doc[at][by], s[at][by], count[by]


def signatures(doc: np.ndarray, key: np.ndarray, count: np.ndarray, texts: int, m: int = M) -> np.ndarray:
    """BagMinHash signatures (texts x m arrivals; infinite for a text without shingles)."""
    block, procs = 0, []
    lo, size, left = 0, 1, np.arange(len(key))
    while len(left):  # one process per shingle and block of its weight
        c = count[left]
        procs.append((left, np.full(len(left), block, np.uint64), np.full(len(left), float(size)),
                      np.minimum(1.0, (c - lo) / size)))
        lo, size, block = lo + size, max(1, lo + size), block + 1
        left = left[c > lo]
    if not procs:
        return np.full((texts, m), np.inf)
    at = np.concatenate([p[0] for p in procs])
    seed = mix(key[at] + np.concatenate([p[1] for p in procs]) * np.uint64(0xA24BAED4963EE407))
    rate = np.concatenate([p[2] for p in procs])
    share = np.concatenate([p[3] for p in procs])
    of = doc[at]
    out = np.full(texts * m, np.inf)
    arrival, j = np.zeros(len(at)), 0
    while len(at):
        j += 1
        u = mix(seed + np.uint64(j * 0x9FB21C651E98DF25 & (2**64 - 1)))
        v = mix(u + np.uint64(0x632BE59BD9B4E019))
        arrival = arrival - np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        level = (v >> np.uint64(32)).astype(float) * 2.0**-32
        slot = of * m + ((v & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        ok = np.flatnonzero((level < share) & (arrival < out[slot]))
        np.minimum.at(out, slot[ok], arrival[ok])
        worst = out.reshape(texts, m).max(axis=1)
        go = arrival < worst[of]
        at, seed, rate, share, of, arrival = at[go], seed[go], rate[go], share[go], of[go], arrival[go]
    return out.reshape(texts, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """32-bit key of every band of every signature."""
    bits = np.ascontiguousarray(sig).view(np.uint64)
    out = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        out = mix(out + bits[:, r:bands * rows:rows] + np.uint64(r + 1))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def codes(sig: np.ndarray) -> list[np.ndarray]:
    """2 bits of every component, 32 to a long."""
    bits = mix(np.ascontiguousarray(sig).view(np.uint64)) >> np.uint64(62)
    shift = np.arange(0, 64, 2, dtype=np.uint64)
    return [np.bitwise_or.reduce(bits[:, 32 * i:32 * i + 32] << shift, axis=1).view(np.int64) for i in range(CODES)]


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, size, keys, c0, c1 ...): node is the MD5 of a text (null for null); the rest describes its
    shingles (null without words)."""
    x = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")

    def make():
        hasher = Hasher()

        def run(batch):
            ids, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, texts in pieces(batch.column(2)):
                doc, key, count = bag(texts, hasher)
                sig = signatures(doc, key, count, len(texts))
                size = np.bincount(doc, count, len(texts)).astype(np.int64)
                part = slice(i, i + len(texts))
                some = lambda rows: [r if n else None for r, n in zip(rows, size)]
                yield {"doc_id": ids[part], "node": nodes[part], "size": size, "keys": some(band_keys(sig))} | {
                    f"c{j}": c for j, c in enumerate(codes(sig))}

        return run

    return arrow_map(x, make, "doc_id long, node binary, size long, keys array<int>, "
                     + ", ".join(f"c{j} long" for j in range(CODES)))


def bags(texts: DataFrame) -> DataFrame:
    """(node, bag): the multiset of shingles as a set of hashes of (shingle, how many before it)."""

    def make():
        hasher = Hasher()

        def run(batch):
            nodes = batch.column(0).to_pylist()
            for i, part in pieces(batch.column(1)):
                doc, key, count = bag(part, hasher)
                n = np.repeat(np.arange(len(key)), count)
                nth = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
                h = mix(key[n] + nth.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)
                cut = np.searchsorted(doc[n], np.arange(len(part) + 1))
                yield {"node": nodes[i:i + len(part)], "bag": [h[a:b] for a, b in zip(cut[:-1], cut[1:])]}

        return run

    return arrow_map(texts, make, "node binary, bag array<long>")


def most_different(similarity: float) -> int:
    """In how many 2-bit codes a link may differ, at six standard deviations."""
    p = similarity + (1 - similarity) / 4
    return M - math.floor(M * p - 6 * math.sqrt(M * p * (1 - p)))


def candidates(members: DataFrame, due, similarity: float) -> DataFrame:
    """Pairs (a, b) of a bucket with a text whose turn it is, of different classes, that sizes and codes allow
    to be links; each pair comes from the first bucket it shares."""
    x = members.withColumn("due", due)
    codes = [f"c{i}" for i in range(CODES)]
    a = x.where("due").select("band", "key", *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "size", "keys", *codes)])
    b = x.select("band", "key", *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "size", "keys", *codes, "due")])
    differ = F.lit(0)
    for c in codes:  # a component differs if either of its two bits does
        d = F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))
        differ = differ + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    earlier = F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda i: (i < a["band"]) & (F.get("keys_a", i) == F.get("keys_b", i)))
    ok = ((F.col("label_a") != F.col("label_b")) & (~F.col("due_b") | (F.col("node_a") < F.col("node_b")))
          & (F.least("size_a", "size_b") >= F.lit(similarity - 1e-9) * F.greatest("size_a", "size_b"))
          & (differ <= most_different(similarity)) & ~earlier)
    pairs = a.join(b, [a["band"] == b["band"], a["key"] == b["key"], ok])
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multiset overlap reaches the similarity."""
    x = pairs.join(sets.withColumnsRenamed({"node": "a", "bag": "bag_a"}), "a")
    x = x.join(sets.withColumnsRenamed({"node": "b", "bag": "bag_b"}), "b")
    x = x.withColumn("both", F.size(F.array_intersect("bag_a", "bag_b")))
    return x.where(F.col("both") >= F.lit(similarity) * (F.size("bag_a") + F.size("bag_b") - F.col("both"))).select("a", "b")


def met(members: DataFrame, lo: int, hi: int) -> DataFrame:
    """The members of every bucket once for each pair of blocks (i, j) they take part in, where block i is
    one of those due now (``lo`` to ``hi - 1``) and j is any block from i on."""
    none = F.array().cast("array<long>")
    upto = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(none)
    own, last = F.col("own"), F.floor((F.col("n") - 1) / F.col("block"))
    first = F.lit(lo).cast("long")
    before = F.transform(upto(first, F.least(own, F.lit(hi - 1))), lambda i: F.struct(i.alias("i"), own.alias("j")))
    after = F.transform(F.when(own < hi, upto(own + 1, last)).otherwise(none), lambda j: F.struct(own.alias("i"), j.alias("j")))
    return members.withColumn("meet", F.explode(F.concat(before, after))).select("*", "meet.i", "meet.j").drop("meet")


def block_links(members: DataFrame, sets: DataFrame, lo: int, hi: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all classes which texts of the due blocks connect: a forest for each pair of blocks."""
    import pyarrow as pa

    most, by = most_different(similarity), ["band", "key", "i", "j"]

    def survivors(t):
        """The texts with a partner that sizes and codes allow, each with the places of its partners."""
        n, band = t.num_rows, t["band"][0].as_py()
        own, size = t["own"].to_numpy(), t["size"].to_numpy()
        label = np.unique(np.array(t["label"].to_pylist(), dtype="S16"), return_inverse=True)[1]
        code = np.stack([t[f"c{c}"].to_numpy() for c in range(CODES)], axis=1).view(np.uint64)
        keys = t["keys"].combine_chunks().flatten().to_numpy().reshape(n, BANDS)[:, :band]
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        partners: list = [[]] * n
        used = np.zeros(n, bool)
        for at in range(0, len(left), 32):
            a = left[at:at + 32]
            x = code[a][:, None] ^ code[right][None]
            differ = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=2)
            small, large = np.minimum.outer(size[a], size[right]), np.maximum.outer(size[a], size[right])
            ok = (differ <= most) & (label[a][:, None] != label[right]) & (small >= (similarity - 1e-9) * large)
            if i == j:
                ok &= a[:, None] < right
            x, y = np.nonzero(ok)
            ok[x, y] = ~(keys[a[x]] == keys[right[y]]).any(axis=1)  # decided in an earlier bucket
            for k, row in zip(a, ok):
                if row.any():
                    partners[k] = right[row]
                    used[k] = used[right[row]] = True
        at = np.flatnonzero(used)
        return pa.table({**{c: t[c].take(pa.array(at)) for c in (*by, "node", "label")}, "at": pa.array(at, pa.int32()),
                         "partners": pa.array([partners[k] for k in at], pa.list_(pa.int32()))})

    def forest(t):
        order = np.argsort(t["at"].to_numpy())
        t = t.take(pa.array(order))
        node, at = t["node"].to_pylist(), t["at"].to_numpy()
        root = np.unique(np.array(t["label"].to_pylist(), dtype="S16"), return_inverse=True)[1]
        lists = t["bag"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        start = np.cumsum(size) - size
        word = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        mark = np.zeros(int(word.max(initial=-1)) + 1, np.int64)
        a, b = [], []
        for k, partners in enumerate(t["partners"].combine_chunks()):
            to = np.searchsorted(at, np.array(partners.as_py(), np.int64))
            to = to[root[to] != root[k]]
            if not len(to):
                continue
            own = word[start[k]:start[k] + size[k]]
            mark[own] = 1
            both = np.add.reduceat(mark[word], start)[to]
            mark[own] = 0
            for x in to[both >= similarity * (size[k] + size[to] - both)]:
                if root[x] != root[k]:
                    root[root == root[x]] = root[k]
                    a.append(min(node[k], node[x]))
                    b.append(max(node[k], node[x]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    x = met(members, lo, hi).select(*by, "own", "node", "label", "size", "keys", *[f"c{c}" for c in range(CODES)])
    x = x.groupBy(*by).applyInArrow(survivors, "band int, key int, i long, j long, node binary, label binary, at int, "
                                    "partners array<int>")
    return x.join(sets, "node").groupBy(*by).applyInArrow(forest, "a binary, b binary")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row of ``docs``, and for every node the head of its class: the smallest
    (doc_id, node) of the class."""
    rows = written(signed(docs), "signed")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in rows.columns[2:]])
    nodes = written(nodes, "nodes")
    members = nodes.where("keys is not null").select("node", "size", F.posexplode("keys").alias("band", "key"))
    fit = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.max("size"))))
    shared = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), fit.cast("long").alias("block")).where("n > 1")
    left = members.drop("size").join(shared, ["band", "key"])
    left = written(left.join(nodes.drop("first_id"), "node"), "members")
    labels = written(left.select("node").distinct().withColumn("label", F.col("node")), "labels")
    # the shingles of candidate texts, each text once
    wanted = nodes.select("node", "first_id").join(labels.select("node"), "node")
    wanted = wanted.withColumnRenamed("node", "__node")
    texts = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")
    texts = texts.join(wanted, [F.col("node") == F.col("__node"), F.col("doc_id").eqNullSafe(F.col("first_id"))], "left_semi")
    sets = written(bags(texts.select("node", "text")).dropDuplicates(["node"]), "bags")
    # a text's place in a bucket of n, and the block it falls in
    place = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / (1 << 40) * F.col("n")
    left = left.withColumn("own", F.floor(place / F.col("block")))
    alone = (F.col("n") <= SMALL) | (place < 1)
    lo, hi = 0, 0
    while True:
        tagged = left.join(labels, "node")
        open_ = tagged.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        tagged = written(tagged.join(open_.where("lo <> hi").drop("lo", "hi"), ["band", "key"]), "open")
        dropped(left)
        if tagged.isEmpty():
            break
        if hi == 0:
            found = links(candidates(tagged, alone, similarity), sets, similarity)
            left = tagged.where(~alone)
        else:
            found = block_links(tagged, sets, lo, hi, similarity)
            left = tagged.where(F.col("own") >= hi)
        found = written(found, "links")
        labels = relabel(labels, found)
        dropped(found)
        left, lo, hi = left.drop("label"), hi, max(1, hi * GROWTH)
    # every node's class is named by the smallest id among the class's texts
    first = nodes.select("node", "first_id").join(labels, "node", "left")
    first = first.select("node", "first_id", F.coalesce("label", "node").alias("label"))
    named = first.groupBy("label").agg(F.min(F.struct("first_id", "node")).alias("head"))
    return rows, first.join(named, "label").select("node", "head")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and the number of rows in the class."""
    rows, of = classes(docs, similarity)
    copies = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    size = copies.join(of, "node").groupBy("head").agg(F.sum("n").alias("class_size"))
    named = of.join(size, "head").select("node", F.col("head.first_id").alias("class_id"), "class_size")
    x = rows.select("doc_id", "node").join(named, "node", "left")
    alone = F.col("node").isNull()
    return x.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each class left, the one whose id names the class; null texts all stay."""
    _, of = classes(docs, similarity)
    heads = written(of.select("head").distinct().select(F.col("head.first_id").alias("__id"), F.col("head.node").alias("__node")),
                    "heads")
    n = "__n"  # a name that the caller's columns leave free
    while n in docs.columns:
        n = "_" + n
    heads = heads.withColumnsRenamed({"__id": f"{n}id", "__node": f"{n}ode"})
    x = docs.withColumn(n, F.unhex(F.md5(F.col("text").cast("binary"))))
    kept = x.join(heads, [x[n] == heads[f"{n}ode"], x["doc_id"].eqNullSafe(heads[f"{n}id"])], "left_semi")
    kept = kept.dropDuplicates([n, "doc_id"])
    return kept.unionByName(x.where(F.col(n).isNull())).drop(n)
