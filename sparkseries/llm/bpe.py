"""Byte-pair encoding by prefix-sharing trie traversal, and decoding.

The distinct words of a group of documents are put in sorted order, which is the depth-first order of
their trie.  Each trie node holds one state: the last token of the encoding of its prefix.  The
encoding of a prefix is that of the prefix without its last token, followed by that token, so the
state of a node follows from the states above it: it is the longest vocabulary entry ending there
whose pair with the last token before it would be left as it is by the merge rules.  A prefix shared by
many words is therefore encoded once; the ids of a word are read off backwards along its path.

Works with vocabularies of the word-end kind (``</w>``) without a byte-fallback: normalisation is NFC
and lower-casing by character, words come from the vocabulary's published pattern, bytes from its
byte alphabet.  Nothing is trained; the vocabulary file is read once on the driver (a fixed size of a
few megabytes) and sent with the tasks.

Cases: null text is empty and gives no tokens; ids are null-safe; special token strings in a text
become their ids, as in the tokenizers library; texts are encoded whole, whatever their length; the
memo of words is emptied when it reaches ``MEMO`` entries, so memory is bounded.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

from pyspark.sql import DataFrame

from sparkseries.llm.tables import arrow_map

MEMO = 250_000
GROUP_BYTES = 1 << 20
END = "</w>"
#: White space and the word pattern of the vocabulary's own pre-tokenizer.
SPACE = "\t-\r \x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character for every byte of a byte-level vocabulary: printable Latin-1 stands for
    itself, the rest is numbered from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [rest.get(b, chr(b)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What a task needs from a ``tokenizers`` JSON file of this kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
        raise ValueError("a BPE vocabulary with word ends is needed")
    ids = model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    pair = {}
    for rank, (a, b) in enumerate(merges):
        pair.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return {"ids": ids, "pair": pair, "special": special}


class TrieEncoder:
    def __init__(self, vocab: dict):
        self.special = vocab["special"]
        self.rank = {p: r for p, (r, _) in vocab["pair"].items()}
        # how each token is made: (rank of the merge, left, right); base symbols have no entry
        self.made: dict[int, tuple[int, int, int]] = {}
        for (a, b), (r, t) in vocab["pair"].items():
            if t not in self.made or r < self.made[t][0]:
                self.made[t] = (r, a, b)
        self.kept: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        # tokens by their text, inside a word and closing one; those that their own text never yields are left out
        usable = {t: i for t, i in vocab["ids"].items() if self.whole(i)}
        self.inner = {t: i for t, i in usable.items() if not t.endswith(END) or t == END}
        self.closing = {t[:-len(END)]: i for t, i in usable.items() if t.endswith(END) and t != END}
        self.longest = max(map(len, [*self.inner, *self.closing]), default=1)
        names = vocab["ids"] | self.special
        self.token = {i: t for t, i in names.items()}
        self.decimal = {i: str(i) for i in names.values()}
        self.length = {i: len(t) for x in (self.inner, self.closing) for t, i in x.items()}
        self.alphabet = byte_alphabet()
        self.ids_of: dict[str, str] = {}
        self.tokens_of: dict[str, str] = {}

    def stable(self, left: int, right: int) -> bool:
        """Whether the merge rules leave the boundary between these two tokens alone.

        The tokens are taken apart in reverse order of their merges.  At each step the two symbols at
        the boundary existed side by side until the earlier of the merges around them; if they have a
        merge of their own that would have come first, the boundary is crossed.  Equal ranks go to
        the one further left.
        """
        a, b, until, by_left, ok = left, right, 1 << 60, True, True
        while True:
            r = self.rank.get((a, b))
            # `until`: when a neighbour swallowed one of the two; on a tie the left merge goes first
            if r is not None and (r < until or (r == until and not by_left)):
                ok = False
                break
            ma, mb = self.made.get(a), self.made.get(b)
            if ma is None and mb is None:
                break
            if mb is None or (ma is not None and ma[0] > mb[0]):
                until, by_left, a = ma[0], True, ma[2]
            else:
                until, by_left, b = mb[0], False, mb[1]
        if len(self.kept) > 4 * MEMO:
            self.kept.clear()
        self.kept[left << 32 | right] = ok
        return ok

    def whole(self, t: int) -> bool:
        """Whether the token's own text is encoded as that one token."""
        known = self.alone.get(t)
        if known is None:
            m = self.made.get(t)
            known = m is None or (self.whole(m[1]) and self.whole(m[2]) and self.inside(m))
            self.alone[t] = known
        return known

    def inside(self, m: tuple[int, int, int]) -> bool:
        """Whether the halves of a token stand side by side when their merge comes up."""
        a, b = m[1], m[2]
        until, by_left = m[0], True
        while True:
            r = self.rank.get((a, b))
            if r is not None and (a, b) != (m[1], m[2]) and (r < until or (r == until and not by_left)):
                return False
            ma, mb = self.made.get(a), self.made.get(b)
            if ma is None and mb is None:
                return True
            if mb is None or (ma is not None and ma[0] > mb[0]):
                until, by_left, a = ma[0], True, ma[2]
            else:
                until, by_left, b = mb[0], False, mb[1]

    def last_token(self, tokens: dict, path: str, end: int, states: list) -> int:
        """Last token of the encoding of ``path[:end]``, from the states above that node; a state that
        is not known yet is worked out when a candidate asks for it, and stays with its node."""
        for start in range(max(0, end - self.longest), end):
            t = tokens.get(path[start:end])
            if t is None:
                continue
            if start == 0:
                return t
            s = states[start]
            if s is None:
                s = states[start] = self.last_token(self.inner, path, start, states)
            ok = self.kept.get(s << 32 | t)
            if ok or ok is None and self.stable(s, t):
                return t
        raise ValueError(f"no token for {path[end - 1]!r}")

    def add(self, words) -> None:
        """Encode distinct words along the depth-first order of their trie."""
        symbols = self.alphabet
        paths = sorted((w if w.isascii() and w.isprintable() else
                        "".join([symbols[b] for b in w.encode("utf-8", "replace")]), w) for w in words)
        states: list = [None]  # states[d]: last token of the first d symbols of the current path
        before = ""
        length, token, decimal = self.length, self.token, self.decimal
        for path, word in paths:
            n = len(path)
            shared, stop = 0, min(len(states) - 1, n - 1)
            while shared < stop and path[shared] == before[shared]:
                shared += 1
            del states[shared + 1:]
            states += [None] * (n - len(states))
            if n > 256:  # from the root down, so that no chain of unknown states is followed deep
                for end in range(shared + 1, n):
                    if states[end] is None:
                        states[end] = self.last_token(self.inner, path, end, states)
            t, at, out = self.last_token(self.closing, path, n, states), n, []
            while True:
                out.append(t)
                at -= length[t]
                if at == 0:
                    break
                t = states[at]
            out.reverse()
            self.ids_of[word] = " ".join([decimal[i] for i in out])
            self.tokens_of[word] = " ".join([token[i] for i in out])
            before = path


def normalise(text: str) -> str:
    if text.isascii():
        return text.lower()
    # lower-casing goes by character: no special final sigma
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def splitter(special: dict):
    """Function from a text to its words; special token strings come out whole, as tuples."""
    import regex

    general = regex.compile(PATTERN).findall
    # texts of ASCII and Latin-1 letters only are in NFC already and need no Unicode classes
    other = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]").search
    plain = re.compile("'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+").findall
    marks = re.compile("|".join(re.escape(s) for s in special)) if special else None

    def find(text: str) -> list:
        return general(normalise(text)) if other(text) else plain(text.lower())

    def split(text: str) -> list:
        if marks is None or not marks.search(text):
            return find(text)
        out, at = [], 0
        for m in marks.finditer(text):
            out += find(text[at:m.start()])
            out.append((m.group(),))
            at = m.end()
        return out + find(text[at:])

    return split


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (space-joined decimal ids), n_tokens and the decoded text (tokens joined by a space, as
    ``decode(ids, skip_special_tokens=False)`` of a vocabulary without a decoder gives it)."""
    return _encode(docs, vocabulary, "doc_id long, n_tokens long, ids string, decoded string",
                   lambda ids, decoded: {"ids": ids, "decoded": decoded})


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As ``encode_documents``, with SHA-256 digests in place of the ids and the decoded text."""
    sha = lambda xs: [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in xs]
    return _encode(docs, vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                   lambda ids, decoded: {"ids_sha256": sha(ids), "decoded_sha256": sha(decoded)})


def _encode(docs: DataFrame, vocabulary: str, schema: str, finish) -> DataFrame:
    vocab = load_vocabulary(vocabulary)

    def make():
        enc = TrieEncoder(vocab)
        split = splitter(enc.special)

        def group(doc_ids, texts):
            words = [split(t) for t in texts]
            new = {w for ws in words for w in ws if w not in enc.ids_of}
            for s in [w for w in new if isinstance(w, tuple)]:
                new.discard(s)
                enc.ids_of[s], enc.tokens_of[s] = str(enc.special[s[0]]), s[0]
            enc.add(new)
            ids = [" ".join(map(enc.ids_of.__getitem__, ws)) for ws in words]
            decoded = [" ".join(map(enc.tokens_of.__getitem__, ws)) for ws in words]
            if len(enc.ids_of) > MEMO:
                enc.ids_of.clear()
                enc.tokens_of.clear()
            return {"doc_id": doc_ids, "n_tokens": [x.count(" ") + 1 if x else 0 for x in ids]} | finish(ids, decoded)

        def run(batch):
            doc_ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):  # never all texts of a batch as Python's
                doc_ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= GROUP_BYTES:
                    yield group(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
            if texts:
                yield group(doc_ids, texts)

        return run

    return arrow_map(docs.select("doc_id", "text"), make, schema)
