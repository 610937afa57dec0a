"""Token counts by section through offset-mapped attribution.

Each document is encoded once, whole, with a lossless byte-level vocabulary.  The character span of
every token follows from the running sum of token lengths.  The spans are interval-joined to the
spans of the document's sections (both are sorted, so the join is a merge), and a token that crosses
a section border is allocated by an explicit rule:

* ``start``     the whole token goes to the section that holds its first character (the default);
* ``majority``  to the section holding most of its characters, the earlier one on a tie;
* ``split``     to every section it touches, in proportion to its characters there.

Sections cover the text without gaps: by default the lines of a text, each with its line feed.  Other
section boundaries (fields joined into one text, say) come from a caller's function.

Cases: null text gives one empty section with no tokens, and so does an empty text; every section is
returned, also those without tokens (a token begins in an earlier one); null ids are kept; equal rows
give equal results; texts are encoded whole.  A character that several tokens share counts for the
token that holds its first byte.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame

from sparkseries.llm.tables import arrow_map

RULES = ("start", "majority", "split")


def line_starts(text: str) -> list[int]:
    """First character of every line; a text that ends in a line feed has no further line."""
    out, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def token_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Character border before each token, and the end: token i covers spans[i] to spans[i + 1]."""
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])
    if text.isascii():
        return ends
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
    return before[np.minimum(ends, len(raw))]


def attribute(spans: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section under the rule, tokens that cross out of or into it)."""
    n = len(starts)
    first, last = spans[:-1], np.maximum(spans[1:] - 1, spans[:-1])
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, np.minimum(last, max(size - 1, 0)), "right") - 1
    b = np.maximum(a, b)
    over = np.flatnonzero(a != b)
    crossing = np.zeros(n, np.int64)
    whole = np.bincount(a, minlength=n).astype(float)
    ends = np.append(starts[1:], size)
    for i in over:  # few: tokens over a border
        part = slice(a[i], b[i] + 1)
        crossing[part] += 1
        held = np.minimum(ends[part], spans[i + 1]) - np.maximum(starts[part], spans[i])
        if rule == "majority":
            whole[a[i]] -= 1
            whole[a[i] + int(np.argmax(held))] += 1
        elif rule == "split":
            whole[a[i]] -= 1
            whole[part] += held / held.sum()
    return whole, crossing


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def section_token_counts(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "start",
                         sections=line_starts) -> DataFrame:
    """One row per document and section: its span, tokens under the rule, tokens crossing a border,
    and the tokens of the whole document.  The ranks file (a fixed size) is read on the driver."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = load_ranks(ranks_path)

    def make():
        import tiktoken

        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for t, i in ranks.items():
            lengths[i] = len(t)

        def rows(part):
            out = {k: [] for k in ("doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens")}
            for doc_id, text in part:
                text = (text or "").encode("utf-8", "replace").decode("utf-8")
                starts = np.asarray(sections(text), np.int64)
                ids = np.asarray(enc.encode_ordinary(text), np.int64)
                spans = token_spans(text, ids, lengths)
                n, crossing = attribute(spans, starts, len(text), rule)
                out["doc_id"].append((doc_id, len(starts)))
                out["section"].append(np.arange(len(starts)))
                out["start_char"].append(starts)
                out["end_char"].append(np.append(starts[1:], len(text)))
                out["n_tokens"].append(n)
                out["n_crossing"].append(crossing)
                out["doc_tokens"].append(np.full(len(starts), len(ids)))
            ids = [d for d, k in out.pop("doc_id") for _ in range(k)]
            return {"doc_id": ids} | {k: np.concatenate(v) for k, v in out.items()}

        def run(batch):
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for i in range(0, len(pairs), 500):
                yield rows(pairs[i:i + 500])

        return run

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, section long, start_char long, "
                     "end_char long, n_tokens double, n_crossing long, doc_tokens long")
