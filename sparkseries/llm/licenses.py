"""License scans with a generalised suffix automaton over the words of license notices.

The notices are fixed, so the automaton has a fixed size and travels with the tasks.  Every text is
streamed through it once: at each word the automaton gives the *matching statistic*, the length of
the longest run of words ending there that occurs in some notice; the suffix links below its state give the longest
run of every other notice.  A match is maximal in its notice: neither neighbour carries it further there.  Maximal
matches of at least ``MIN_MATCH`` words are chained per notice by dynamic programming, ascending in text and notice,
with at most ``MAX_GAP`` text words between two of them, each of which counts against one matched word.  No chain
links two matches where another notice runs on across the link with at least ``MIN_COVER`` of its words in one
match: the text there is that notice's.  The best chain's words, less its gaps, over the notice's words are its coverage;
coverage of at least ``MIN_COVER`` adds the notice's label, unless notices of larger coverage span ``MOSTLY`` of the
same place (for paragraphs of license texts also longer ones of the same coverage).  Words outside the notices' vocabulary reset the automaton, so only runs of known words are walked.

The notices are short notices and headers, and every paragraph of ``PARAGRAPH`` words or more of the license texts in
``notices``, so a document that holds any paragraph of a text gets its label; coverage is that of one notice or paragraph,
not of the whole text.  Of the AGPL and the Creative Commons licenses only the notices above are known, not the terms.

Base labels do not depend on the chains: they mark every place where the words of a base phrase stand
consecutively.  Words: ``A-Z`` lower-cased, then maximal runs of digits, ``a-z`` and non-ASCII.

Cases: null text is empty; texts without words have n_words 0, null places, empty labels, score 0;
texts are read whole in pieces; equal rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from importlib.resources import files
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from sparkseries.llm.tables import arrow_map
from sparkseries.llm.text import Hasher, pieces

MIN_MATCH = 4
MIN_COVER = 0.6
#: Largest number of text words between two matches of a chain.
MAX_GAP = 8
#: Share of a span that notices of larger coverage must span to displace it.
MOSTLY = 0.9
#: Base phrases with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Whole license texts shipped in ``notices`` (file name) with their labels.
BODIES = {"mit": "mit", "isc": "isc", "bsd": "bsd", "unlicense": "unlicense", "apache-2.0": "apache-2.0", "gpl-2.0": "gpl-2.0",
          "gpl-3.0": "gpl-3.0", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "mpl-2.0": "mpl"}
#: Fewest words of a paragraph of a license text that stands for the license by itself.
PARAGRAPH = 16
#: Well-known license notices (label, text).
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    *((f"cc-by{short}", f"This work is licensed under a Creative Commons Attribution{long} 4.0 International License")
      for short, long in (("", ""), ("-sa", "-ShareAlike"), ("-nd", "-NoDerivatives"), ("-nc", "-NonCommercial"),
                          ("-nc-sa", "-NonCommercial-ShareAlike"), ("-nc-nd", "-NonCommercial-NoDerivatives"))),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def paragraphs(bodies: dict[str, str] = BODIES, least: int = PARAGRAPH) -> list[tuple[str, str]]:
    """(label, text) of the paragraphs of the shipped license texts, without those that stand word for word in
    texts of several labels: they tell nothing.  Read on the driver; the texts travel with the tasks."""
    of: dict[tuple, dict[str, str]] = {}
    for name, label in bodies.items():
        text = files("sparkseries.llm").joinpath("notices", f"{name}.txt").read_text("utf-8")
        text = text.split("END OF TERMS AND CONDITIONS")[0]  # how to apply them is not part of them
        for part in re.split(r"\n\s*\n", text):
            words = tuple(re.findall(r"[0-9a-z]+", part.lower()))
            if len(words) >= least:
                of.setdefault(words, {})[label] = " ".join(part.split())
    return [next(iter(labels.items())) for labels in of.values() if len(labels) == 1]


def overlap(a: int, b: int, spans: list[tuple[int, int]]) -> int:
    """How many places from ``a`` up to ``b`` lie in a span."""
    n = 0
    for x, y in sorted(spans):
        a = max(a, x)
        n += max(0, min(b, y) - a)
        a = max(a, min(b, y))
    return n


class SuffixAutomaton:
    """Suffix automaton of several word sequences; each state knows where its strings end first in each."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]  # sequence -> last position of the first place of its strings

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of the longest string of ``p`` followed by ``w``, set apart from longer ones."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], name: int) -> None:
        last, path = 0, []
        for w in words:
            if w in self.next[last]:
                last = self._split(last, w)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, w)
                last = new
            path.append(last)
        for i, s in enumerate(path):  # every suffix of each prefix ends there
            while s > 0 and name not in self.ends[s]:
                self.ends[s][name] = i
                s = self.link[s]

    def settle(self) -> None:
        """States split off after a sequence was added inherit what ends in the states below them."""
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            up = self.ends[self.link[s]] if self.link[s] > 0 else None
            if up is not None:
                for name, i in self.ends[s].items():
                    up[name] = min(i, up.get(name, i))

    def matches(self, words: list[int]):
        """Matching statistics of a run of words: (length, state) after each word."""
        s, n = 0, 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            else:
                s, n = 0, 0
            yield n, s


#: The paragraphs of whole license texts (label, text).
TERMS = paragraphs()


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES, min_match=MIN_MATCH, min_cover=MIN_COVER, terms=TERMS):
        self.min_match, self.min_cover = min_match, min_cover
        self.short = len(notices)  # terms are numbered behind the notices
        notices = [*notices, *terms]
        hasher = Hasher()
        runs = [hasher.words([t.encode()])[0] for _, t in notices]
        base = [hasher.words([p.encode()])[0] for p in phrases]
        self.vocabulary = np.unique(np.concatenate([*runs, *base]))
        ids = lambda h: [int(x) for x in np.searchsorted(self.vocabulary, h)]
        self.labels = [label for label, _ in notices]
        self.sizes = [len(r) for r in runs]
        self.automaton = SuffixAutomaton()
        for name, r in enumerate(runs):
            self.automaton.add(ids(r), name)
        self.automaton.settle()
        self.runs = [ids(r) for r in runs]
        self.starts: list[dict[tuple, list[int]]] = []  # notice -> its first ``min_match`` words -> places
        for r in self.runs:
            self.starts.append({})
            for p in range(len(r) - min_match + 1):
                self.starts[-1].setdefault(tuple(r[p:p + min_match]), []).append(p)
        self.base = [(ids(b), label) for b, label in zip(base, phrases.values())]
        self.hasher = hasher

    def known(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary number of every word, -1 outside it."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    def matches(self, ids: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each notice, its maximal matches (first text word, first notice word, length), at every place of it."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        inside = np.concatenate([[False], ids >= 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        a = self.automaton
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi - lo < self.min_match:
                continue
            words = ids[lo:hi].tolist()
            before: dict[int, int] = {}  # longest run of each notice that ends at the word before
            for i, (n, s) in enumerate([*a.matches(words), (0, 0)]):
                now: dict[int, int] = {}
                while s > 0 and n >= self.min_match:
                    for name in a.ends[s]:
                        now.setdefault(name, n)
                    s = a.link[s]
                    n = a.length[s]
                for name, n in before.items():
                    if now.get(name, 0) <= n:
                        run = words[i - n:i]
                        found.setdefault(name, []).extend((lo + i - n, p, n) for p in self.places(name, run))
                before = now
        return found

    def places(self, name: int, run: list[int]) -> list[int]:
        """Every place of a notice where the run of words stands."""
        notice, k = self.runs[name], self.min_match
        return [p for p in self.starts[name].get(tuple(run[:k]), ()) if notice[p:p + len(run)] == run]

    def chains(self, ids: np.ndarray) -> dict[int, tuple[float, list[tuple[int, int, int]]]]:
        """For each notice, the value of its best chain (matched words less gaps) and the chain."""
        found = self.matches(ids)
        # matches that hold most of their notice by themselves: no other notice's chain leaps inside them
        strong = [(t, t + n, name) for name, m in found.items() for t, _, n in m if n >= self.min_cover * self.sizes[name]]
        strong.sort()
        return {name: self.chain(m, [(a, b) for a, b, other in strong if other != name]) for name, m in found.items()}

    @staticmethod
    def chain(found: list[tuple[int, int, int]], strong: list[tuple[int, int]] = ()) -> tuple[float, list[tuple[int, int, int]]]:
        """The best chain of matches that ascend in text and notice; where two overlap, the second is cut."""
        found = sorted(set(found))
        begins = [a for a, _ in strong]
        reach = list(accumulate((b for _, b in strong), max))
        value = [float(n) for _, _, n in found]
        back = [-1] * len(found)
        low = 0
        longest = max(n for _, _, n in found)
        for j, (t, p, n) in enumerate(found):
            while found[low][0] + longest + MAX_GAP < t:
                low += 1
            for i in range(low, j):
                ti, pi, ni = found[i]
                shared = max(0, ti + ni - t, pi + ni - p)
                gap = t + shared - ti - ni
                if ti >= t or pi >= p or gap > MAX_GAP or shared >= n:
                    continue
                more = value[i] + n - shared - gap
                if more <= value[j]:
                    continue
                k = bisect_right(begins, ti + ni - 1) - 1
                if k < 0 or reach[k] <= t + shared:
                    value[j], back[j] = more, i
        j = max(range(len(found)), key=lambda j: (value[j], -j))
        out, total = [], value[j]
        while j >= 0:
            out.append(found[j])
            j = back[j]
        return total, out[::-1]

    def scan(self, ids: np.ndarray) -> tuple[int, int | None, int | None, str, str, float, list[tuple[str, int, int]]]:
        places, base = [], set()
        for words, label in self.base:
            n = len(words)
            at = np.flatnonzero(ids[:len(ids) - n + 1] == words[0]) if len(ids) >= n else np.zeros(0, np.int64)
            for j in range(1, n):
                at = at[ids[at + j] == words[j]]
            if len(at):
                base.add(label)
                places.append(at)
        # of terms that are covered alike the longer ones win; a short notice inside a longer one stays
        chains = [((min(1.0, max(0.0, value) / self.sizes[name]), value if name >= self.short else np.inf),
                   int(c[0][0]), int(c[-1][0] + c[-1][2]), self.labels[name])
                  for name, (value, c) in self.chains(ids).items()]
        score = max((c[0][0] for c in chains), default=0.0)
        chains = [c for c in chains if c[0][0] >= self.min_cover]
        spans = sorted({(label, a, b) for cover, a, b, label in chains
                        if overlap(a, b, [(x, y) for c, x, y, _ in chains if c > cover]) < MOSTLY * (b - a)})
        first = int(min(p[0] for p in places)) if places else None
        last = int(max(p[-1] for p in places)) if places else None
        labels = sorted(base | {s[0] for s in spans})
        return sum(map(len, places)), first, last, ",".join(sorted(base)), ",".join(labels), score, spans


def scan_licenses(docs: DataFrame, notices=NOTICES, phrases=PHRASES, min_match: int = MIN_MATCH,
                  min_cover: float = MIN_COVER, terms=TERMS) -> DataFrame:
    """One row per document: words, base places, labels, score, and the covered spans (label:from-to)."""

    def make():
        scanner = Scanner(notices, phrases, min_match, min_cover, terms)

        def run(batch):
            doc_ids = batch.column(0).to_pylist()
            for first, texts in pieces(batch.column(1).to_pylist()):
                h, bounds = scanner.hasher.words(texts)
                ids = scanner.known(h)
                hits = np.concatenate([[0], np.cumsum(ids >= 0)])
                rows = []
                for i in range(len(texts)):
                    lo, hi = bounds[i], bounds[i + 1]
                    rows.append((int(hi - lo), *(scanner.scan(ids[lo:hi]) if hits[hi] - hits[lo] > 1
                                                 else (0, None, None, "", "", 0.0, []))))
                n, base, a, b, bl, labels, score, spans = zip(*rows)
                yield {"doc_id": doc_ids[first:first + len(texts)], "n_words": n, "n_base": base, "first_word": a,
                       "last_word": b, "base_labels": bl, "labels": labels, "score": score,
                       "spans": [[f"{k}:{i}-{j}" for k, i, j in s] for s in spans]}

        return run

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_words long, n_base long, first_word long, "
                     "last_word long, base_labels string, labels string, score double, spans array<string>")
