"""License scans: a generalised suffix automaton of license words, matching statistics, chained matches.

The words of all templates go into one suffix automaton: a state stands for all
word sequences that end at the same places of the templates.  A text is streamed
through it; after each word the state and a length tell the longest end of the
text so far that lies in some template (the matching statistics).  A match of
``LONG`` words or more that the next word does not continue is a fragment, at all
places of its state.  Fragments of one template that go forward in text and
template, with at most ``GAP`` words of the text between them, are chained so that
the chain covers as many template words as possible; a chain that covers ``SHARE``
of a template is a span of it and gives its label.

Phrases are labels of their own kind: every place where their words stand one
after another counts.  They are read off the same states.

Words: A-Z are lower-cased; a word is a maximal stretch of digits, letters and
anything outside ASCII (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after that).

The automaton is made from the templates, at most ``MOST`` words in all (checked),
once in each Python worker.  Where two neighbouring words are no neighbours in any
template, no match of two words can hold both; such places cut the text, and the
automaton runs over what lies between them.  Work is narrow: no shuffle.  Chains
look back ``GAP`` words and the longest template at most, so that very long texts
and texts of many notices stay linear.

Nulls and edges: a null or empty text has no words, empty labels, null places and
score 0; null ids and repeated rows are answered row by row; equal chains go to the
earlier one; an empty table gives an empty one; only id and text are read, so
further columns cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import plain, plain_words, sliced, text_bytes

LONG = 4  # words of a fragment
GAP = 12  # words of the text between two fragments of a chain
SHARE = 0.8  # of a template that a chain must cover
MOST = 1 << 17

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices as their licenses word them.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation"),
    ("lgpl", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
     "redistribute it freely"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]


class Automaton:
    """Suffix automaton of several word sequences, given as lists of numbers."""

    def __init__(self, sequences: list[list[int]], kept: int) -> None:
        """Places are kept for states of ``kept`` words or more."""
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        tops = [self._insert(s) for s in sequences]
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.step]  # (sequence, end)
        for k, states in enumerate(tops):
            for end, state in enumerate(states, 1):
                while state > 0 and self.length[state] >= kept:
                    self.places[state].append((k, end))
                    state = self.link[state]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A state for the shorter sequences of ``target``, which ``state`` reaches by ``word``."""
        copy = self._state(self.length[state] + 1, dict(self.step[target]), self.link[target])
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        self.link[target] = copy
        return copy

    def _insert(self, sequence: list[int]) -> list[int]:
        """The states of the sequence's beginnings."""
        last, out = 0, []
        for word in sequence:
            target = self.step[last].get(word)
            if target is not None:  # known from another sequence
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
            else:
                new, state = self._state(self.length[last] + 1, {}, 0), last
                while state >= 0 and word not in self.step[state]:
                    self.step[state][word] = new
                    state = self.link[state]
                if state >= 0:
                    target = self.step[state][word]
                    same = self.length[target] == self.length[state] + 1
                    self.link[new] = target if same else self._split(state, word, target)
                last = new
            out.append(last)
        return out

    def state_of(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.step[state][word]
        return state

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest end that lies in some sequence."""
        step, link, lengths = self.step, self.link, self.length
        state = length = 0
        for word in words:
            target = step[state].get(word)
            while target is None and state:
                state = link[state]
                length = lengths[state]
                target = step[state].get(word)
            if target is not None:
                state, length = target, length + 1
            yield state, length


def chains(fragments: list[tuple[int, int, int]], size: int, gap: int = GAP) -> list[tuple[int, int, int]]:
    """(first, after, covered) of the best chain from each beginning, by place; those inside a better one left out.

    ``fragments`` are (place in the text, place in the template, length); ``size`` is the template's.
    """
    fragments = sorted(set(fragments))
    covered, root = [], []
    low = 0
    for k, (at, there, n) in enumerate(fragments):
        while fragments[low][0] + size + gap < at:  # no fragment is longer than the template
            low += 1
        best, begin = n, k
        for j in range(low, k):
            a, t, m = fragments[j]
            if a < at and t < there and a + m < at + n and t + m < there + n and at - a - m <= gap:
                gain = covered[j] + n - max(0, a + m - at, t + m - there)
                if gain > best:
                    best, begin = gain, root[j]
        covered.append(best)
        root.append(begin)
    by_root: dict[int, tuple[int, int]] = {}
    for k, begin in enumerate(root):
        if begin not in by_root or covered[k] > by_root[begin][0]:
            by_root[begin] = (covered[k], fragments[k][0] + fragments[k][2])
    spans = [(fragments[begin][0], after, n) for begin, (n, after) in sorted(by_root.items())]
    out: list[tuple[int, int, int]] = []
    for span in spans:
        while out and out[-1][1] > span[0] and span[2] > out[-1][2]:
            out.pop()
        if not out or out[-1][1] <= span[0]:
            out.append(span)
    return out


class Scanner:
    """Phrases and templates over one automaton."""

    def __init__(self, phrases: Mapping[str, str], templates: list[tuple[str, str]], share: float = SHARE) -> None:
        spelled = [plain_words(t.encode()) for _, t in templates]
        parts = [plain_words(p.encode()) for p in phrases]
        if sum(map(len, spelled + parts)) > MOST:
            raise ValueError(f"templates of more than {MOST} words")
        if any(len(s) < LONG for s in spelled) or any(len(p) < 2 for p in parts):
            raise ValueError(f"a template has at least {LONG} words, a phrase two")
        self.share = share
        self.number: dict[bytes, int] = {}
        numbered = [[self.number.setdefault(w, len(self.number)) for w in s] for s in spelled + parts]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(s) for s in spelled]
        self.phrase_labels = list(phrases.values())
        self.automaton = Automaton(numbered, LONG)
        own = defaultdict(list)
        for k, sequence in enumerate(numbered[len(spelled):]):
            own[self.automaton.state_of(sequence)].append((k, len(sequence)))
        self.phrase_ends: list[list[tuple[int, int]]] = []
        for state in range(len(self.automaton.step)):
            found, up = [], state
            while up > 0:
                found += own.get(up, [])
                up = self.automaton.link[up]
            self.phrase_ends.append(found)
        self.pairs = np.unique([a * len(self.number) + b for s in numbered for a, b in zip(s, s[1:], strict=False)])

    def stretches(self, documents: list[list[bytes]]) -> Iterator[tuple[int, int, list[int]]]:
        """(document, place, numbers) of stretches of words whose neighbours are neighbours in some template or phrase."""
        sizes = [len(d) for d in documents]
        flat = np.full(sum(sizes) + len(sizes), -1, np.int64)  # a gap after each document
        begins, at = [], 0
        get = self.number.get
        for words, size in zip(documents, sizes, strict=True):
            flat[at : at + size] = [get(w, -1) for w in words]
            begins.append(at)
            at += size + 1
        both = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
        codes = flat[both] * len(self.number) + flat[both + 1]
        place = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        both = both[self.pairs[place] == codes]
        cuts = np.flatnonzero(np.diff(both) != 1)
        firsts, lasts = both[np.r_[0, cuts + 1]] if len(both) else both, both[np.r_[cuts, len(both) - 1]] if len(both) else both
        which = np.searchsorted(np.array(begins, np.int64), firsts, side="right") - 1
        for k, first, last in zip(which.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
            yield k, first - begins[k], flat[first : last + 2].tolist()

    def scan(self, documents: list[list[bytes]]) -> list[dict]:
        """For each document its phrase places (phrase, first word) and its template spans."""
        places: list[list[tuple[int, int]]] = [[] for _ in documents]
        fragments: list[dict[int, list]] = [defaultdict(list) for _ in documents]
        for k, begin, numbers in self.stretches(documents):
            before, held = 0, 0
            for at, (state, length) in enumerate(self.automaton.statistics(numbers), begin + 1):
                for phrase, size in self.phrase_ends[state]:
                    if size <= length:
                        places[k].append((phrase, at - size))
                if length <= held and held >= LONG:
                    self._add(fragments[k], before, at - 1, held)
                before, held = state, length
            if held >= LONG:
                self._add(fragments[k], before, begin + len(numbers), held)
        return [{"places": p, **self._spans(f)} for p, f in zip(places, fragments, strict=True)]

    def _add(self, fragments: dict[int, list], state: int, after: int, length: int) -> None:
        for template, end in self.automaton.places[state]:
            if template < len(self.sizes):
                fragments[template].append((after - length, end - length, length))

    def _spans(self, fragments: dict[int, list]) -> dict:
        spans, score = [], 0.0
        for template, found in fragments.items():
            for first, after, covered in chains(found, self.sizes[template]):
                share = covered / self.sizes[template]
                score = max(score, share)
                if share >= self.share:
                    spans.append({"first_word": first, "after_word": after, "label": self.labels[template], "share": share})
        return {"spans": sorted(spans, key=lambda s: (s["first_word"], s["after_word"], s["label"], -s["share"])), "score": score}


@lru_cache(maxsize=2)
def _scanner(phrases: tuple, templates: tuple, share: float) -> Scanner:
    return Scanner(dict(phrases), list(templates), share)


def license_scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: list[tuple[str, str]] = tuple(TEMPLATES),
    id_col: str = "doc_id", text_col: str = "text", share: float = SHARE,
) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, phrase ``places``, template ``spans`` and ``score``, the greatest share of a template that a chain covers."""
    places_kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
    spans_kind = pa.list_(pa.struct([("first_word", pa.int64()), ("after_word", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))
    known = tuple(phrases.items()), tuple(tuple(t) for t in templates), share
    Scanner(dict(phrases), list(templates), share)  # a wrong template fails here

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*known)
        for part in sliced(parts):
            documents = [plain_words(raw) for raw in text_bytes(part.column(1))]
            found = scanner.scan(documents)
            places = [[{"label": scanner.phrase_labels[p], "first_word": w} for p, w in f["places"]] for f in found]
            yield pa.record_batch([
                part.column(0), pa.array([len(d) for d in documents], pa.int64()), pa.array(places, places_kind),
                pa.array([f["spans"] for f in found], spans_kind), pa.array([f["score"] for f in found], pa.float64()),
            ], names=["doc_id", "n_words", "places", "spans", "score"])

    return plain(docs, id_col, text_col).mapInArrow(
        scan, "doc_id long, n_words long, places array<struct<label:string,first_word:bigint>>, "
        "spans array<struct<first_word:bigint,after_word:bigint,label:string,share:double>>, score double")


def digests(found: DataFrame) -> DataFrame:
    """Number of phrase places, the first and the last, the labels of phrases, all labels, and the score."""
    base, spans = F.col("places.label"), F.col("spans.label")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first_word").alias("first_word"), F.array_max("places.first_word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, spans)), ",").alias("labels"), "score",
    )
