"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm import kernels as K

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Sentences of public licenses and of the statements that name them, by label. Their number bounds what is broadcast.
TEMPLATES = {
    "agpl-3": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Released under the Apache License", "Licensed under the Apache License"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "boost": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Released under the BSD License",
    ],
    "cc-by-license": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl-2": ["This work is licensed under the GNU General Public License, version 2."],
    "gpl-3": ["This work is licensed under the GNU General Public License, version 3."],
    "gpl-notice": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl-3": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"],
}

#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Words of a line that counts as a block, in windows; what stands scattered over a longer line is no statement.
LINE_WINDOWS = 2
#: Words of a window for each word of the template: room for a few words of a comment's frame.
WINDOW = 1.25


def _words(text: str) -> list[bytes]:
    low = K.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = K.words(low, np.array([0, len(low)]))
    return [low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]


def _hash(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(K.span_hashes(K.prefix_hashes(data), np.array([0]), np.array([len(data)]))[0])


_ENDS_BLOCK = np.zeros(256, bool)
_ENDS_BLOCK[10] = True


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, words' starts, ends, hashes, first word of each text, and each word's block (its line)."""
    low = K.LOWER[data]
    starts, ends, first = K.words(low, offsets)
    hashes = K.span_hashes(K.prefix_hashes(low), starts, ends)
    lines = np.union1d(offsets[:-1], np.flatnonzero(_ENDS_BLOCK[data]) + 1)
    return low, starts, ends, hashes, first, np.searchsorted(lines, starts, "right") - 1


def template_frequencies(docs: DataFrame, templates: dict[str, list[str]]) -> dict[bytes, int]:
    """How many times the corpus holds each template word; one count for each word and task is shuffled."""
    vocabulary = sorted({w for group in templates.values() for t in group for w in _words(t)})
    known = np.array([_hash(w) for w in vocabulary], np.uint64)
    order = np.argsort(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, offsets in K.slices(batch.column(0)):
                hashes = _parts(data, offsets)[3]
                at = np.minimum(np.searchsorted(known[order], hashes), len(order) - 1)
                at = at[known[order][at] == hashes]
                total += np.bincount(order[at], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary, pa.binary()), pa.array(total)], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in vocabulary} | {bytes(r.word): r.n for r in rows}


class Entry:
    """One template: its distinct words, how many of them a block must hold, and which ones at any rate."""

    def __init__(self, label: str, text: str, containment: float) -> None:
        words = _words(text)
        self.label, self.words, self.width = label, frozenset(words), ceil(WINDOW * len(words))
        self.least = ceil(containment * len(self.words) - 1e-9)
        self.hashes = np.sort(np.array([_hash(w) for w in self.words], np.uint64))
        self.required: frozenset[bytes] = frozenset()
        self.rivals: list[Entry] = []


class TemplateIndex:
    """Templates with their words in order of global frequency, and the prefix words that any match must hold.

    Two templates of different labels are alike if they share at least the threshold of the
    shorter one's words. What tells a template apart from one alike is required of its
    blocks. Of two alike, one inside the other, the longer one wins where it stands around
    the words of the shorter one: some window of its own that covers the block's words of
    the shorter one, from the first to the last, is a block of the longer one (or the block
    itself is, where these words lie too far apart). So a statement of another license that
    differs in one word is no match.
    """

    def __init__(self, templates: dict[str, list[str]], frequency: dict[bytes, int], containment: float) -> None:
        self.entries = [e for label, group in templates.items() for e in (Entry(label, text, containment) for text in group) if e.words]
        for one in self.entries:
            for other in self.entries:
                if one.label != other.label and len(one.words & other.words) >= containment * min(len(one.words), len(other.words)) - 1e-9:
                    one.required |= one.words - other.words
                    if one.words < other.words:
                        one.rivals.append(other)
        vocabulary = sorted({w for e in self.entries for w in e.words}, key=lambda w: (frequency.get(w, 0), w))
        order = {w: k for k, w in enumerate(vocabulary)}
        self.reach = max((e.width for e in self.entries), default=0)
        prefixes: dict[int, list[tuple[int, int]]] = {}
        for number, entry in enumerate(self.entries):
            for place, w in enumerate(sorted(entry.words, key=order.get)[: len(entry.words) - entry.least + 1]):
                prefixes.setdefault(_hash(w), []).append((number, place))
        self.prefixes = prefixes
        self.known = np.array(sorted(prefixes), np.uint64)
        #: The vocabulary's hashes, sorted, and the place of each in the order by frequency.
        hashes = np.array([_hash(w) for w in vocabulary], np.uint64)
        by_hash = np.argsort(hashes)
        self.vocabulary, self.rank = hashes[by_hash], by_hash

    @staticmethod
    def enough(entry: Entry, have) -> bool:
        """Whether words are those of one of the entry's blocks, its rivals left out of account."""
        return all(w in have for w in entry.required) and sum(w in have for w in entry.words) >= entry.least

    def outdone(self, entry: Entry, words: list[bytes], lo: int, hi: int) -> bool:
        """Whether a rival stands around the entry's words in the block [lo, hi) of a text's words."""
        if not entry.rivals:
            return False
        own = [i for i in range(lo, hi) if words[i] in entry.words]
        a, b = own[0], own[-1] + 1
        for rival in entry.rivals:
            if b - a > rival.width:
                if self.enough(rival, set(words[lo:hi])):
                    return True
            elif any(self.enough(rival, set(words[i : i + rival.width])) for i in range(max(0, b - rival.width), a + 1)):
                return True
        return False

    def match(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, block: np.ndarray, first: np.ndarray) -> list[tuple[int, str, float]]:
        """(a word of the block, label, containment) of every template and line that match, and of every region with such windows."""
        out: list[tuple[int, str, float]] = []
        if not len(hashes) or not len(self.known):
            return out
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        places: dict[tuple[int, int], int] = {}
        near: dict[int, list[int]] = {}
        for i in np.flatnonzero(self.known[at] == hashes).tolist():
            for number, place in self.prefixes[int(hashes[i])]:
                key = (int(block[i]), number)
                places[key] = min(places.get(key, place), place)
                near.setdefault(number, []).append(i)
        def text_of(i: int, margin: int) -> tuple[int, list[bytes]]:
            """The words around word i, inside its text: the number of the first one, and the words."""
            t = int(np.searchsorted(first, i, "right")) - 1
            a, b = max(int(first[t]), i - margin), min(int(first[t + 1]), i + margin)
            return a, [low[x:y].tobytes() for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())]

        ranks: dict[int, np.ndarray] = {}
        for (b, number), place in places.items():
            entry = self.entries[number]
            lo, hi = (int(x) for x in np.searchsorted(block, (b, b + 1)))
            if not entry.least <= hi - lo <= LINE_WINDOWS * entry.width:  # length: too few words, or a line that is no block
                continue
            if b not in ranks:
                own = np.unique(hashes[lo:hi])
                spot = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
                ranks[b] = np.sort(self.rank[spot[self.vocabulary[spot] == own]])
            # Position: the line's first word of the template, in the order by frequency, stands at `place` of the template; no more
            # can be shared than the template words from there on, nor than the line's words of the vocabulary from that one on.
            after = len(ranks[b]) - int(np.searchsorted(ranks[b], self._rank_of(entry, place)))
            if min(len(entry.words) - place, after) < entry.least:
                continue
            have = {low[x:y].tobytes() for x, y in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())}
            if self.enough(entry, have):
                if entry.rivals:
                    a, words = text_of(lo, hi - lo + 2 * self.reach)
                    if self.outdone(entry, words, lo - a, hi - a):
                        continue
                out.append((lo, entry.label, len(entry.words & have) / len(entry.words)))
        for number, found in near.items():
            entry = self.entries[number]
            at = np.array(found)
            text = np.searchsorted(first, at, "right") - 1
            lo, hi = np.maximum(at - entry.width + 1, first[text]), np.minimum(at + entry.width, first[text + 1])
            fresh = np.concatenate(([True], lo[1:] >= hi[:-1]))
            lo, hi = lo[fresh], hi[np.append(np.flatnonzero(fresh)[1:] - 1, len(hi) - 1)]
            enough = K.sums(np.isin(hashes[K.ranges(lo, hi - lo)], entry.hashes), np.concatenate(([0], np.cumsum(hi - lo)))) >= entry.least
            for a, b in zip(lo[enough].tolist(), hi[enough].tolist()):
                c, words = text_of(a, b - a + 2 * self.reach)
                shared = self.most_shared(words, a - c, b - c, entry)
                if shared:
                    out.append((a, entry.label, shared / len(entry.words)))
        return out

    def _rank_of(self, entry: Entry, place: int) -> int:
        ranks = np.sort(self.rank[np.searchsorted(self.vocabulary, entry.hashes)])
        return int(ranks[place])

    def most_shared(self, words: list[bytes], lo: int, hi: int, entry: Entry) -> int:
        """The most distinct words of the entry in any of its windows in [lo, hi): `width` consecutive words, fewer where the text ends."""
        have: dict[bytes, int] = {}
        shared = best = 0
        for k in range(lo, hi + entry.width - 1):
            if k < hi:
                w = words[k]
                have[w] = have.get(w, 0) + 1
                shared += have[w] == 1 and w in entry.words
            start = k - entry.width + 1
            if start > lo:
                gone = words[start - 1]
                have[gone] -= 1
                if not have[gone]:
                    del have[gone]
                    shared -= gone in entry.words
            if start >= lo and shared >= max(entry.least, best + 1) and self.enough(entry, have) and not self.outdone(entry, words, start, min(k + 1, hi)):
                best = shared
        return best


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, containment: float = CONTAINMENT, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every whole text.

    A block is a window of consecutive words, over line ends, of WINDOW times the template's
    length (shorter where the text ends), or a line of at most LINE_WINDOWS times as many words. It carries a template's label if it holds
    at least `containment` of the template's distinct words and all that tell it apart from
    templates alike (see TemplateIndex); prefix words by global frequency propose, and the
    length and position filters prune before the sets are compared, so every such block is
    found. score is the best containment, 1 where a base phrase stands. Null or empty text
    has no words, labels '' and score 0; very long texts are scanned whole; repeated rows give
    repeated results, an empty table none; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    index = TemplateIndex(templates, template_frequencies(docs, templates), containment)
    base = [(_words(p), label) for p, label in phrases.items()]
    base = [(words, [np.uint64(_hash(w)) for w in words], label) for words, label in base]

    def scan(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, data, offsets in K.slices(batch.column(1)):
            low, starts, ends, hashes, first, block = _parts(data, offsets)
            n = hi - lo
            n_base, score = np.zeros(n, np.int64), np.zeros(n)
            place: list[list[int]] = [[] for _ in range(n)]
            base_labels: list[set[str]] = [set() for _ in range(n)]
            more: list[set[str]] = [set() for _ in range(n)]
            for words, wanted, label in base:
                size = len(words)
                hit = np.ones(max(0, len(hashes) - size + 1), bool)
                for k, h in enumerate(wanted):
                    hit &= hashes[k : k + len(hit)] == h
                for i in np.flatnonzero(hit).tolist():
                    doc = int(np.searchsorted(first, i, "right")) - 1
                    if i + size <= first[doc + 1] and all(low[starts[i + k] : ends[i + k]].tobytes() == w for k, w in enumerate(words)):
                        n_base[doc] += 1
                        place[doc].append(i - int(first[doc]))
                        base_labels[doc].add(label)
                        score[doc] = 1.0
            for i, label, share in index.match(low, starts, ends, hashes, block, first):
                doc = int(np.searchsorted(first, i, "right")) - 1
                more[doc].add(label)
                score[doc] = max(score[doc], share)
            yield {
                "doc_id": batch.column(0).slice(lo, n), "n_words": np.diff(first), "n_base": n_base,
                "first_word": pa.array([min(p) if p else None for p in place], pa.int64()), "last_word": pa.array([max(p) if p else None for p in place], pa.int64()),
                "base_labels": pa.array([",".join(sorted(x)) for x in base_labels], pa.string()), "labels": pa.array([",".join(sorted(x | y)) for x, y in zip(base_labels, more)], pa.string()), "score": score,
            }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return K.map_batches(docs, ["doc_id", "text"], scan, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
