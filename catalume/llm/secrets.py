"""Secret scans: credential patterns, and guess costs of values in a credential context."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catalume.llm import kernels as K

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: A wider credential context; what stands in it is flagged by its guess cost alone.
_CONTEXT = re.compile(r"""(?:password|passwd|passphrase|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key)["']?\s*(?:[:=]|\bis\b)\s*["']?([^\s"'<>]+)""", re.I | re.A)
_HINTS = [b"passw", b"passphrase", b"pwd", b"secret", b"token", b"credential", b"key"]
KINDS = ("assign", "access", "hex", "guess")

#: Guesses (log10) from which a value in a credential context counts as a secret: three years' work for one who tries
#: ten billion a second. One threshold for values of all kinds; prose stays below it, as its words or its pairs of
#: letters are those of the word list.
GUESS_LOG10 = 18.0
#: What it costs to guess that the next character of a brute-force span is of another kind (letter, digit, mark).
KIND_CHANGE = 0.5
#: Length of the longest block that a repeat may consist of.
REPEAT_BLOCK = 64
#: Characters from the ends of a long run (a repeat or a keyboard walk) in which a segment may end.
RUN_EDGE = 32

#: Words that guessers try first, most common first; the public word list follows them.
COMMON = (
    "password secret token admin root user login welcome letmein master hello test example changeme default guest qwerty "
    "dragon monkey shadow sunshine princess football baseball superman batman summer winter spring autumn monday friday "
    "love money freedom whatever trustno hunter ranger buster soccer hockey killer george charlie michael jordan "
    "the and of to in is it you that he was for on are with as his they be at one have this from or had by word but not "
    "key api pass passwd value none null true false your here my our new old data server client service account public private"
).split()
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_BESIDE = {(a, b) for row in _ROWS for a, b in zip(row, row[1:])}
_BESIDE |= {(b, a) for a, b in _BESIDE} | {(a, b) for up, down in zip(_ROWS, _ROWS[1:]) for k, a in enumerate(up) for b in down[max(0, k - 1) : k + 1]}
_DAY, _MONTH, _YEAR, _MARK = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d", "[-./_]?"
#: Dates (year, month and day in any usual order, with or without marks), then months and years.
_DATES = [re.compile(x) for x in (
    f"{_YEAR}{_MARK}{_MONTH}{_MARK}{_DAY}", f"{_DAY}{_MARK}{_MONTH}{_MARK}{_YEAR}", f"{_MONTH}{_MARK}{_DAY}{_MARK}{_YEAR}",
    rf"{_DAY}{_MARK}{_MONTH}{_MARK}\d\d", rf"{_MONTH}{_MARK}{_DAY}{_MARK}\d\d", f"{_YEAR}{_MARK}{_MONTH}", f"{_MONTH}{_MARK}{_YEAR}", _YEAR)]
_DATE_COST = [log10(365 * 119 * 4)] * 5 + [log10(12 * 119 * 4)] * 2 + [log10(119)]
_LEET = str.maketrans("013457@$!", "oleastasi")
_JOINTS = "-_. "
_PLACE = log10(2)


def _ends(least: int, most: int, size: int) -> Iterator[int]:
    """The numbers from least to most, without those far from both ends of a long run of steps of `size`."""
    edge = max(1, RUN_EDGE // size)
    if most - least <= 2 * edge:
        yield from range(least, most + 1)
    else:
        yield from range(least, least + edge)
        yield from range(most - edge + 1, most + 1)


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


class Guesser:
    """Guess costs with the words of a public word list: a tokeniser's vocabulary, in whose order common words come first."""

    def __init__(self, words_file: str | None = None) -> None:
        words = list(COMMON)
        if words_file:
            with open(words_file) as f:
                vocabulary = json.load(f)["model"]["vocab"]
            words += [w for w, _ in sorted(((w.removesuffix("</w>"), i) for w, i in vocabulary.items() if w.endswith("</w>")), key=lambda x: x[1]) if len(w) > 1 and w.isalpha()]
        self.rank = {w: k for k, w in reversed(list(enumerate(words, 1)))}
        self.longest = max(map(len, self.rank))
        # Brute force tries letters in the order of the word list's pairs of letters, half of the time.
        pairs = np.full((27, 26), 1e-6)
        for w, k in self.rank.items():
            for a, b in zip(" " + w, w):
                if "a" <= b <= "z":
                    pairs[ord(a) - 96 if "a" <= a <= "z" else 0, ord(b) - 97] += 1 / (k + 100)
        pairs /= pairs.sum(1, keepdims=True)
        self.letters = (-np.log10(0.5 / 26 + 0.5 * pairs)).tolist()
        self.known: dict[str, float] = {}

    def character(self, value: str, low: str, i: int) -> float:
        """One more character of a brute-force span."""
        c, before = low[i], low[i - 1] if i else " "
        change = KIND_CHANGE if i and _alphabet(value[i]) != _alphabet(value[i - 1]) else 0.0
        if not "a" <= c <= "z":
            return change + log10(_alphabet(value[i]))
        return change + self.letters[ord(before) - 96 if "a" <= before <= "z" else 0][ord(c) - 97] + (0.3 if value[i] != c else 0.0)

    def cost(self, value: str) -> float:
        """log10 of the guesses that find the value: the cheapest segmentation into words, dates, repeats, keyboard walks and brute-force spans.

        Dynamic programming over ends; every segment adds its own cost and a factor for its
        place. A repeat costs its block and the number of times. Time is linear in the
        length, as words, dates and repeated blocks are bounded and the ends of runs are
        carried along; a segment may end anywhere in a run of up to twice RUN_EDGE characters,
        within RUN_EDGE of either end in a longer one. The empty value costs 0.
        """
        if value in self.known:
            return self.known[value]
        n, low = len(value), value.lower()
        if len(low) != n:  # a character whose lower case has another length
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = low.translate(_LEET)
        best = [0.0] + [float("inf")] * n
        # From each start the end of the keyboard walk, and for each length of block how far the value repeats itself.
        walk, again = [0] * n, {}
        for i in range(n - 1, -1, -1):
            walk[i] = walk[i + 1] if i + 1 < n and (low[i], low[i + 1]) in _BESIDE else i + 1
        codes = np.array([ord(c) for c in value], np.int64)
        for size in range(1, min(REPEAT_BLOCK, n // 2) + 1):
            same = codes[size:] == codes[:-size]
            stop = np.where(same, n, np.arange(n - size))
            ends = np.minimum.accumulate(stop[::-1])[::-1].clip(max=n - size)
            for i in np.flatnonzero(ends - np.arange(n - size) >= max(size, 2)).tolist():
                again.setdefault(i, []).append((size, int(ends[i]) - i))
        for i in range(n):
            at = best[i]

            def put(end: int, cost: float) -> None:
                if at + cost < best[end]:
                    best[end] = at + cost

            put(i + 1, self.character(value, low, i))
            if value[i] in _JOINTS:
                put(i + 1, log10(len(_JOINTS)))
            for end in range(i + 2, min(n, i + self.longest) + 1):
                for text, more in ((low, 0.0), (plain, 0.5)):
                    rank = self.rank.get(text[i:end])
                    if rank:
                        upper = 0.0 if value[i:end] == low[i:end] else 0.3 if value[i + 1 : end].islower() or value[i:end].isupper() else 1.0
                        put(end, log10(rank + 1) + more + upper + _PLACE)
            for size, run in again.get(i, ()):
                block = self.cost(value[i : i + size]) + _PLACE
                for times in _ends(2, run // size + 1, size):
                    if times * size > 2:
                        put(i + times * size, block + log10(times))
            if walk[i] - i >= 3:
                for size in _ends(3, walk[i] - i, 1):
                    put(i + size, log10(47 * 4.5 * size) + _PLACE)
            for pattern, cost in zip(_DATES, _DATE_COST):
                m = pattern.match(value, i)
                if m:
                    put(m.end(), cost + _PLACE)
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[value] = best[n]
        return best[n]


_GUESSERS: dict[str | None, Guesser] = {}


def guesser(words_file: str | None = None) -> Guesser:
    """The worker's guesser."""
    if words_file not in _GUESSERS:
        _GUESSERS[words_file] = Guesser(words_file)
    return _GUESSERS[words_file]


def spans(text: str, words_file: str | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind: the three patterns' matches and costly values ("guess")."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    for m in _CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:!?)]}")
        if guesser(words_file).cost(value) >= GUESS_LOG10:
            out.append(("guess", m.start(1), m.start(1) + len(value)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that any pattern could match: a keyword, AKIA, or a run of 16 hexadecimal digits."""
    out = np.zeros(len(offsets) - 1, bool)
    raw, low = data.tobytes(), K.LOWER[data].tobytes()
    for hint, text in [(h, low) for h in _HINTS] + [(b"AKIA", raw)]:
        at = text.find(hint)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, "right")) - 1
            out[k] = True
            at = text.find(hint, int(offsets[k + 1]))
    hexed = np.zeros(256, bool)
    hexed[48:58] = hexed[97:103] = True
    starts, ends, first = K.words(data, offsets, hexed)  # runs end where their text ends
    out[np.searchsorted(first, np.flatnonzero(ends - starts >= 16), "right") - 1] = True
    return out


def _scan(column: pa.Array, words_file: str | None) -> Iterator[tuple[int, int, dict[int, list[tuple[str, int, int]]]]]:
    for lo, hi, data, offsets in K.slices(column):
        found = {}
        for k in np.flatnonzero(suspects(data, offsets)).tolist():
            own = spans(data[offsets[k] : offsets[k + 1]].tobytes().decode(), words_file)
            if own:
                found[k] = own
        yield lo, hi, found


def secret_spans(docs: DataFrame, words_file: str | None = None) -> DataFrame:
    """doc_id and its array of spans (kind, start, end) over the whole text, in one pass without a shuffle.

    words_file is the tokeniser vocabulary that serves as the guesser's word list; without
    one it knows the common passwords alone. Null or empty text has no spans; very long texts
    are scanned whole; repeated rows give repeated results; an empty table gives none; other
    columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, found in _scan(batch.column(1), words_file):
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in found.get(i, ())] for i in range(hi - lo)]
            yield {"doc_id": batch.column(0).slice(lo, hi - lo), "spans": pa.array(rows, kind)}

    return K.map_batches(docs, ["doc_id", "text"], scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def mask_secrets(docs: DataFrame, mark: str = "<SECRET>", words_file: str | None = None) -> DataFrame:
    """docs, with all their columns, where each secret span of the text is replaced by `mark`; overlapping spans are one.

    Every row stays, repeated ones too; null stays null, empty stays empty, and a text
    without secrets stays as it is.
    """

    def replace(text: str, own: list[tuple[str, int, int]]) -> str:
        out, at = [], 0
        for _, a, b in own:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index("text")
            column = batch.column(where)
            changed = {lo + k: own for lo, _, found in _scan(column, words_file) for k, own in found.items()}
            if changed:
                texts = column.to_pylist()
                for k, own in changed.items():
                    texts[k] = replace(texts[k], own)
                batch = batch.set_column(where, batch.schema.field(where), pa.array(texts, column.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
