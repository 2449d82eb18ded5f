"""Vectorised byte kernels that the operators run inside Arrow batches.

A batch of texts is seen as one flat UTF-8 buffer with document offsets. Substring hashes
are polynomial prefix sums modulo the prime 2**61 - 1: two different strings of at most n
bytes collide for at most n of the 2**61 - 1 possible roots, so the chance is n / 2**61
for texts that were not made against the fixed root. A hash proposes a match; whoever takes
it for identity says so and relies on this bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of text that a kernel works on at once; longer texts come alone.
SLICE_BYTES = 2 << 20

_ROOT = 0x9E3779B97F4A7C15
_PRIME = 2**61 - 1
_P, _61, _31, _30 = (np.uint64(x) for x in (_PRIME, 61, 31, 30))
_LOW31, _LOW30 = np.uint64(2**31 - 1), np.uint64(2**30 - 1)
#: Base of the polynomial, and its powers and their inverses from 0 on, made longer as needed.
_BASE = _ROOT % _PRIME
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Elements that a step works on, so that its intermediate arrays stay in the processor's cache. Sums of so many
#: products of 9 bits of code and 32 bits of power fit 64 bits.
_STEP = 1 << 15

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**64."""
    x = (x & _P) + (x >> _61)
    x -= _P * (x >= _P)
    return x


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from 31-bit halves."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + a0 * b0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers below n and their inverses."""
    while len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, _PRIME))):
            have, by = _POWERS[k], np.uint64(pow(base, len(_POWERS[k]), _PRIME))
            _POWERS[k] = np.concatenate([have, *(_times(have[lo : lo + _STEP], by) for lo in range(0, len(have), _STEP))])
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums modulo the prime, from which `span_hashes` takes the hash of any substring."""
    out, carry = np.zeros(len(data) + 1, np.uint64), np.uint64(0)
    power = powers(len(data))[0]
    for lo in range(0, len(data), _STEP):
        code, own = data[lo : lo + _STEP].astype(np.uint64) + np.uint64(1), power[lo : lo + _STEP]
        low = _reduced(np.cumsum(code * (own & np.uint64(0xFFFFFFFF))))
        # The high halves count 2**32 each: x * 2**32 = (x >> 29) + ((x & (2**29 - 1)) << 32) modulo the prime.
        high = np.cumsum(code * (own >> np.uint64(32)))
        total = _reduced(low + (high >> np.uint64(29)) + ((high & np.uint64(2**29 - 1)) << np.uint64(32)) + carry)
        out[lo + 1 : lo + 1 + len(code)] = total
        carry = total[-1]
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash for each substring [start, end): 61 bits of content, spread over 64."""
    inverse, out = powers(len(prefix))[1], np.empty(len(start), np.uint64)
    for lo in range(0, len(start), _STEP):
        a, b = start[lo : lo + _STEP], end[lo : lo + _STEP]
        out[lo : lo + _STEP] = mix(_times(_reduced(prefix[b] + (_P - prefix[a])), inverse[a]) ^ ((b - a).astype(np.uint64) << _61))
    return out


class Memo:
    """Numbers, in order of arrival, of the hashes that a worker remembers.

    Two sorted arrays of 12 bytes a hash together: a dict of as many Python integers takes
    about 100, in small objects whose memory a worker that Spark uses again hardly gives back.
    """

    def __init__(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.known)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each of the sorted hashes; -1 where it is not known."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.number[at], -1).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        """Gives the next numbers to sorted hashes that are not known."""
        at, n = np.searchsorted(self.known, hashes), len(self.known)
        self.known = np.insert(self.known, at, hashes)
        self.number = np.insert(self.number, at, np.arange(n, n + len(hashes), dtype=np.int32))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document its first word's index (one more at the end)."""
    inside = kind[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words from the words' hashes; the caller drops runs over a document's end."""
    total = max(0, len(hashes) - n + 1)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out = out * np.uint64(_ROOT) + hashes[k : k + total]
    return mix(out)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length) of all rows."""
    total = int(length.sum())
    out = np.arange(total)
    shift = start - np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else start
    return out + np.repeat(shift, length)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over [bounds[i], bounds[i + 1])."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = np.frombuffer(texts.buffers()[1] or b"\0" * 8, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes; a longer text comes alone and whole."""
    data, at = flat(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def map_batches(df: DataFrame, columns: list[str], function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch | dict]], schema: str) -> DataFrame:
    """`function` over Arrow batches of the named columns; it yields dicts of arrays in the order of `schema`."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in function(batch):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)

    return df.select(*columns).mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose `column` passes; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch.column(batch.schema.get_field_index(column)))))

    return df.mapInArrow(run, df.schema)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key, from batches sorted by the key; null sorts together too."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
