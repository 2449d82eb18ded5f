"""Byte-level BPE over whole texts, with each distinct chunk encoded once per worker.

A chunk starts at white space that follows a printable non-space character, and at a stop
that follows a letter. The pre-tokeniser's pattern joins no stop to a letter. It lets white space stand only at the front of a token or in a token
of white space alone, and it looks ahead but never back, so a token always ends there:
the tokens of a text are those of its chunks in order. Special strings hold no white space
and thus stay inside one chunk.
"""

from __future__ import annotations

import json
import os

import numpy as np

from catalume.llm import kernels as K

#: Distinct chunks that a worker remembers; beyond that it starts anew.
CACHE_CHUNKS = 900_000
#: Bytes of text whose chunks are looked up at once, which bounds a worker's memory; longer texts come in parts.
TEXT_BYTES = 512 << 10
#: Characters that go to the tokeniser in one call.
CALL_BYTES = 256 << 10


#: Punctuation that ends a chunk when it follows a letter; no special string holds it.
STOPS = np.zeros(256, bool)
STOPS[list(b",.;:!?")] = True


class ChunkTokenizer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        sizes = {i: len(t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: len(t["content"].encode()) for t in spec["added_tokens"]}
        self.size = np.zeros(max(sizes) + 1, np.int64)
        self.size[list(sizes)] = list(sizes.values())
        self.kind = np.uint16 if len(self.size) <= 1 << 16 else np.uint32
        self.reset()

    def reset(self) -> None:
        self.slot = K.Memo()
        self.count = np.zeros(1024, np.int32)
        self.begin = np.zeros(1024, np.int64)
        self.ids = np.zeros(8192, self.kind)
        self.used = 0

    @staticmethod
    def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and for each text the index of its first chunk."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 1:
            solid = (data > 0x20) & (data < 0x7F)
            solid[1:] |= (data[1:] >= 0x80) & (data[:-1] == 0xC3)  # U+00C0-U+00FF; other wide characters may be spaces
            letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
            letter[1:] |= (data[1:] >= 0x80) & (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            cut[1:n] = K.SPACE[data[1:]] & solid[:-1] | STOPS[data[1:]] & letter[:-1]
        cut[offsets] = True
        starts = np.flatnonzero(cut[:n])
        return starts, np.append(starts[1:], n) if len(starts) else starts, np.searchsorted(starts, offsets)

    def slots(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each chunk, and for each text the index of its first chunk."""
        if len(self.slot) > CACHE_CHUNKS:
            self.reset()
        starts, ends, first = self.chunks(data, offsets)
        if not len(starts):
            return starts, first
        unique, at, inverse = np.unique(K.span_hashes(K.prefix_hashes(data), starts, ends), return_index=True, return_inverse=True)
        known = self.slot.get(unique)
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = np.arange(len(self.slot), len(self.slot) + len(new))
            self.learn(data, starts[at[new]], ends[at[new]])
            self.slot.add(unique[new])
        return known[inverse], first

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes the chunks and keeps their ids in the next slots."""
        last, before = data[ends - 1], data[np.maximum(ends - 2, starts)]
        plain = K.SPACE[data[starts]] & (((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (before == 0xC3)))
        counts = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (chunk of each token, ids)
        size = ends - starts
        rows = np.flatnonzero(plain)
        cuts = np.searchsorted(np.cumsum(size[rows]), np.arange(CALL_BYTES, size[rows].sum() + CALL_BYTES, CALL_BYTES)) if len(rows) else []
        lo = 0
        for hi in [*np.unique(cuts).tolist(), len(rows)]:
            own = rows[lo:hi]
            if len(own):
                text = data[K.ranges(starts[own], size[own])].tobytes().decode()
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
                where = np.searchsorted(np.cumsum(size[own]), np.cumsum(self.size[ids]) - 1, "right")
                found.append((own[where], ids))
            lo = hi
        odd = np.flatnonzero(~plain)
        for lo in range(0, len(odd), 512):
            own = odd[lo : lo + 512]
            for k, e in zip(own.tolist(), self.tokenizer.encode_batch_fast([data[starts[k] : ends[k]].tobytes().decode() for k in own.tolist()], add_special_tokens=False)):
                found.append((np.full(len(e.ids), k), np.array(e.ids, np.int64)))
        where = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
        ids = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
        ids = ids[np.argsort(where, kind="stable")]
        np.add.at(counts, where, 1)
        base, n = len(self.slot), len(starts)
        while len(self.count) < base + n:
            self.count, self.begin = (np.concatenate((x, np.zeros_like(x))) for x in (self.count, self.begin))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.count[base : base + n] = counts
        self.begin[base : base + n] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        slots, first = self.slots(data, offsets)
        return K.sums(self.count[slots].astype(np.int64), first)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the tokens of each text."""
        slots, first = self.slots(data, offsets)
        count = self.count[slots].astype(np.int64)
        return self.ids[K.ranges(self.begin[slots], count)], K.sums(count, first)


_LOADED: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokeniser; tasks that the same worker runs share what it remembers."""
    if path not in _LOADED:
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]


def safe_parts(data: np.ndarray, offsets: np.ndarray, limit: int = TEXT_BYTES) -> list[tuple[int, int]]:
    """[start, end) parts of one long text of about `limit` bytes, cut where chunks start."""
    starts = ChunkTokenizer.chunks(data, offsets)[0]
    cuts = [0]
    while len(data) - cuts[-1] > limit:
        k = int(np.searchsorted(starts, cuts[-1] + limit, "right")) - 1
        at = int(starts[k]) if starts[k] > cuts[-1] else int(starts[k + 1]) if k + 1 < len(starts) else len(data)
        cuts.append(at)
        if at == len(data):
            break
    if cuts[-1] != len(data):
        cuts.append(len(data))
    return list(zip(cuts[:-1], cuts[1:]))
