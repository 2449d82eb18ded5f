"""Suffix-array dedup: every byte inside a 100-byte string that also starts earlier in the corpus.

Suffixes are sampled at content-defined anchors. A string of SPAN bytes holds WINDOW grams
of GRAM bytes; its anchor is the leftmost one of least hash, so equal strings have their
anchors at the same place. An anchor's strings are cut into units of at most BLOCK starts,
and all strings of a unit share its core of CORE bytes: a unit can repeat only where its
core does.

Documents are dealt into groups of GROUP_BYTES. Each group sends the hashes of its cores,
learns which ones other groups hold too, sorts the suffixes of such units, settles what
repeats inside the group, and sends the rest as sorted, front-coded runs dealt by core.
A core that HOT_GROUPS groups hold (a common line in ever new surroundings) is not enough
to propose: the hashes of its whole strings are exchanged as well, and the strings that
other groups hold too are dealt by these hashes, so that no bucket grows with the core.
Runs are merged by a loser tree that carries common-prefix lengths; strings are equal
where the merged prefix lengths and the bytes to the left agree. Marks go back to the groups.
The hash of a core only proposes: what is removed has been compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm import kernels as K
from catalume.llm.common import written

SPAN = 100
GRAM = 20
WINDOW = SPAN - GRAM + 1
BLOCK = 41
CORE = SPAN - BLOCK + 1
#: Bytes of text in a group, which one task holds at a time.
GROUP_BYTES = 4 << 20
#: Groups that hold a core from which its strings are looked at one by one.
HOT_GROUPS = 64

_GRAM_ROOT = 0x9E3779B97F4A7C15
_GRAM_CODE = K.mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = 24
_CHUNK = 1 << 22


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling; it only has to be the same for equal bytes."""
    width, h, done, out = 1, _GRAM_CODE[data], 0, None
    while True:
        if GRAM & width:  # the bits of GRAM from the lowest on, each part in front of those before
            out = h.copy() if out is None else h[: len(out) - width] * np.uint64(pow(_GRAM_ROOT, done, 2**64)) + out[width:]
            done += width
        if done == GRAM:
            return K.mix(out)
        h = h[:-width] * np.uint64(pow(_GRAM_ROOT, width, 2**64)) + h[width:]
        width *= 2


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, least, most, core hash): strings start at place - least, ..., place - most, counted back from the place."""
    prefix = K.prefix_hashes(data)
    n = len(data)
    starts = np.zeros(n + 1, np.int64)
    size = np.diff(offsets)
    long = size >= SPAN
    np.add.at(starts, offsets[:-1][long], 1)
    np.add.at(starts, offsets[1:][long] - SPAN + 1, -1)
    begins = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
    if not len(begins):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    anchor = np.empty(len(begins), np.int64)
    for lo in range(int(begins[0]), int(begins[-1]) + 1, _CHUNK):
        a, b = np.searchsorted(begins, (lo, lo + _CHUNK))
        if a == b:
            continue
        at = np.arange(lo, min(lo + _CHUNK + WINDOW, n - GRAM + 1))
        best = (_gram_hashes(data[lo : lo + len(at) + GRAM - 1]) >> np.uint64(_PLACE) << np.uint64(_PLACE)) | (at - lo).astype(np.uint64)
        width = 1
        while width * 2 <= WINDOW:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < WINDOW:
            best = np.minimum(best[: len(best) - (WINDOW - width)], best[WINDOW - width :])
        anchor[a:b] = (best[begins[a:b] - lo] & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + lo
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (begins[1:] != begins[:-1] + 1))))
    last = np.append(first[1:], len(begins)) - 1
    x, most, least = anchor[first], anchor[first] - begins[first], anchor[first] - begins[last]
    out = []
    for j in range(ceil(WINDOW / BLOCK)):
        keep = (least < (j + 1) * BLOCK) & (most >= j * BLOCK)
        out.append((x[keep] - j * BLOCK, np.maximum(least[keep] - j * BLOCK, 0), np.minimum(most[keep] - j * BLOCK, BLOCK - 1)))
    place, low, high = (np.concatenate(c) for c in zip(*out))
    order = np.argsort(place, kind="stable")
    place, low, high = place[order], low[order], high[order]
    return place, low, high, K.span_hashes(prefix, place, place + CORE)


def _bits(least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Masks with the bits least, ..., most."""
    one = np.uint64(1)
    return ((one << (most + 1).astype(np.uint64)) - one) & ~((one << least.astype(np.uint64)) - one)


def resolve(common: np.ndarray, left: np.ndarray, mask: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which strings of each unit have an earlier equal one here: masks in the order of the units.

    Units are sorted by their suffixes; common[i] is the prefix length that unit i shares
    with unit i - 1, left their bytes backwards from the place, rank their order in the corpus.
    """
    repeated = np.zeros(len(mask), np.uint64)
    by_rank = np.argsort(rank, kind="stable")
    hashed = np.zeros(len(mask), np.uint64)
    for b in range(BLOCK):
        if b:
            hashed = (hashed + left[:, b - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        own = by_rank[(mask[by_rank] >> np.uint64(b)) & np.uint64(1) > 0]
        if len(own) < 2:
            continue
        run = np.cumsum(common < SPAN - b)
        key = K.mix(hashed[own] ^ (run[own].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        leader = own[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        wrong = (run[leader] != run[own]) | (left[leader, :b] != left[own, :b]).any(1)
        if wrong.any():  # hashes collided: group by the bytes themselves
            seen: set[tuple[int, bytes]] = set()
            for i in sorted(own.tolist(), key=lambda i: rank[i]):
                name = (int(run[i]), left[i, :b].tobytes())
                if name in seen:
                    repeated[i] |= np.uint64(1 << b)
                seen.add(name)
        else:
            repeated[own[~fresh]] |= np.uint64(1 << b)
    return repeated


def suffixes(data: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes (SPAN bytes, zero beyond what the unit's strings reach), their lengths, and the bytes to the left, backwards."""
    size = SPAN - least
    column = np.arange(SPAN)
    right = data[np.minimum(place[:, None] + column, len(data) - 1)]
    right[column >= size[:, None]] = 0
    back = np.arange(1, BLOCK)
    left = data[np.maximum(place[:, None] - back, 0)]
    left[back > most[:, None]] = 0
    return right, size, left


def shared_prefix(right: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it."""
    out = np.zeros(len(right), np.int64)
    if len(right) > 1:
        differ = right[1:] != right[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), SPAN)
    return out


def sort_rows(right: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(right).view(f"S{SPAN}").ravel(), kind="stable")


def front_coded(right: np.ndarray, size: np.ndarray, left: np.ndarray, most: np.ndarray, doc: np.ndarray, place: np.ndarray, row: np.ndarray, mask: np.ndarray) -> bytes:
    """A sorted run: for each suffix only what follows the prefix it shares with the one before."""
    common = np.minimum(shared_prefix(right), size)
    column = np.arange(SPAN)
    tails = right[(column >= common[:, None]) & (column < size[:, None])]
    lefts = left[np.arange(1, BLOCK) <= most[:, None]]
    head = np.array([len(size), len(tails), len(lefts)], np.int64)
    raw = b"".join((head.tobytes(), doc.astype(np.int64).tobytes(), mask.tobytes(), place.astype(np.int64).tobytes(), row.astype(np.int32).tobytes(), common.astype(np.uint8).tobytes(), size.astype(np.uint8).tobytes(), most.astype(np.uint8).tobytes(), tails.tobytes(), lefts.tobytes()))
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


class Run:
    """A decoded run."""

    def __init__(self, raw: bytes) -> None:
        raw = pa.decompress(raw[8:], int(np.frombuffer(raw, np.int64, 1)[0]), "zstd", asbytes=True)
        n, tails, lefts = np.frombuffer(raw, np.int64, 3).tolist()
        at = 24
        parts = []
        for kind, count in (("i8", n), ("u8", n), ("i8", n), ("i4", n), ("u1", n), ("u1", n), ("u1", n), ("u1", tails), ("u1", lefts)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        self.doc, self.mask, self.place, self.row, common, size, most, tail, left = parts
        self.common = common.tolist()
        self.left = np.zeros((n, BLOCK - 1), np.uint8)
        self.left[np.arange(1, BLOCK) <= most[:, None]] = left
        self.text: list[bytes] = []
        text, at, before = tail.tobytes(), 0, b"\0" * SPAN
        for c, s in zip(self.common, size.tolist()):
            before = (before[:c] + text[at : at + s - c]).ljust(SPAN, b"\0")
            at += s - c
            self.text.append(before)


def merge(runs: list[Run]) -> tuple[list[int], list[int]]:
    """The order of all rows (as run number, run after run) and the prefix each shares with the one before.

    Each loser keeps the length of the prefix it shares with what went out last. Unequal
    lengths decide a match without a look at the bytes; equal ones compare only what follows.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    texts = [r.text for r in runs]
    commons = [r.common for r in runs]
    at = [0] * len(runs)
    loser, kept = [-1] * k, [-1] * k

    def play(run: int, common: int, node: int) -> tuple[int, int]:
        """The winner (run, its shared prefix) on the way from the node up; losers stay."""
        while node:
            other, theirs = loser[node], kept[node]
            if theirs > common:
                loser[node], kept[node], run, common = run, common, other, theirs
            elif theirs == common and common >= 0:
                mine, his = texts[run][at[run]][common:], texts[other][at[other]][common:]
                if mine == his:
                    kept[node] = SPAN
                else:
                    differ = int.from_bytes(mine, "big") ^ int.from_bytes(his, "big")
                    shared = SPAN - (differ.bit_length() + 7 >> 3)
                    if his < mine:
                        loser[node], run, other = run, other, run
                    kept[node] = shared
            node >>= 1
        return run, common

    # Leaves enter one after the other: the first to reach an empty node waits there for its rival.
    empty = [True] * k
    champion = (-1, -1)
    for leaf in range(k):
        run, common = (leaf, 0) if leaf < len(runs) and texts[leaf] else (leaf, -1)
        node = leaf + k >> 1
        while node and not empty[node]:
            other, theirs = loser[node], kept[node]
            if theirs > common:
                loser[node], kept[node], run, common = run, common, other, theirs
            elif theirs == common and common >= 0:
                mine, his = texts[run][0], texts[other][0]
                differ = int.from_bytes(mine, "big") ^ int.from_bytes(his, "big")
                if his < mine:
                    loser[node], run = run, other
                kept[node] = SPAN - (differ.bit_length() + 7 >> 3)
            node >>= 1
        if node:
            empty[node], loser[node], kept[node] = False, run, common
        else:
            champion = (run, common)
    order, shared = [], []
    run, common = champion
    while common >= 0:
        order.append(run)
        shared.append(common)
        at[run] += 1
        common = commons[run][at[run]] if at[run] < len(texts[run]) else -1
        run, common = play(run, common, run + k >> 1)
    return order, shared


def merged_marks(payloads: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(group, marks) of the strings that repeat among the runs of one bucket."""
    groups, runs = [g for g, _ in payloads], [Run(raw) for _, raw in payloads]
    order, shared = merge(runs)
    order = np.array(order, np.int64)
    base = np.concatenate(([0], np.cumsum([len(r.text) for r in runs])))
    index = np.empty(len(order), np.int64)
    for k in range(len(runs)):
        index[order == k] = np.arange(base[k], base[k + 1])
    doc, mask, place, row = (np.concatenate([getattr(r, c) for r in runs])[index] for c in ("doc", "mask", "place", "row"))
    left = np.concatenate([r.left for r in runs])[index]
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((place, row, doc))] = np.arange(len(doc))
    repeated = resolve(np.array(shared, np.int64), left, mask, rank)
    for k, g in enumerate(groups):
        own = (order == k) & (repeated > 0)
        if own.any():
            yield g, marks(row[own], place[own], repeated[own])


def marks(row: np.ndarray, place: np.ndarray, mask: np.ndarray) -> bytes:
    return np.int64(len(row)).tobytes() + row.astype(np.int64).tobytes() + place.astype(np.int64).tobytes() + mask.tobytes()


class Group:
    """One group's documents in a fixed order: by doc_id, then by text."""

    def __init__(self, table: pa.Table, messages: pa.Table | None = None) -> None:
        ids, texts = table.column("doc_id").combine_chunks(), table.column("text").combine_chunks()
        data, offsets = K.flat(texts)
        number = ids.cast(pa.int64()).fill_null(-(2**63)).to_numpy()
        raw = data.tobytes()
        body = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        order = sorted(range(len(body)), key=lambda i: (number[i], body[i]))
        self.ids, self.number = ids.take(pa.array(order, pa.int64())), number[order]
        self.body = [body[i] for i in order]
        rows = list(zip(messages.column("kind").to_pylist(), messages.column("payload").to_pylist())) if messages is not None else []
        self.messages = [p for k, p in rows if k == 1]
        #: Cores that many groups hold, and the hashes of their strings that other groups hold too.
        self.hot, self.strings = (np.sort(np.frombuffer(b"".join(p for k, p in rows if k == own), np.uint64)) for own in (2, 3))
        self.data = np.frombuffer(b"".join(self.body), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(b) for b in self.body]))).astype(np.int64)


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values the sorted array holds."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _string_hashes(data: np.ndarray, place: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the unit, bit, hash of the whole string) of every string of the units' masks."""
    unit, bit = np.nonzero((mask[:, None] >> np.arange(BLOCK, dtype=np.uint64)) & np.uint64(1))
    start = place[unit] - bit
    return unit, bit, K.span_hashes(K.prefix_hashes(data), start, start + SPAN)


def _dealt(hashes: np.ndarray, buckets: int, g: int) -> pa.Table:
    """One row for each bucket that gets some of the group's hashes."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    hashes, bucket = hashes[order], bucket[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(bucket))
    return pa.table({"bucket": pa.array(bucket[first].astype(np.int32)), "g": pa.array(np.full(len(first), g, np.int32)), "payload": pa.array([hashes[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())})


def _hot_strings(buckets: int):
    """The hashes of all strings around a group's hot cores."""

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = np.zeros(0, np.uint64)
        if left.num_rows and 2 in right.column("kind").to_pylist():
            group = Group(left, right)
            place, least, most, core = units(group.data, group.offsets)
            own = _among(group.hot, core)
            hashes = np.unique(_string_hashes(group.data, place[own], _bits(least[own], most[own]))[2])
        return _dealt(hashes, buckets, key[0].as_py())

    return send


def _core_lists(buckets: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        group = Group(table)
        return _dealt(np.unique(units(group.data, group.offsets)[3]), buckets, key[0].as_py())

    return send


def _common(kind: int, hot_groups: int | None = None):
    """For each group of a bucket the hashes that another group holds too, as messages of a kind; kind 2 names those that many hold."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.groups(batches, "bucket"):
            lists = [(g, np.frombuffer(p, np.uint64)) for g, p in zip(table.column("g").to_pylist(), table.column("payload").to_pylist())]
            every, times = np.unique(np.concatenate([x for _, x in lists]), return_counts=True)
            out = []
            for own, least in ((kind, 2), *([(2, hot_groups)] if hot_groups else [])):
                shared = every[times >= least]
                out += [(g, own, x[_among(shared, x)].tobytes()) for g, x in lists]
            out = [r for r in out if r[2]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["g", "kind", "payload"])

    return find


_RUN_SCHEMA = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def _sorted_runs(buckets: int):
    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, bytes]] = []
        if left.num_rows:
            group, g = Group(left, right), key[0].as_py()
            place, least, most, core = units(group.data, group.offsets)
            known = np.sort(np.frombuffer(b"".join(group.messages), np.uint64))
            elsewhere = _among(known, core)
            _, inverse, times = np.unique(core, return_inverse=True, return_counts=True)
            here = elsewhere | (times[inverse] > 1)
            place, least, most, core, elsewhere = place[here], least[here], most[here], core[here], elsewhere[here]
            right_bytes, size, left_bytes = suffixes(group.data, place, least, most)
            order = sort_rows(right_bytes) if len(place) else np.zeros(0, np.int64)
            place, least, most, core, elsewhere, right_bytes, size, left_bytes = (x[order] for x in (place, least, most, core, elsewhere, right_bytes, size, left_bytes))
            mask = _bits(least, most)
            # Places ascend with the documents, so a place is also the order in the group.
            repeated = resolve(shared_prefix(right_bytes), left_bytes, mask, place) if len(place) else mask
            doc = np.searchsorted(group.offsets, place, "right") - 1
            row, inside = doc, place - group.offsets[doc]
            own = repeated > 0
            if own.any():
                out.append((g % buckets, g, 1, marks(row[own], inside[own], repeated[own])))
            rest = mask & ~repeated
            hot = _among(group.hot, core)
            send_on = np.flatnonzero(elsewhere & ~hot & (rest > 0))
            bucket, part = (core[send_on] % np.uint64(buckets)).astype(np.int64), rest[send_on]
            hot = np.flatnonzero(hot & (rest > 0))
            if len(hot):
                unit, bit, string = _string_hashes(group.data, place[hot], rest[hot])
                shared = _among(group.strings, string)
                # One row for each unit and bucket, with the unit's strings that go there.
                pair, row_of = np.unique(hot[unit[shared]] * buckets + (string[shared] % np.uint64(buckets)).astype(np.int64), return_inverse=True)
                bits = np.zeros(len(pair), np.uint64)
                np.bitwise_or.at(bits, row_of, np.uint64(1) << bit[shared].astype(np.uint64))
                send_on, bucket, part = np.concatenate((send_on, pair // buckets)), np.concatenate((bucket, pair % buckets)), np.concatenate((part, bits))
            by = np.lexsort((send_on, bucket))
            send_on, bucket, part = send_on[by], bucket[by], part[by]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            for a, b in zip(first.tolist(), np.append(first[1:], len(bucket)).tolist()):
                i = send_on[a:b]
                out.append((int(bucket[a]), g, 0, front_coded(right_bytes[i], size[i], left_bytes[i], most[i], group.number[row[i]], inside[i], row[i], part[a:b])))
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_RUN_SCHEMA)], schema=_RUN_SCHEMA)

    return send


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in K.groups(batches, "bucket"):
        kind = table.column("kind").to_pylist()
        rows = list(zip(table.column("g").to_pylist(), table.column("payload").to_pylist()))
        out = [r for r, k in zip(rows, kind) if k == 1]
        runs = [r for r, k in zip(rows, kind) if k == 0]
        if len(runs) > 1:
            out += merged_marks(runs)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int32()), pa.array([1] * len(out), pa.int32()), pa.array([p for _, p in out], pa.binary())], ["g", "kind", "payload"])


_CUT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    group = Group(left, right) if left.num_rows else None
    out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    if group:
        out["doc_id"] = group.ids.to_pylist()
        base = group.offsets
        cover = np.zeros(int(base[-1]) + 1, np.int64)
        for raw in group.messages:
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            row, place, mask = (np.frombuffer(raw, kind, n, 8 + 8 * n * k) for k, kind in enumerate(("i8", "i8", "u8")))
            for b in range(BLOCK):
                own = (mask >> np.uint64(b)) & np.uint64(1) > 0
                start = base[row[own]] + place[own] - b
                np.add.at(cover, start, 1)
                np.add.at(cover, start + SPAN, -1)
        removed = np.cumsum(cover[:-1]) > 0
        for i, body in enumerate(group.body):
            gone = removed[base[i] : base[i + 1]]
            out["n_bytes"].append(len(body))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0)
            out["kept"].append(np.frombuffer(body, np.uint8)[~gone].tobytes() if gone.any() else body)
    return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64())} | {c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")} | {"kept": pa.array(out["kept"], pa.binary())})


def remove_repeats(docs: DataFrame, group_bytes: int = GROUP_BYTES, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document.

    A byte goes if a string of SPAN bytes covers it that also starts earlier: in a document
    of smaller doc_id, or earlier in the same one. Strings are judged on the input, overlaps
    count, and no string crosses documents. Null text is empty; null doc_id comes before all
    others; rows that repeat a doc_id are ordered by their texts. Other columns are ignored.
    Whole copies are no special case: all their strings are merged.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, ceil(total / group_bytes))
    group = F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("g")
    text = docs.select(group, F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def exchange(messages: DataFrame, function, schema: str) -> DataFrame:
        return text.groupBy("g").cogroup(messages.groupBy("g")).applyInArrow(function, schema)

    def by_bucket(rows: DataFrame, function, schema: str) -> DataFrame:
        return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(function, schema)

    messages = "g int, kind int, payload binary"
    cores = text.groupBy("g").applyInArrow(_core_lists(count), "bucket int, g int, payload binary")
    common = written(by_bucket(cores, _common(1, hot_groups), messages), "suffix-cores")
    strings = by_bucket(exchange(common, _hot_strings(count), "bucket int, g int, payload binary"), _common(3), messages)
    runs = exchange(common.union(strings), _sorted_runs(count), "bucket int, g int, kind int, payload binary")
    return exchange(by_bucket(runs, _merged, messages), _cut, _CUT_SCHEMA)


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
