"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) P(slot | class, history) P(token | slot). A token's
class comes from its last two bytes, its slot in the class from a hash of the whole token;
a common word has its slot almost to itself. Both factors are softmaxes over hashed
features of the history: the word before, the second before alone (a skip) and the last two
classes. They start from the corpus's shares and are trained by rounds of distributed
gradient updates that together visit every training text once; these dense weights have a
fixed size and are broadcast.

The pairs of words before a token are features of their own, as many as the corpus has:
their counts with each class and slot are kept in shards and exchanged with the groups of
texts that hold them. A pair seen at least CUTOFF times scales both softmaxes towards what
followed it, (n(pair, outcome) + ALPHA P(outcome)) / (n(pair) + ALPHA), which still sums to
one. P(token | slot) is the token's smoothed share of the slot's training tokens, counted
over the whole corpus in the same exchange.
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

CLASSES = 32
SLOTS = 32
#: Rows of weights of the class softmax, and as many of the slot softmax.
FEATURES = 1 << 13
#: Rounds of updates; each sees its share of the training texts.
ROUNDS = 3
#: Adaptive step size in the first round; round r takes the (r + 1)-th part. Squared gradients start at DAMPING, so that rare features move little.
RATE = 0.15
DAMPING = 1.0
BATCH_TOKENS = 16_384
#: Tokens whose softmax is worked out at once, so that it stays in the processor's cache.
STEP_TOKENS = 2048
#: Times a pair of words has to occur before a token in the training texts to count as a feature, and the weight of the softmax beside its counts.
CUTOFF = 2
ALPHA = 16.0
#: Bytes of text in a group, which one task scores at a time.
GROUP_BYTES = 4 << 20
#: Rows of weights that are averaged together.
ROWS = 256

_END = np.uint64(0x0123456789ABCDEF)
_BEGIN = np.uint64(0x7FEDCBA987654321)
_SHIFT = np.uint64(64 - 13)
#: Bits of an outcome (class and slot) under a pair's hash.
_OUTCOME = np.uint64(10)
_SOLID = ~K.SPACE


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of the texts' tokens (words between ASCII white space, lower-cased, then one end), and bounds."""
    low = K.LOWER[data]
    starts, ends, first = K.words(low, offsets, _SOLID)
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    at = np.arange(len(starts)) + text
    hashes = np.full(len(starts) + n, _END, np.uint64)
    kind = np.full(len(starts) + n, CLASSES - 1, np.int64)
    if len(starts):
        hashes[at] = K.span_hashes(K.prefix_hashes(low), starts, ends)
        last = low[ends - 1].astype(np.uint64) * np.uint64(257) + np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        kind[at] = (K.mix(last) % np.uint64(CLASSES - 1)).astype(np.int64)
    return hashes, kind, first + np.arange(n + 1)


def slots(hashes: np.ndarray) -> np.ndarray:
    """Each token's slot in its class."""
    return (K.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(SLOTS)).astype(np.int64)


def _back(values: np.ndarray, bounds: np.ndarray, k: int, none) -> np.ndarray:
    """What stands k tokens before each token of the same text."""
    out = np.full(len(values), none, values.dtype)
    out[k:] = values[:-k]
    out[np.arange(len(values)) - np.repeat(bounds[:-1], np.diff(bounds)) < k] = none
    return out


def pairs(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of the two words before each token."""
    return K.mix(_back(hashes, bounds, 1, _BEGIN) * np.uint64(3) + _back(hashes, bounds, 2, _BEGIN))


def features(hashes: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token, from the tokens before it in its text: the rows of class weights, and those of slot weights given its class."""
    one, two = _back(hashes, bounds, 1, _BEGIN), _back(hashes, bounds, 2, _BEGIN)
    before = (_back(kind, bounds, 1, CLASSES) * (CLASSES + 1) + _back(kind, bounds, 2, CLASSES)).astype(np.uint64)
    rows = [K.mix(one), K.mix(two + np.uint64(0x51ED270B)), K.mix(before + np.uint64(0xABCD0000))]
    own = (kind.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([r >> _SHIFT for r in rows]).astype(np.int64), np.stack([K.mix(r ^ own) >> _SHIFT for r in rows[:2]]).astype(np.int64)


def softmax(weights: np.ndarray, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probabilities from the sum of the weights' rows, one line a token, and a start (one line, or one a token)."""
    out = np.empty((rows.shape[1], weights.shape[1]), weights.dtype)
    for lo in range(0, len(out), STEP_TOKENS):
        at = slice(lo, lo + STEP_TOKENS)
        z = np.take(weights, rows[0, at], 0)
        for r in rows[1:]:
            z += np.take(weights, r[at], 0)
        z += start if start.ndim == 1 else start[at]
        if z.max() > 60:  # exp would leave single precision
            z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        np.divide(z, z.sum(1)[:, None], out=out[at])
    return out


def train_step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, start: np.ndarray, outcome: np.ndarray, rate: float = RATE) -> None:
    """One adaptive gradient update of one softmax from a batch of tokens."""
    p = softmax(weights, rows, start)
    p[np.arange(len(outcome)), outcome] -= 1
    flat, columns = rows.ravel(), p.T.astype(np.float64)
    gradient = np.empty((weights.shape[1], len(weights)), np.float32)
    for c, own in enumerate(columns):
        gradient[c] = np.bincount(flat, np.tile(own, len(rows)), len(weights))
    gradient = np.ascontiguousarray(gradient.T)
    squares += gradient * gradient
    gradient /= np.sqrt(squares)
    gradient *= rate
    weights -= gradient


def starts(masses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs of the classes' shares, and of the slots' shares in each class, from the training tokens of each class and slot."""
    counts = masses.reshape(CLASSES, SLOTS) + 1.0 / SLOTS
    return np.log(counts.sum(1) / counts.sum()).astype(np.float32), np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _trainer(weights, start, rate: float):
    """Changes of both weight tables (slot rows after class rows) by one task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, (classes, inside) = weights.value, start.value
        own, squares, seen = begin.copy(), np.full_like(begin, DAMPING), np.zeros(2 * FEATURES, np.int64)
        halves = slice(0, FEATURES), slice(FEATURES, 2 * FEATURES)
        for batch in batches:
            for _, _, data, offsets in K.slices(batch.column(0)):
                hashes, kind, bounds = tokens(data, offsets)
                slot = slots(hashes)
                rows, more = features(hashes, kind, bounds)
                for lo in range(0, len(kind), BATCH_TOKENS):
                    at = slice(lo, lo + BATCH_TOKENS)
                    train_step(own[halves[0]], squares[halves[0]], rows[:, at], classes, kind[at], rate)
                    train_step(own[halves[1]], squares[halves[1]], more[:, at], inside[kind[at]], slot[at], rate)
                seen[halves[0]] += np.bincount(rows.ravel(), minlength=FEATURES)
                seen[halves[1]] += np.bincount(more.ravel(), minlength=FEATURES)
        if seen.any():
            change = (own - begin).astype(np.float16)
            blocks = range(0, 2 * FEATURES, ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([b // ROWS for b in blocks], pa.int32()), pa.array([seen[b : b + ROWS].astype("<f4").tobytes() + change[b : b + ROWS].tobytes() for b in blocks], pa.binary())], ["block", "payload"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' changes of each block of weights, each row weighted by how often a task saw it; batches stream through."""
    totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = np.frombuffer(raw, "<f4", ROWS).astype(np.float64)
            change = np.frombuffer(raw, np.float16, -1, 4 * ROWS).reshape(ROWS, -1).astype(np.float64)
            n, total = totals.get(block, (0, 0))
            totals[block] = (n + seen, total + change * seen[:, None])
    for block, (n, total) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(total / np.maximum(n, 1)[:, None]).astype("<f4").tobytes()], pa.binary())], ["block", "payload"])


def train(texts: DataFrame, masses: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (class rows, then slot rows) from a DataFrame with text and round; their size is fixed, whatever the corpus."""
    spark = texts.sparkSession
    start = spark.sparkContext.broadcast(starts(masses))
    weights = np.zeros((2 * FEATURES, CLASSES), np.float32)
    for r in range(rounds):
        kept = spark.sparkContext.broadcast(weights)
        changes = texts.where(F.col("round") == r).select("text").mapInArrow(_trainer(kept, start, RATE / (r + 1)), "block int, payload binary")
        parts = min(2 * FEATURES // ROWS, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        merged = changes.repartition(parts, "block").mapInArrow(_average, "block int, payload binary")
        weights = weights.copy()
        for row in merged.collect():
            weights[row.block * ROWS : row.block * ROWS + ROWS] += np.frombuffer(row.payload, "<f4").reshape(ROWS, CLASSES)
        kept.unpersist()
    return weights


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, byte by byte of their places, so that leading zeros and small numbers compress away."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw: bytes, count: int) -> list[np.ndarray]:
    """The `count` arrays of a message; none are empty ones."""
    if not raw:
        return [np.zeros(0, np.int64)] * count
    size = int(np.frombuffer(raw, np.int64, 1)[0])
    flat = np.frombuffer(pa.decompress(raw[8:], size, "zstd", asbytes=True), np.uint8)
    n = size // 8 // count
    return [np.ascontiguousarray(part.reshape(8, n).T).reshape(-1).view(np.int64) for part in np.split(flat, count)]


def _group_tokens(table: pa.Table) -> tuple[np.ndarray, ...]:
    """A group's token hashes, classes, slots, bounds, and which tokens are training tokens."""
    hashes, kind, bounds = tokens(*K.flat(table.column("text")))
    return hashes, kind, slots(hashes), bounds, np.repeat(table.column("training").to_numpy(), np.diff(bounds)).astype(bool)


def _pair_keys(hashes: np.ndarray, outcome: np.ndarray, bounds: np.ndarray, buckets: int) -> np.ndarray:
    """The leading bits of the hash of the pair before each token, 24 beyond those that tell buckets apart, and the token's outcome."""
    bits = max(32, 24 + (buckets - 1).bit_length())
    return pairs(hashes, bounds) >> np.uint64(64 - bits) << _OUTCOME | outcome.astype(np.uint64)


def _edges(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted keys of so many bits: buckets are ranges of the 32 leading ones."""
    limits = [(b << 32) // buckets + ((b << 32) % buckets > 0) << (bits - 32) for b in range(buckets)]
    return np.append(np.searchsorted(keys, np.array(limits, np.uint64)), len(keys))


def _key_bits(buckets: int) -> int:
    return max(32, 24 + (buckets - 1).bit_length()) + int(_OUTCOME)


def _own_counts(buckets: int):
    """Each group's distinct tokens (with outcome and training count) and distinct pairs with outcomes, dealt by ranges of their hashes."""

    def send(key: tuple, table: pa.Table) -> pa.Table:
        hashes, kind, slot, bounds, training = _group_tokens(table)
        outcome = kind * SLOTS + slot
        t, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.bincount(where, training, len(t)).astype(np.int64)
        p, where = np.unique(_pair_keys(hashes, outcome, bounds, buckets), return_inverse=True)
        m = np.bincount(where, training, len(p)).astype(np.int64)
        a, b = _edges(t, buckets, 64), _edges(p, buckets, _key_bits(buckets))
        rows = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist()
        steps = lambda x: np.diff(x, prepend=np.uint64(0))
        words = [_packed(steps(t[a[k] : a[k + 1]]), n[a[k] : a[k + 1]], outcome[first[a[k] : a[k + 1]]]) for k in rows]
        found = [_packed(steps(p[b[k] : b[k + 1]]), m[b[k] : b[k + 1]]) for k in rows]
        return pa.table({"bucket": pa.array(rows, pa.int32()), "g": pa.array([key[0].as_py()] * len(rows), pa.int32()), "tokens": pa.array(words, pa.binary()), "pairs": pa.array(found, pa.binary())})

    return send


def _shared_pairs(lists: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[bytes]:
    """For each group of a bucket, in the order it sent: which of its pairs are features, and n(pair), n(pair, class), n(pair, class, slot) of these."""
    keys = [np.cumsum(k.view(np.uint64), dtype=np.uint64) for k, _ in lists]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    exact = np.zeros(len(every), np.int64)
    np.add.at(exact, where, np.concatenate([n for _, n in lists]))

    def over(shift: int) -> np.ndarray:
        part = every >> np.uint64(shift)
        fresh = np.concatenate(([True], part[1:] != part[:-1]))
        return np.add.reduceat(exact, np.flatnonzero(fresh))[np.cumsum(fresh) - 1] if len(every) else exact

    pair, own_class, at = over(int(_OUTCOME)), over(SLOTS.bit_length() - 1), 0
    for k in keys:
        own = where[at : at + len(k)]
        at += len(k)
        used = own[pair[own] >= CUTOFF]
        # Pairs that are no features have count 0, which compresses to nothing.
        out = np.zeros((3, len(own)), np.int64)
        out[:, pair[own] >= CUTOFF] = pair[used], own_class[used], exact[used]
        yield _packed(*out)


def _global_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group of a bucket the corpus-wide counts of its tokens and pairs, in the order it sent; for the bucket (g null) each slot's tokens and distinct tokens."""
    lists_type = pa.list_(pa.int64())
    for table in K.groups(batches, "bucket"):
        lists = [_unpacked(raw, 3) for raw in table.column("tokens").to_pylist()]
        unique, first, inverse = np.unique(np.concatenate([np.cumsum(x[0].view(np.uint64), dtype=np.uint64) for x in lists]), return_index=True, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, inverse, np.concatenate([x[1] for x in lists]))
        outcome = np.concatenate([x[2] for x in lists])[first]
        counts = [_packed(total[own]) for own in np.split(inverse, np.cumsum([len(x[0]) for x in lists])[:-1])]
        found = list(_shared_pairs([tuple(_unpacked(raw, 2)) for raw in table.column("pairs").to_pylist()]))
        n, v = np.zeros(CLASSES * SLOTS, np.int64), np.bincount(outcome, total > 0, CLASSES * SLOTS).astype(np.int64)
        np.add.at(n, outcome, total)
        bucket, rows = table.column("bucket")[0].as_py(), table.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*table.column("g").to_pylist(), None], pa.int32()), pa.array([bucket] * (rows + 1), pa.int32()), pa.array([*counts, None], pa.binary()), pa.array([*found, None], pa.binary()), pa.array([None] * rows + [n.tolist()], lists_type), pa.array([None] * rows + [v.tolist()], lists_type)], ["g", "bucket", "tokens", "pairs", "n", "v"])


_SCORED = pa.schema([("doc_id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("score", pa.float64())])


def _scorer(weights, start, mass, buckets: int):
    """Scores of a group's texts, from the corpus-wide counts of its tokens and pairs, which come in the order of the buckets."""

    def score(key: tuple, table: pa.Table, messages: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SCORED.empty_table()
        rows = sorted(zip(messages.column("bucket").to_pylist(), messages.column("tokens").to_pylist(), messages.column("pairs").to_pylist()))
        hashes, kind, slot, bounds, _ = _group_tokens(table)
        outcome = kind * SLOTS + slot
        c = np.concatenate([_unpacked(raw, 1)[0] for _, raw, _ in rows])[np.unique(hashes, return_inverse=True)[1]].astype(np.float64)
        counts = [np.concatenate(x) for x in zip(*[_unpacked(raw, 3) for _, _, raw in rows])]
        where = np.unique(_pair_keys(hashes, outcome, bounds, buckets), return_inverse=True)[1]
        (first, inside), line = start.value, np.arange(BATCH_TOKENS)
        class_rows, slot_rows = features(hashes, kind, bounds)
        p, q = np.empty(len(kind)), np.empty(len(kind))
        for lo in range(0, len(kind), BATCH_TOKENS):
            at = slice(lo, lo + BATCH_TOKENS)
            p[at] = softmax(weights.value[:FEATURES], class_rows[:, at], first)[line[: len(kind[at])], kind[at]]
            q[at] = softmax(weights.value[FEATURES:], slot_rows[:, at], inside[kind[at]])[line[: len(kind[at])], slot[at]]
        pair, own_class, exact = (x[where] for x in counts)
        use = pair > 0
        p[use] = (own_class[use] + ALPHA * p[use]) / (pair[use] + ALPHA)
        q[use] = (exact[use] + ALPHA * q[use]) / (own_class[use] + ALPHA)
        logs = np.log10(np.maximum(p, 1e-30)) + np.log10(np.maximum(q, 1e-30)) + np.log10(c + 1) - mass.value[outcome]
        return pa.table([table.column("doc_id").combine_chunks(), table.column("training").combine_chunks(), pa.array(np.diff(bounds).astype(np.int64)), pa.array(K.sums(c > 0, bounds).astype(np.int64)), pa.array(K.sums(np.log10(c + 1), bounds)), pa.array(K.sums(logs, bounds))], schema=_SCORED)

    return score


def score(docs: DataFrame, training: F.Column, rounds: int = ROUNDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every whole text.

    The model learns from the rows for which `training` holds; null counts as false. Null
    or empty text has one token, its end. Tokens are told apart by the kernels' 61-bit
    hashes, pairs of words by 24 bits more than tell the groups apart; counts have 64 bits.
    Texts are dealt into groups by doc_id; a group sends its distinct tokens and pairs and
    gets the corpus-wide counts back, so no table of counts is broadcast. Without training
    rows every count is 0. Repeated rows are scored each; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, ceil(total / group_bytes))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("g"), "doc_id", "text", "training")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = dealt.groupBy("g").applyInArrow(_own_counts(count), "bucket int, g int, tokens binary, pairs binary")
    shared = written(own.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_global_counts, "g int, bucket int, tokens binary, pairs binary, n array<bigint>, v array<bigint>"), "lm-counts")
    # Summed over the buckets, one number for each class and slot comes to the driver: training tokens and distinct training tokens.
    sums = shared.where("g is null").select(F.posexplode(F.arrays_zip("n", "v")).alias("k", "x")).groupBy("k").agg(F.sum("x.n").alias("n"), F.sum("x.v").alias("v")).collect()
    n, v = np.zeros((2, CLASSES * SLOTS))
    for r in sums:
        n[r.k], v[r.k] = r.n, r.v
    train_n, train_v = sum(r.n for r in sums), sum(r.v for r in sums)
    weights = train(rows.where("training").select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).alias("round")), n, rounds)
    weights, start, mass = (spark.sparkContext.broadcast(x) for x in (weights, starts(n), np.log10(n + v + 1)))
    counts = shared.where("g is not null").select("g", "bucket", "tokens", "pairs")
    scored = dealt.groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(_scorer(weights, start, mass, count), "doc_id bigint, training boolean, n_tokens bigint, n_known bigint, log_counts double, score double")
    return scored.select(
        "doc_id", "training", "n_tokens", "n_known", F.lit(train_n).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * float(np.log10(train_n + train_v + 1))).alias("base_score"), "score")
