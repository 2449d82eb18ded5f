"""Collocations: a distributed sketch bounds phrase counts from above, automata of what may be frequent count exactly."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalume.llm import kernels as K
from catalume.llm.common import salted_join, written

#: Bytes of one language's text in a block, which is the unit of the sketch's messages and has an automaton of its own.
BLOCK_BYTES = 1 << 19
#: Bytes of blocks of all languages that a task holds before it gives the largest away.
HELD_BYTES = 32 << 20
#: Cells of a bucket of the sketch, and phrase occurrences for each bucket: the sketch grows with the corpus.
CELL_BITS, BUCKET_PHRASES = 22, 1 << 21
#: Phrases of one automaton; a block with more is scanned once for each.
AUTOMATON_PHRASES = 1 << 14
#: Parts of a language that are ranked before the whole language.
RANK_SALTS = 64
#: Counts in a message end here; thresholds may not be larger.
MOST = 255

_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 9)
_BREAKS, _SPACES = re.compile(rb" *\n[ \n]*"), re.compile(rb"  +")
_INSIDE = np.ones(256, bool)
_INSIDE[[10, 32]] = False


def normalised(text: str) -> bytes:
    """Pieces between line feeds, of lower-cased words between single spaces."""
    return _SPACES.sub(b" ", _BREAKS.sub(b"\n", text.encode().translate(_TABLE)).strip(b" \n"))


def _after(text: bytes, at: int, words: int) -> int:
    """Where up to so many words end that follow the space at `at`, within the piece."""
    for _ in range(words):
        ends = [e for e in (text.find(b" ", at + 1), text.find(b"\n", at + 1)) if e >= 0]
        end = min(ends, default=len(text))
        if end == len(text) or text[end : end + 1] == b"\n":
            return end
        at = end
    return at


def parts(text: bytes, limit: int, longest: int) -> Iterator[tuple[bytes, bytes]]:
    """(body, again) of at most about `limit` bytes: the phrases of all bodies less those of all agains are the text's.

    A piece longer than the limit is cut between words; its body then runs on for the words
    that a phrase from before the cut can reach, and these stand in `again` too.
    """
    at = 0
    while len(text) - at > limit:
        line = text.rfind(b"\n", at, at + limit)
        if line > at:
            yield text[at:line], b""
            at = line + 1
            continue
        cut = text.rfind(b" ", at, at + limit)
        if cut <= at:
            ends = [e for e in (text.find(b" ", at + limit), text.find(b"\n", at + limit)) if e >= 0]
            cut = min(ends, default=len(text))
        if cut == len(text) or text[cut : cut + 1] == b"\n":
            yield text[at:cut], b""
        else:
            end = _after(text, cut, longest - 1)
            yield text[at:end], text[cut + 1 : end]
        at = cut + 1
    if at < len(text):
        yield text[at:], b""


def _n_words(text: bytes) -> int:
    return text.count(b" ") + text.count(b"\n") + bool(text)


def blocks(docs: DataFrame, longest: int = 3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, lang, body, again, n_words: the texts of each language in blocks, see `parts`; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, tuple[list[bytes], list[bytes]]] = {}
        sizes: dict[str, int] = {}

        def given(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            body, again = (b"\n".join(filter(None, x)) for x in held.pop(lang))
            sizes.pop(lang)
            row = {"block": number, "lang": lang, "body": body, "again": again, "n_words": _n_words(body) - _n_words(again)}
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row.values()], list(row))

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                own = lang.as_py()
                for body, again in parts(normalised(text.as_py() or ""), block_bytes, longest):
                    if sizes.get(own, 0) + len(body) > block_bytes and own in held:
                        yield given(own)
                    bodies, agains = held.setdefault(own, ([], []))
                    bodies.append(body)
                    agains.append(again)
                    sizes[own] = sizes.get(own, 0) + len(body) + 1
                    if sum(sizes.values()) > HELD_BYTES:
                        yield given(max(sizes, key=sizes.get))
        for lang in list(held):
            yield given(lang)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(run, "block bigint, lang string, body binary, again binary, n_words bigint")


class _Phrases:
    """All phrases of a block: their spans, and the sketch's cell of each."""

    def __init__(self, lang: str, body: bytes, longest: int, buckets: int):
        self.data = np.frombuffer(body, np.uint8)
        starts, ends, _ = K.words(self.data, np.array([0, len(body)]), _INSIDE)
        piece = np.searchsorted(np.flatnonzero(self.data == 10), starts)
        own = K.mix(K.span_hashes(K.prefix_hashes(self.data), starts, ends) ^ np.uint64(zlib.crc32(lang.encode())))
        start, end, keys = [], [], []
        for k in range(1, longest + 1):
            n = max(0, len(starts) - k + 1)
            whole = np.flatnonzero(piece[:n] == piece[k - 1 : k - 1 + n])
            hashes = K.mix(K.windows(own, k)[whole] + np.uint64(k))
            keys.append((((hashes >> np.uint64(CELL_BITS)) % np.uint64(buckets)) << np.uint64(CELL_BITS)) | (hashes & np.uint64((1 << CELL_BITS) - 1)))
            start.append(starts[whole])
            end.append(ends[whole + k - 1])
        self.start, self.end, self.keys = map(np.concatenate, (start, end, keys))

        self.n_words = len(starts)

    def texts(self, rows: np.ndarray) -> pa.Array:
        """The phrases that stand at these rows."""
        own = self.end[rows] - self.start[rows]
        at = np.concatenate(([0], np.cumsum(own))).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(at), pa.py_buffer(self.data[K.ranges(self.start[rows], own)])).cast(pa.string())


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row after the other, so that no more than one block is held beside the batch."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _messages(stored: DataFrame, longest: int, buckets: int) -> DataFrame:
    """bucket, block, cells, counts: what each block adds to each bucket of the sketch, cells ascending."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in _rows(batch):
            cells, counts = np.unique(_Phrases(row["lang"], row["body"], longest, buckets).keys, return_counts=True)
            bucket = (cells >> np.uint64(CELL_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            low = (cells & np.uint64((1 << CELL_BITS) - 1)).astype("<u4")
            few = np.minimum(counts, MOST).astype(np.uint8)
            spans = list(zip(cuts[:-1], cuts[1:]))
            # The low halves, then the slowly growing high bytes, which compress to nearly nothing.
            raw = [(low[a:b] & 0xFFFF).astype("<u2").tobytes() + (low[a:b] >> 16).astype(np.uint8).tobytes() for a, b in spans]
            yield {"bucket": bucket[cuts[:-1]], "block": np.full(len(spans), row["block"]), "cells": pa.array(raw, pa.binary()), "counts": pa.array([few[a:b].tobytes() for a, b in spans], pa.binary())}

    return K.map_batches(stored, ["block", "lang", "body"], run, "bucket bigint, block bigint, cells binary, counts binary")


def _replies(messages: DataFrame, least: int) -> DataFrame:
    """bucket, block, flags: for each cell that a block has sent, whether all blocks' counts there reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in K.groups(batches, "bucket"):
            total, sent = np.zeros(1 << CELL_BITS, np.uint32), []
            for cells, counts in zip(group.column("cells"), group.column("counts")):
                n, raw = len(counts.as_py()), cells.as_py()
                at = np.frombuffer(raw, "<u2", n).astype(np.uint32) | (np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.uint32) << np.uint32(16))
                total[at] += np.frombuffer(counts.as_py(), np.uint8)
                sent.append(at)
            hot = total >= least
            flags = [np.packbits(hot[at]).tobytes() for at in sent]
            yield pa.RecordBatch.from_arrays([group.column("bucket").combine_chunks(), group.column("block").combine_chunks(), pa.array(flags, pa.binary())], ["bucket", "block", "flags"])

    return messages.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket bigint, block bigint, flags binary")


def _guarded(text: bytes) -> str:
    return f" {text.decode()} ".replace("\n", " \n ")


def _candidates(row: dict, longest: int, buckets: int) -> tuple[pa.Array, pa.Array]:
    """A block's words in hot cells, one for each occurrence, and its longer phrases there, each once."""
    found = _Phrases(row["lang"], row["body"], longest, buckets)
    cells, inverse = np.unique(found.keys, return_inverse=True)
    bucket, hot = cells >> np.uint64(CELL_BITS), np.zeros(len(cells), bool)
    for reply in row["replies"]:
        a, b = np.searchsorted(bucket, [reply["bucket"], reply["bucket"] + 1])
        hot[a:b] = np.unpackbits(np.frombuffer(reply["flags"], np.uint8), count=b - a)
    rows = np.flatnonzero(hot[inverse])
    n = np.searchsorted(rows, found.n_words)
    return found.texts(rows[:n]), pc.unique(found.texts(rows[n:]))


def _matches(phrases: pa.Array, texts: list[bytes]) -> list[np.ndarray]:
    """How often each phrase stands in each text, overlaps included: automata of the phrases, guarded by spaces."""
    guarded, counts = [_guarded(t) for t in texts], [[np.zeros(0, np.int64)] for _ in texts]
    for lo in range(0, len(phrases), AUTOMATON_PHRASES):
        own = phrases.slice(lo, AUTOMATON_PHRASES).to_pylist()
        automaton = ahocorasick.Automaton()
        for i, phrase in enumerate(own):
            automaton.add_word(f" {phrase} ", i)
        automaton.make_automaton()
        for text, found in zip(guarded, counts):
            found.append(np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(own)))
    return [np.concatenate(found) for found in counts]


def _counted(joined: DataFrame, longest: int, buckets: int) -> DataFrame:
    """lang, phrase, f: exact counts of each block's words and phrases in hot cells."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in _rows(batch):
            words, phrases = _candidates(row, longest, buckets)
            counts = pc.value_counts(words)
            again = Counter(w for w in row["again"].replace(b"\n", b" ").decode().split(" ") if w)
            n = counts.field("counts").to_numpy() - (np.array([again[w] for w in counts.field("values").to_pylist()], np.int64) if again else 0)
            body, less = _matches(phrases, [row["body"], row["again"]])
            f = np.concatenate((n, body - less))
            some = np.flatnonzero(f)
            yield {"lang": pa.array([row["lang"]] * len(some), pa.string()), "phrase": pa.concat_arrays([counts.field("values"), phrases]).take(pa.array(some)), "f": f[some]}

    return K.map_batches(joined, ["lang", "body", "again", "replies"], run, "lang string, phrase string, f bigint")


def frequent_phrases(stored: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """lang, phrase, f, k: all phrases of 1 to `longest` words (k) that occur at least `least` times in a language.

    `stored` is a written table of `blocks`. Each block adds its phrases' counts to a sketch
    dealt over buckets, as many as the corpus needs; a cell's sum bounds the counts of all
    phrases in it from above. Blocks learn which of their cells may be frequent, compile
    their longer phrases there into an automaton and count overlapping matches, and words
    there one by one; the sums are exact.
    """
    if not 1 <= least <= MOST:
        raise ValueError(f"least must be from 1 to {MOST}")
    total = stored.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-total * longest // BUCKET_PHRASES))
    replies = _replies(_messages(stored, longest, buckets), least).groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias("replies"))
    joined = stored.join(replies.hint("merge"), "block")
    counted = _counted(joined, longest, buckets).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return counted.withColumn("k", F.size(F.split("phrase", " ")))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `most` best phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z), split at `[.,;:!?]` and line ends into pieces and at spaces
    and tabs into words. a counts a phrase's contiguous occurrences within pieces, overlaps
    included; phrases of a >= `least` are candidates. A cut into a first and a last part with
    counts l and r scores floor(10^6 a a / (l r)), in exact decimals (for a up to 10^15); the
    lowest-scoring cut counts, ties to the shorter first part. A candidate goes if a longer
    candidate that contains it has at least `share` per cent of its occurrences. Ranks are by
    score, a, then the phrase's UTF-8 bytes; `most` is the report's length and no cap on what
    is counted. n counts all words of the language. Null text is empty, null lang is `und`
    (and joins texts so labelled); repeated rows count each; languages without a candidate
    and empty tables give no rows; other columns are ignored.
    """
    stored = written(blocks(docs, longest), "blocks")
    found = written(frequent_phrases(stored, longest, least), "phrases")
    words = F.split("phrase", " ")
    candidates = found.where("k > 1").withColumnRenamed("f", "a")
    inner = candidates.where("k > 2").withColumn("words", words).withColumn("size", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, k - size + 1)")))
    longer = inner.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), F.col("a").alias("over")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    kept = candidates.join(longer.hint("merge"), ["lang", "phrase"], "left").where(f"over is null or 100 * over < {int(share)} * a").drop("over")
    cuts = kept.withColumn("words", words).withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = written(cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k")), " ").alias("last")), "cuts")
    scored = cuts
    for side, count in (("first", "l"), ("last", "r")):
        uses = cuts.groupBy("lang", side).agg(F.count("*").alias("uses"))
        known = found.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        scored = salted_join(scored, written(known.join(uses.hint("merge"), ["lang", side]), "counts"), ["lang", side], "uses", ["phrase"]).drop("uses")
    wide = reduce(lambda df, c: df.withColumn(f"_{c}", F.col(c).cast("decimal(19,0)")), "alr", scored)
    scored = wide.withColumn("score", F.expr("(_a * _a * 1000000) div (_l * _r)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # Spark cuts each task's rows to `most` before a window's shuffle; the first window, dealt over RANK_SALTS, keeps what then meets in one task the same at every number of tasks.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most).drop("rank", "salt")
    totals = stored.groupBy("lang").agg(F.sum("n_words").alias("n"))
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
