"""Spelling variants: letter-parity bitmask bands propose words one edit apart, which are then verified."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm import kernels as K
from catalume.llm.common import dropped, written

#: Runs of more bytes have their checksum taken one by one.
LONG_RUN = 64
#: Letters dealt over the three bands by their usual frequency, so that no band is nearly constant.
_DEALT = {c: (i % 3, i // 3) for i, c in enumerate("etaoinshrdlcumwfgypbvkjxqz")} | {chr(0xC0 + j): (j % 3, 9 + j // 3) for j in range(64)}
_BIT = np.zeros((3, 256), np.int64)
for _c, (_band, _bit) in _DEALT.items():
    _BIT[_band, ord(_c)] = 1 << _bit
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def _inside(data: np.ndarray) -> np.ndarray:
    """Bytes of the letters A-Z, a-z and U+00C0 to U+00FF; the latter are the two-byte characters that C3 begins."""
    low = data | 0x20
    lead = data == 0xC3
    out = (low >= 97) & (low <= 122) & (data < 128) | lead
    out[1:] |= lead[:-1]
    return out


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, continued from the checksum of what stands before it; byte by byte over all runs at once."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    out = ~before[order]
    n_long = int(np.searchsorted(-length[order], -LONG_RUN, "left"))
    at, own = starts[order], length[order]
    for k in range(LONG_RUN):
        n = int(np.searchsorted(-own, -k, "left"))
        if n <= n_long:
            break
        state = out[n_long:n]
        out[n_long:n] = _CRC[(state ^ data[at[n_long:n] + k]) & 0xFF] ^ (state >> np.uint32(8))
    out = ~out
    for i in range(n_long):
        out[i] = zlib.crc32(data[at[i] : at[i] + own[i]].tobytes(), int(before[order[i]]))
    back = np.empty_like(out)
    back[order] = out
    return back


def word_counts(docs: DataFrame, every: int = 199, least_length: int = 6) -> DataFrame:
    """word, n: occurrences of the words of all whole texts, counted before the shuffle.

    A word is a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased.
    Where `every` divides the CRC-32 of `<doc_id>:<run>`, the run loses its code point
    number checksum % length, so variants of a known rate stand in the counts. Words of
    fewer than `least_length` code points are left out. Null text has no words, a null
    doc_id counts as the empty text before the colon; repeated rows count each; an empty
    table gives no word; other columns are ignored.
    """

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column(0)
        for lo, hi, raw, offsets in K.slices(batch.column(1)):
            inside = _inside(raw)
            starts, ends, first = K.words(inside.view(np.uint8), offsets, np.array([False, True]))
            if not len(starts):
                continue
            data = K.LOWER[raw]
            tail = np.concatenate(([0], np.cumsum((raw & 0xC0) == 0x80)))
            length = ends - starts - (tail[ends] - tail[starts])
            seed = np.fromiter((zlib.crc32(f"{'' if v is None else v}:".encode()) for v in ids.slice(lo, hi - lo).to_pylist()), np.uint32, hi - lo)
            before = np.repeat(seed, np.diff(np.append(first[:-1], len(starts))))
            keep = length >= least_length
            starts, ends, length, before = starts[keep], ends[keep], length[keep], before[keep]
            sums = _checksums(data, starts, ends, before)
            cut = sums % np.uint32(every) == 0
            short = []
            for i in np.flatnonzero(cut & (length > least_length)).tolist():
                run = data[starts[i] : ends[i]].tobytes().decode()
                k = int(sums[i]) % len(run)
                short.append(run[:k] + run[k + 1 :])
            own = ends[~cut] - starts[~cut]
            chars = data[K.ranges(starts[~cut], own)]
            at = np.concatenate(([0], np.cumsum(own))).astype(np.int64)
            found = pa.LargeStringArray.from_buffers(len(own), pa.py_buffer(at), pa.py_buffer(chars)).cast(pa.string())
            counts = pc.value_counts(pa.concat_arrays([found, pa.array(short, pa.string())]))
            yield {"word": counts.field("values"), "n": counts.field("counts")}

    found = K.map_batches(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), ["doc_id", "text"], count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def masks(words: pa.Array) -> list[np.ndarray]:
    """Three bands of the words' letter parities: one replaced letter flips at most two bits, an inserted or deleted one flips one."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    length = pc.utf8_length(words).to_numpy().astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(length)))
    out = []
    for band in range(3):
        total = np.concatenate(([0], np.bitwise_xor.accumulate(_BIT[band][np.minimum(points, 255)] * (points < 256))))
        out.append(total[bounds[1:]] ^ total[bounds[:-1]])
    return out


def _keyed(words: DataFrame) -> DataFrame:
    """The words with their masks and length: a small pass of its own, so the keys below are made in the JVM."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        a, b, c = masks(batch.column(0))
        yield {"word": batch.column(0), "n": batch.column(1), "m0": a, "m1": b, "m2": c}

    return K.map_batches(words, ["word", "n"], run, "word string, n bigint, m0 bigint, m1 bigint, m2 bigint").withColumn("size", F.length("word"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: all pairs of words (word unique, n) that differ by exactly one inserted, deleted or replaced code point.

    One edit flips at most two of the parity bits, so of three bands one is equal; and it
    spares the half of the word before it or the half after it. Words meet on an equal band,
    the length of the shorter one and an equal half, so no group holds all words of a band.
    A pair that meets at several keys is taken at the first alone, and verified there. Words
    of letters outside the bands have no parity bits of these and are still compared.
    """
    keyed = _keyed(words)
    ends = F.array(F.lit(0), F.lit(1))

    def dealt(rows: DataFrame, shorter: F.Column, longer: F.Column) -> DataFrame:
        half = F.floor(shorter / 2).cast("int")
        part = F.when(F.col("end") == 0, F.substring("word", F.lit(1), half)).otherwise(F.substring("word", half + 1 + longer, F.lit(1 << 30)))
        rows = rows.withColumn("end", F.explode(ends)).withColumn("part", part)
        return rows.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("key", F.xxhash64("band", F.when(F.col("band") == 0, F.col("m0")).when(F.col("band") == 1, F.col("m1")).otherwise(F.col("m2")), shorter, "end", "part")).drop("part")

    left = dealt(keyed, F.col("size"), F.lit(0)).alias("a")
    right = dealt(keyed.withColumn("longer", F.explode(ends)), F.col("size") - F.col("longer"), F.col("longer")).alias("b")
    met = left.join(right.hint("merge"), "key").where("a.band = b.band and a.end = b.end and b.size = a.size + b.longer and (b.longer = 1 or a.word < b.word)")
    first_band = "(a.band = 0 or a.m0 <> b.m0) and (a.band < 2 or a.m1 <> b.m1)"
    first_end = "(a.end = 0 or substring(a.word, 1, cast(a.size div 2 as int)) <> substring(b.word, 1, cast(a.size div 2 as int)))"
    near = met.where(f"{first_band} and {first_end} and levenshtein(a.word, b.word, 1) = 1")
    return near.select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: every step doubles how far a pointer reaches.

    A form is at least `ratio` times as frequent as its word, so no chain returns and its
    length follows the logarithm of the counts.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = now.join(onward.hint("merge"), "root", "left")
        after = written(step.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        dropped(now)
        moved = after.where("moved").limit(1).count()
        now = after.drop("moved")
        if not moved:
            return now


def variants(docs: DataFrame, every: int = 199, least_length: int = 6, least_n: int = 5, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of at least `least_n` occurrences, see `word_counts` and `near_pairs`.

    A word's form is its near word of largest n (ties: smallest in code-point order) if
    that is at least `ratio` times its own n, else null; root follows the forms to the last
    (the word itself where it has none). Ratio must be over 1. Without words there are no rows.
    """
    words = written(word_counts(docs, every, least_length).where(F.col("n") >= least_n), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near")).alias("x")).union(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("near")).alias("x"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("x").alias("x"))
    known = words.join(best.hint("merge"), "word", "left")
    is_form = -F.col("x.less") >= F.col("n") * ratio
    rows = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("x.near")).alias("form"), F.when(is_form, -F.col("x.less")).alias("form_n")), "variants")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
