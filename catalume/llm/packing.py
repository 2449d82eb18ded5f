"""Packing: concatenate and cut, with two-pass prefix sums for global token offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm import kernels as K
from catalume.llm.chunk_tokens import TEXT_BYTES, safe_parts, tokenizer
from catalume.llm.common import shared_path


def tokenized(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """The first pass, written to the shared folder: each document's ids, its partition and its offset there.

    A partition's offsets are written together with its rows by the one task attempt that
    commits, so a retry after a lost executor cannot mix two orders.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = tokenizer(tokenizer_file), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, data, offsets in K.slices(batch.column(1), TEXT_BYTES):
                if hi - lo == 1 and len(data) > TEXT_BYTES:
                    parts = [enc.encode(data[a:b], np.array([0, b - a]))[0] for a, b in safe_parts(data, offsets)]
                    ids = np.concatenate(parts)
                    n = np.array([len(ids)])
                else:
                    ids, n = enc.encode(data, offsets)
                ends = np.cumsum(n) * ids.itemsize
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(ids.tobytes())])
                start = at + np.cumsum(n + 1) - (n + 1)
                at += int((n + 1).sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.full(len(n), part, np.int32)), pa.array(start), pa.array(n), raw.cast(pa.binary())], ["doc_id", "part", "start", "n", "ids"])

    path = shared_path(docs.sparkSession, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, part int, start bigint, n bigint, ids binary")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def pack(docs: DataFrame, tokenizer_file: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of documents, placed without gaps into sequences of at most `length` tokens.

    All documents' ids, each followed by `end_id`, form one stream: partition totals give
    every partition its global offset, and fixed windows cut the stream. What is left
    after the last full window is cut at the binary digits of its length, so no sequence
    needs padding. Each row is a piece of one document: doc_id, start (its document's ids
    before it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and
    offset in the sequence. Null or empty text is `end_id` alone; repeated rows are packed
    each; an empty table gives no piece; other columns are ignored.
    """
    stored = tokenized(docs, tokenizer_file)
    wide = np.dtype(tokenizer_kind(tokenizer_file))
    # One row for each input partition: the number of partitions bounds what comes to the driver.
    totals = {r.part: r.total for r in stored.groupBy("part").agg(F.max(F.col("start") + F.col("n") + 1).alias("total")).collect()}
    base, total = {}, 0
    for part in sorted(totals):
        base[part] = total
        total += totals[part]
    full = total // length
    tail, at = [], full * length
    for bit in reversed(range(length.bit_length())):
        if (total - full * length) >> bit & 1:
            tail.append(at)
            at += 1 << bit
    tail_starts = np.array(tail, np.int64)

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, out = batch.column(4), {k: [] for k in ("row", "start", "length", "sequence_id", "offset")}
        raw = []
        part, start, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
        for k in range(batch.num_rows):
            own = np.append(np.frombuffer(ids[k].as_buffer(), wide), end_id).astype("<u4")
            lo = base[int(part[k])] + int(start[k])
            hi = lo + len(own)
            a = lo
            while a < hi:
                if a < full * length:
                    seq = a // length
                    first, b = seq * length, min(hi, (seq + 1) * length)
                else:
                    j = int(np.searchsorted(tail_starts, a, "right")) - 1
                    seq, first = full + j, int(tail_starts[j])
                    b = min(hi, int(tail_starts[j + 1]) if j + 1 < len(tail_starts) else total)
                for name, value in (("row", k), ("start", a - lo), ("length", b - a), ("sequence_id", seq), ("offset", a - first)):
                    out[name].append(value)
                raw.append(own[a - lo : b - lo].tobytes())
                a = b
        rows = pa.array(out.pop("row"), pa.int64())
        yield {"doc_id": batch.column(0).take(rows), "ids": pa.array(raw, pa.binary()), "doc_tokens": pa.array(n + 1).take(rows)} | {k: pa.array(v, pa.int64()) for k, v in out.items()}

    kind = stored.schema["doc_id"].dataType.simpleString()
    return K.map_batches(stored, ["doc_id", "part", "start", "n", "ids"], cut, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def tokenizer_kind(path: str) -> str:
    return np.dtype(tokenizer(path).kind).str


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
