"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catalume.llm import kernels as K
from catalume.llm.chunk_tokens import TEXT_BYTES, safe_parts, tokenizer


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    One pass without a shuffle; Spark bounds an Arrow batch in rows and in bytes, inside it
    texts go to the tokeniser in slices of equal bytes, and a text longer than a slice in
    parts cut where no token can span. Null is the empty text
    (0 bytes, 0 tokens). Repeated rows give repeated results, an empty table none; other
    columns are ignored.
    """

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        enc = tokenizer(tokenizer_file)
        for lo, hi, data, offsets in K.slices(batch.column(1), TEXT_BYTES):
            if hi - lo == 1 and len(data) > TEXT_BYTES:
                n = np.array([sum(int(enc.lengths(data[a:b], np.array([0, b - a]))[0]) for a, b in safe_parts(data, offsets))])
            else:
                n = enc.lengths(data, offsets)
            yield {"doc_id": batch.column(0).slice(lo, hi - lo), "n_bytes": np.diff(offsets), "n_tokens": n, "over_limit": n > limit}

    kind = docs.schema[id_column].dataType.simpleString()
    return K.map_batches(docs, [id_column, text_column], count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
