"""Encoders: text or audio bytes to unit vectors, with an error for each row that fails."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Encoder = Callable[[list], np.ndarray]


def hashing_encoder(dim: int = 512) -> Encoder:
    """A deterministic stand-in for a model: hashed word counts of texts, hashed byte counts of bytes, normalised."""

    def encode(items: list) -> np.ndarray:
        out = np.zeros((len(items), dim), np.float32)
        for i, item in enumerate(items):
            parts = item.lower().split() if isinstance(item, str) else [bytes(item)[k : k + 4] for k in range(0, len(item), 4)]
            for p in parts:
                h = int.from_bytes(hashlib.blake2b(p.encode() if isinstance(p, str) else p, digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    return encode


def embed(df: DataFrame, id_column: str, input_column: str, encoder: Encoder, batch: int = 32) -> DataFrame:
    """(id, embedding, error): batches go to the encoder; if a batch fails, each of its rows has the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                ok = part[input_column].notna()
                vectors, errors = pd.Series([None] * len(part), part.index, object), pd.Series(np.where(ok, None, "nothing to encode"), part.index, object)
                if ok.any():
                    try:
                        for k, v in zip(part.index[ok], encoder(part[input_column][ok].tolist())):
                            vectors[k] = np.asarray(v, np.float32).tolist()
                    except Exception as e:  # any failure of an encoder belongs to the rows of its batch
                        errors[ok] = str(e)
                yield pd.DataFrame({"id": part[id_column], "embedding": vectors, "error": errors})

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, input_column).mapInPandas(run, f"id {kind}, embedding array<float>, error string")
