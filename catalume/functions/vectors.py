"""Vectors as arrays: products, norms, and the little-endian codec."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is the zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalised(a: Column) -> Column:
    """The vector over its norm; the zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


@F.arrow_udf(T.BinaryType())
def encode_vector(v: pa.Array) -> pa.Array:
    """float32 little-endian bytes: the batch's value buffer, cut at the lists' ends. Null components are NaN."""
    at = np.asarray(v.offsets).astype(np.int64)
    flat = pc.fill_null(v.values, float("nan")).to_numpy(zero_copy_only=False).astype("<f4")
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(4 * at), pa.py_buffer(flat.tobytes())])
    return pc.if_else(v.is_valid(), out.cast(pa.binary()), pa.scalar(None, pa.binary()))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_vector(raw: pa.Array) -> pa.Array:
    """The floats of little-endian bytes; bytes after the last whole one are left out."""
    raw = raw.cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    size = np.diff(at) // 4
    if (size * 4 != np.diff(at)).any():
        data = np.concatenate([data[a : a + 4 * n] for a, n in zip(at[:-1].tolist(), size.tolist())])
    else:
        data = data[at[0] : at[-1]]
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(data.tobytes(), "<f4"), pa.float32()))
    return pc.if_else(raw.is_valid(), lists, pa.scalar(None, pa.list_(pa.float32())))


def middle(samples: Column, n: int) -> Column:
    """The middle n samples of a waveform, all of a shorter one."""
    return F.slice(samples, F.greatest(F.floor((F.size(samples) - n) / 2), F.lit(0)).cast("int") + 1, n)


def head(samples: Column, n: int) -> Column:
    return F.slice(samples, 1, n)
