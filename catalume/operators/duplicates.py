"""Duplicates by perceptual hashes, by fingerprints and by vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.functions.scalars import hamming_similarity
from catalume.operators.vector import block_cosines, packed, unpacked


def hamming_pairs(hashes: DataFrame, below: int = 10, bits: int = 64) -> DataFrame:
    """(a, b, similarity) of ids a < b whose 64-bit hashes differ in fewer than `below` bits.

    Pigeonhole: fewer than 2 * bands differing bits leave a band with at most one of them,
    so one side shows each band's value and the other side that value and those one bit
    away: an equi-join finds every pair, and a pair is kept in its first such band. Ten
    bits take five bands of 12 or 13 bits.
    """
    count = -(-below // 2)
    cuts = [round(k * bits / count) for k in range(count + 1)]
    value = lambda c, lo, hi: F.shiftrightunsigned(c, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    bands = F.array(*[value(F.col("hash"), lo, hi) for lo, hi in zip(cuts, cuts[1:])])
    masks = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(1 << k).cast("bigint") for k in range(hi - lo)]) for lo, hi in zip(cuts, cuts[1:])])
    a = hashes.select(F.col("id").alias("a"), F.col("hash").alias("__x"), F.posexplode(bands).alias("__band", "__value"))
    probes = F.transform(F.get(masks, F.col("__band")), lambda m: m.bitwiseXOR(F.col("__value")))
    b = a.select(F.col("a").alias("b"), F.col("__x").alias("__y"), "__band", F.explode(probes).alias("__value"))
    differ = F.col("__x").bitwiseXOR(F.col("__y"))
    first = F.lit(None).cast("int")
    for k in reversed(range(count)):
        first = F.when(F.bit_count(value(differ, cuts[k], cuts[k + 1])) <= 1, k).otherwise(first)
    pairs = a.join(b, ["__band", "__value"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) < below) & (first == F.col("__band")))
    return pairs.select("a", "b", hamming_similarity(F.col("__x"), F.col("__y")).alias("similarity"))


def average_hash(values: F.Column) -> F.Column:
    """A 64-bit hash of 64 numbers: which are over their mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)
    bits = F.transform(values, lambda x, i: F.when(x > mean, F.shiftleft(F.lit(1).cast("bigint"), F.pmod(i, F.lit(64)))).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def same_type_pairs(items: DataFrame, probes: DataFrame, threshold: float) -> DataFrame:
    """(probe_id, asset_id, similarity) of items of the probe's type, itself left out, over a cosine threshold; probes are a stated set.

    Blocks of items meet blocks of probes, which are broadcast, and a type's vectors are multiplied as matrices.
    """
    columns = ["asset_id", "label", "embedding"]
    own, asked = items.where("label is not null").select(columns), probes.where("label is not null").select(columns)
    each = packed(own, "items").crossJoin(F.broadcast(packed(asked, "probes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                x, y = map(unpacked, row)
                for label in set(pc.unique(x.column(1)).to_pylist()) & set(pc.unique(y.column(1)).to_pylist()):
                    a, b = (t.filter(pc.equal(t.column(1), pa.scalar(label, t.schema.field(1).type))).combine_chunks() for t in (x, y))
                    for lo, near, known in block_cosines(a.column(2), b.column(2)):
                        i, j = np.nonzero(known & ((near >= threshold) | np.isnan(near)))  # NaN is over all numbers, as in SQL
                        out = pa.table([b.column(0).take(pa.array(j)), a.column(0).take(pa.array(i + lo)), pa.array(near[i, j])], ["probe_id", "asset_id", "similarity"])
                        yield from out.filter(pc.not_equal(out.column(0), out.column(1))).combine_chunks().to_batches()

    kinds = [df.schema["asset_id"].dataType.simpleString() for df in (probes, items)]
    return each.mapInArrow(run, f"probe_id {kinds[0]}, asset_id {kinds[1]}, similarity double")


def exact_groups(items: DataFrame, fingerprint: str, id_column: str = "id") -> DataFrame:
    """(fingerprint, first_id, n) of fingerprints that more than one item has."""
    return items.groupBy(fingerprint).agg(F.min(id_column).alias("first_id"), F.count("*").alias("n")).where("n > 1")
