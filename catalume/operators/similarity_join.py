"""All pairs of vectors over a cosine threshold: an exact join in metric space, with angles to pivots as bounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.adapters import stored

#: Vectors for each pivot, and the most pivots: they are the only vectors that reach the driver.
PIVOT_ROWS, MOST_PIVOTS = 512, 1024
#: Rows of a block; a task holds the vectors of two, and compares them some at a time.
BLOCK_ROWS, STRIP_ROWS = 8192, 512
#: Vectors from which the work with fewer pivots is estimated.
TRIAL_ROWS = 2048
#: Slack on bounds against rounding, in radians.
SLACK = 1e-6


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(column), -1)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def distinct_vectors(items: DataFrame, by: str, id_column: str = "asset_id") -> DataFrame:
    """kind, size, embedding, id (the least) and n of the different vectors of each kind: copies meet no further comparison.

    Vectors that are null, empty or zero, or hold null or non-finite components, have no
    cosine and take no part; null is a kind of its own.
    """
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    own = items.where(good).select(F.col(by).alias("kind"), F.col(id_column).cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return own.groupBy("kind", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("size", F.size("embedding"))


def representatives(items: DataFrame, by: str, id_column: str = "asset_id") -> DataFrame:
    """(asset_id, representative): every vector that takes part, with the least id of its copies."""
    reps = distinct_vectors(items, by, id_column)
    own = items.select(F.col(id_column).cast("bigint").alias("asset_id"), F.col(by).alias("kind"), F.col("embedding").cast("array<float>").alias("embedding"))
    met = own.join(reps.select(F.col("kind").alias("__kind"), F.col("embedding").alias("__v"), F.col("id").alias("representative")), F.col("kind").eqNullSafe(F.col("__kind")) & (F.col("embedding") == F.col("__v")))
    return met.select("asset_id", "representative")


def _pivots(base: DataFrame, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: the numbers and unit vectors of the pivots, the rows of least hash."""
    n = base.count()
    rows = base.orderBy(F.xxhash64("id", "kind"), "id").limit(min(most, MOST_PIVOTS, max(1, n // PIVOT_ROWS + 1))).select("embedding").collect()
    out: dict[int, tuple[list, list]] = {}
    for k, row in enumerate(rows):
        v = np.array(row.embedding, np.float64)
        numbers, vectors = out.setdefault(len(v), ([], []))
        numbers.append(k)
        vectors.append(v / np.linalg.norm(v))
    return {size: (np.array(numbers), np.array(vectors)) for size, (numbers, vectors) in out.items()}


def _worthwhile(base: DataFrame, threshold: float, pivots: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The pivots, or as few of them as make the least work on a sample of fixed size.

    Where bounds prune little, a vector is a guest in most cells, and more cells mean more
    copies and more rows that meet; with one pivot each vector is in one cell.
    """
    theta = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    trial = base.orderBy(F.xxhash64(F.lit(1), "id", "kind"), "id").limit(TRIAL_ROWS).select("size", "embedding").toArrow()
    n = sum(len(numbers) for numbers, _ in pivots.values())
    tried = sorted({max(1, n >> k) for k in range(0, n.bit_length() + 1, 2)} | {1}, reverse=True) if n else []
    found = []
    for some in tried:
        fewer = {s: (numbers[numbers < some], vectors[numbers < some]) for s, (numbers, vectors) in pivots.items() if (numbers < some).any()}
        work = 0
        for _, _, angle in _angles(trial, fewer):
            # Guests are those that no radius would spare.
            home = angle.argmin(1)
            inside = (angle <= angle.min(1)[:, None] + 2 * theta) & (np.arange(angle.shape[1]) <= home[:, None])
            work += int((inside.sum(0) ** 2).sum())
        found.append((work, fewer))
    return min(found, key=lambda f: f[0])[1] if found else pivots


def _angles(table: pa.Table, pivots: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, pivot numbers, angles) for the vectors of each length; lengths without a pivot have the one cell -1, at angle 0."""
    size, out = table.column("size").to_numpy(), []
    for s in np.unique(size).tolist():
        rows = np.flatnonzero(size == s)
        if s in pivots:
            numbers, vectors = pivots[s]
            own = _vectors(table.column("embedding").combine_chunks().take(pa.array(rows)))
            out.append((rows, numbers, np.arccos(np.clip(own @ vectors.T, -1, 1))))
        else:
            out.append((rows, np.array([-1]), np.zeros((len(rows), 1))))
    return out


def placed(base: DataFrame, threshold: float, pivots: dict) -> DataFrame:
    """The vectors in their cells: at home with the nearest pivot, and as guests in cells of smaller number that may hold a partner.

    A partner at home with pivot p lies within theta of the vector, so by the triangle
    inequality p is at most 2 theta farther than the vector's own pivot, and within theta of
    the cell's radius. ring tells the angle to the cell's pivot in steps of theta: partners
    stand in rings side by side.
    """
    theta = math.acos(max(-1.0, min(1.0, threshold))) + SLACK

    def radii(batches):
        for batch in batches:
            best: dict[int, float] = {}
            for _, numbers, angle in _angles(pa.Table.from_batches([batch]), pivots) if batch.num_rows else ():
                home = angle.argmin(1)
                for k in np.unique(home).tolist():
                    best[int(numbers[k])] = max(best.get(int(numbers[k]), 0.0), float(angle[home == k, k].max()))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.float64())], ["cell", "radius"])

    # One number for each pivot comes to the driver.
    radius = {r.cell: r.r for r in base.select("size", "embedding").mapInArrow(radii, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("r")).collect()}

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            for rows, numbers, angle in _angles(table, pivots):
                reach = np.array([radius.get(int(k), -1.0) for k in numbers])
                home = angle.argmin(1)
                at = np.arange(len(numbers))
                in_reach = (reach >= 0) & (angle <= reach + theta) & (angle <= angle[np.arange(len(rows)), home][:, None] + 2 * theta) & (at < home[:, None])
                in_reach[np.arange(len(rows)), home] = True
                i, k = np.nonzero(in_reach)
                own = table.take(pa.array(rows[i])).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(numbers[k].astype(np.int32)), pa.array(home[i] == k), pa.array((angle[i, k] / max(theta, 1e-3)).astype(np.int32))], [*own.schema.names, "cell", "at_home", "ring"])

    kind = base.schema["kind"].dataType.simpleString()
    return base.select("kind", "size", "embedding", "id", "n").mapInArrow(deal, f"kind {kind}, size int, embedding array<float>, id bigint, n bigint, cell int, at_home boolean, ring int")


KEY = ["kind", "size", "cell"]


def block_pairs(dealt: DataFrame, block_rows: int) -> DataFrame:
    """The pairs of blocks to compare: ring and chunk of either side, with their rows. A full ring is cut into chunks by a hash, so a hot cell is many tasks."""
    rings = dealt.groupBy(*KEY, "ring").agg(F.count("*").alias("rows"), F.count_if("at_home").alias("homes")).withColumn("chunks", F.ceil(F.col("rows") / block_rows).cast("int"))
    blocks = rings.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    left = blocks.select(*KEY, "ring", "chunk", "chunks", "homes", "rows").withColumn("to", F.explode(F.array(F.col("ring"), F.col("ring") + 1)))
    right = blocks.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("ring").alias("ring2"), F.col("chunk").alias("chunk2"), F.col("homes").alias("homes2"), F.col("rows").alias("rows2"))
    same = F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("size") == F.col("_size")) & (F.col("cell") == F.col("_cell")) & (F.col("to") == F.col("ring2"))
    met = left.join(right, same).where("(homes > 0 or homes2 > 0) and (ring <> ring2 or chunk <= chunk2)")
    return met.select(*KEY, "ring", "chunk", "ring2", "chunk2", "rows", "rows2", "chunks")


def cosine_pairs(items: DataFrame, threshold: float, by: str, id_column: str = "asset_id", block_rows: int = BLOCK_ROWS, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(a, b, similarity, n_a, n_b): all pairs a < b of different vectors of the same kind (column `by`) with a cosine of at least `threshold`.

    Exact: a and b are the least ids of vectors that n_a and n_b rows have, see
    `representatives`; equal vectors are one and need no pair. Each pair is compared once,
    in the cell where one of the two is at home; what shares no cell is never compared.
    Vectors of different lengths are no pairs. Empty tables give no rows.
    """
    base = stored(distinct_vectors(items, by, id_column), "vectors")
    dealt = stored(placed(base, threshold, _worthwhile(base, threshold, _pivots(base, most_pivots))), "cells")
    plan = stored(block_pairs(dealt, block_rows).withColumn("task", F.monotonically_increasing_id()), "blocks")
    chunk = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    sides = plan.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("ring").alias("_ring"), F.col("chunk").alias("_chunk"), "task", F.lit(0).alias("side")).unionByName(
        plan.where("ring <> ring2 or chunk <> chunk2").select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("ring2").alias("_ring"), F.col("chunk2").alias("_chunk"), "task", F.lit(1).alias("side"))
    )
    size = dealt.groupBy(*KEY, "ring").agg(F.ceil(F.count("*") / block_rows).alias("chunks"))
    size = size.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("ring").alias("_ring"), "chunks")
    same = F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("size") == F.col("_size")) & (F.col("cell") == F.col("_cell")) & (F.col("ring") == F.col("_ring"))
    chunked = dealt.join(size, same).drop(*[f"_{k}" for k in KEY], "_ring").withColumn("chunk", chunk(F.col("chunks")))
    sent = chunked.join(sides, same & (F.col("chunk") == F.col("_chunk"))).select("task", "side", "id", "n", "at_home", "embedding")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, n, home = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "at_home"))
        v = _vectors(table.column("embedding").combine_chunks())
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        others, parts = v[right], []
        for lo in range(0, max(1, len(left)), STRIP_ROWS):
            near = v[left[lo : lo + STRIP_ROWS]] @ others.T
            i, j = np.nonzero(near >= threshold)
            value, a, b = np.minimum(near[i, j], 1.0), left[i + lo], right[j]
            keep = (home[a] | home[b]) & ((ids[a] < ids[b]) if right is left else np.ones(len(a), bool)) & (value >= threshold)
            parts.append((a[keep], b[keep], value[keep]))
        a, b, value = (np.concatenate(p) for p in zip(*parts))
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.table({"a": ids[a], "b": ids[b], "similarity": value, "n_a": n[a], "n_b": n[b]})

    return sent.groupBy("task").applyInArrow(compare, "a bigint, b bigint, similarity double, n_a bigint, n_b bigint")
