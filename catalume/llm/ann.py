"""Nearest neighbours: a block matrix join with int8 product tiles, error bounds, and heaps.

Vectors travel as int8 codes with a scale and the norms of what the codes miss. Every block of
queries meets every block of candidates; a task holds one block of queries, streams a slab of
candidate blocks past it, and carries each query's threshold from tile to tile: a candidate
stays while its product plus bound reaches the k-th best product minus bound. What survives in
all slabs is merged, and only then are the survivors' own vectors fetched, multiplied in
double precision and merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm import kernels as K

#: Rows of a block of queries and of candidates; a tile has the product of both.
QUERY_BLOCK = 512
ROW_BLOCK = 4096
#: Slabs into which a query block's candidates are dealt at most: tasks beside each other, and lists to merge.
SLABS = 64
#: Components whose int8 products add up exactly in single precision: 127 * 127 * 1024 < 2**24.
EXACT_DIM = 1024
#: Survivors a query from which a task weeds its lists.
WEED = 8


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of vectors that are not null, empty or zero and hold neither null nor non-finite components; of rows that repeat an id the least vector."""
    v = F.col(vector_column)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = df.where(v.isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), v.cast("array<double>").alias("v"))
    return good.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of the codes' error and of the codes' values."""
    scale = np.maximum(np.abs(v).max(1) / 127.0, 5e-324)
    codes = np.clip(np.rint(v / scale[:, None]), -127, 127)
    value = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.sqrt(((v - value) ** 2).sum(1)), np.sqrt((value**2).sum(1))


_CODED = "dim int, block int, id bigint, code binary, scale double, error double, norm double, same bigint"


def coded(rows: DataFrame) -> DataFrame:
    """Each vector as int8 codes; `same` is a hash of its bytes, equal for equal vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                batch = whole.filter(pa.array(dims == dim))
                v = _matrix(batch, "v", dim) + 0.0  # -0.0 becomes 0.0, so equal vectors have equal bytes
                codes, scale, error, norm = quantised(v)
                at = np.arange(len(v) + 1) * v.itemsize * dim
                data = np.frombuffer(v.tobytes(), np.uint8)
                same = K.span_hashes(K.prefix_hashes(data), at[:-1], at[1:]).view(np.int64)
                raw = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("block"), batch.column("id"), raw, *map(pa.array, (scale, error, norm, same))], ["dim", "block", "id", "code", "scale", "error", "norm", "same"])

    return rows.select("dim", "block", "id", "v").mapInArrow(run, _CODED)


class Block:
    """Vectors of one block: codes, scales, error norms, value norms, ids and hashes, in the order of the ids."""

    def __init__(self, raw: memoryview | bytes, dim: int) -> None:
        n = len(raw) // (dim + 40)
        self.ids, self.same = np.frombuffer(raw, np.int64, 2 * n).reshape(2, n)
        self.scale, self.error, self.norm = np.frombuffer(raw, np.float64, 3 * n, 16 * n).reshape(3, n)
        self.codes = np.frombuffer(raw, np.int8, n * dim, 40 * n).reshape(n, dim).astype(np.float32)


def _rank_in_runs(fresh: np.ndarray) -> np.ndarray:
    """The place of each element in its run; fresh marks where runs begin."""
    first = np.flatnonzero(fresh)
    return np.arange(len(fresh)) - first[np.cumsum(fresh) - 1]


def gathered(rows: DataFrame, copies: int | None) -> DataFrame:
    """(dim, block, payload): each block as one binary. Of equal vectors the `copies` smallest ids stay: no other can be among the nearest."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in K.groups(batches, "key"):
            ids, same = (group.column(c).to_numpy() for c in ("id", "same"))
            order = np.lexsort((ids, same))
            if copies is not None:
                own = same[order]
                order = order[_rank_in_runs(np.concatenate(([True], own[1:] != own[:-1]))) < copies]
            order = order[np.argsort(ids[order])]
            parts = [ids[order], same[order], *(group.column(c).to_numpy()[order] for c in ("scale", "error", "norm"))]
            codes = group.column("code").to_pylist()
            payload = b"".join(p.tobytes() for p in parts) + b"".join(codes[i] for i in order.tolist())
            yield pa.RecordBatch.from_arrays([pa.array([group.column(c)[0].as_py()], pa.int32()) for c in ("dim", "block")] + [pa.array([payload], pa.binary())], ["dim", "block", "payload"])

    return _by_key(rows.withColumn("key", F.concat_ws(":", F.col("dim").cast("string"), F.col("block").cast("string")))).mapInArrow(gather, "dim int, block int, payload binary")


def _by_key(rows: DataFrame, *then: str) -> DataFrame:
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "key").sortWithinPartitions("key", *then)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added from the first component to the last."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


class Survivors:
    """What may still be among the k nearest of each query of a block: (query row, id, hash, least and most score)."""

    def __init__(self, queries: int, k: int) -> None:
        self.queries, self.k = queries, k
        self.least = np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def tile(self, q: Block, c: Block) -> None:
        """All products of the two blocks.

        |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'| for the codes' values q' and c'; the bound
        also covers the rounding of double-precision sums.
        """
        dim = q.codes.shape[1]
        near = np.zeros((len(q.ids), len(c.ids)))
        for lo in range(0, dim, EXACT_DIM):
            near += q.codes[:, lo : lo + EXACT_DIM] @ c.codes[:, lo : lo + EXACT_DIM].T
        near *= q.scale[:, None]
        near *= c.scale[None, :]
        whole = (q.norm + q.error)[:, None] * (c.norm + c.error)[None, :]
        bound = (q.error[:, None] * (c.norm + c.error)[None, :] + q.norm[:, None] * c.error[None, :]) * (1 + 1e-9) + whole * (1e-12 + dim * 4e-16)
        with np.errstate(invalid="ignore"):
            low, high = np.nan_to_num(near - bound, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(near + bound, nan=np.inf, posinf=np.inf, neginf=-np.inf)
        own = q.ids[:, None] == c.ids[None, :]
        low[own] = high[own] = -np.inf
        if low.shape[1] >= self.k:
            self.least = np.maximum(self.least, np.partition(low, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((high >= self.least[:, None]) & ~own)
        self.add(row, c.ids[col], c.same[col], low[row, col], high[row, col])

    def add(self, *rows: np.ndarray) -> None:
        self.held.append(rows)
        self.count += len(rows[0])
        if self.count > WEED * self.k * self.queries + 100_000:
            self.weed()

    def weed(self) -> tuple[np.ndarray, ...]:
        """Drops what the k-th best least score excludes, and equal vectors beyond the k smallest ids."""
        row, ids, same, low, high = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64, np.float64))
        order = np.lexsort((ids, same, row))
        row, ids, same, low, high = (x[order] for x in (row, ids, same, low, high))
        few = _rank_in_runs(np.concatenate(([True], (row[1:] != row[:-1]) | (same[1:] != same[:-1])))) < self.k if len(row) else np.zeros(0, bool)
        row, ids, same, low, high = (x[few] for x in (row, ids, same, low, high))
        order = np.lexsort((-low, row))
        if len(row):
            place = _rank_in_runs(np.concatenate(([True], row[order][1:] != row[order][:-1])))
            kth = order[place == self.k - 1]
            self.least[row[kth]] = np.maximum(self.least[row[kth]], low[kth])
        stay = high >= self.least[row]
        self.held = [tuple(x[stay] for x in (row, ids, same, low, high))]
        self.count = len(self.held[0][0])
        return self.held[0]


def _tiles(k: int):
    """For each task (a query block and a slab of candidate blocks) its survivors; candidate blocks stream past the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = block = found = dim = asked = None

        def out() -> Iterator[pa.RecordBatch]:
            if found is not None:
                parts = found.weed()
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([asked], pa.int32()), pa.array([b"".join(p.astype(t).tobytes() for p, t in zip(parts, ("<i8", "<i8", "<i8", "<f8", "<f8")))], pa.binary())], ["dim", "asked", "payload"])

        for batch in batches:
            for i in range(batch.num_rows):
                own, kind, raw = batch.column("key")[i].as_py(), batch.column("kind")[i].as_py(), batch.column("payload")[i].as_buffer()
                if kind == 0:
                    yield from out()
                    key, dim, asked = own, batch.column("dim")[i].as_py(), batch.column("asked")[i].as_py()
                    block = Block(raw, dim)
                    found = Survivors(len(block.ids), k)
                elif own == key:
                    found.tile(block, Block(raw, dim))
        yield from out()

    return run


def _merged(k: int):
    """For each query block its survivors over all slabs: (dim, asked, id, the query rows that want it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, place = None, None, ()

        def out() -> Iterator[pa.RecordBatch]:
            if found is not None:
                row, ids = found.weed()[:2]
                order = np.lexsort((row, ids))
                row, ids = row[order], ids[order]
                first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(row.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(first), pa.int32()) for p in place] + [pa.array(ids[first], pa.int64()), lists], ["dim", "asked", "id", "rows"])

        for batch in batches:
            for i in range(batch.num_rows):
                own, raw = batch.column("key")[i].as_py(), batch.column("payload")[i].as_buffer()
                n = raw.size // 40
                parts = [np.frombuffer(raw, t, n, 8 * n * j) for j, t in enumerate(("<i8", "<i8", "<i8", "<f8", "<f8"))]
                if own != key:
                    yield from out()
                    key, found, place = own, Survivors(QUERY_BLOCK, k), (batch.column("dim")[i].as_py(), batch.column("asked")[i].as_py())
                top = int(parts[0].max(initial=-1)) + 1
                if top > found.queries:
                    found.queries, found.least = top, np.concatenate((found.least, np.full(top - found.queries, -np.inf)))
                found.add(*parts)
        yield from out()

    return run


def _recomputed(k: int):
    """Exact products of the survivors, and each query's k best by a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, q, heaps = None, np.zeros(0, np.int64), np.zeros((0, 1)), []

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(int(i), n, -v, s) for i, heap in zip(ids, heaps) for n, (s, v) in enumerate(sorted(heap, key=lambda x: (-x[0], -x[1])), 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            keys, kinds = batch.column("key").to_pylist(), batch.column("kind").to_numpy()
            edge = [0, *(np.flatnonzero([a != b for a, b in zip(keys[1:], keys[:-1])]) + 1).tolist(), len(keys)]
            for lo, hi in zip(edge[:-1], edge[1:]):
                if keys[lo] != key:
                    yield from out()
                    key = keys[lo]
                    dim = batch.column("dim")[lo].as_py()
                    ids, q = np.zeros(0, np.int64), np.zeros((0, dim))
                    heaps = []
                part = batch.slice(lo, hi - lo)
                mine = part.filter(pa.array(kinds[lo:hi] == 0))
                if mine.num_rows:  # query rows come first, in the order of their ids
                    ids, q = np.concatenate((ids, mine.column("id").to_numpy())), np.concatenate((q, _matrix(mine, "v", dim)))
                    heaps += [[] for _ in range(mine.num_rows)]
                rest = part.filter(pa.array(kinds[lo:hi] == 1))
                if rest.num_rows:
                    lists = rest.column("rows")
                    row, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                    at = np.repeat(np.arange(rest.num_rows), size)
                    c, names = _matrix(rest, "v", dim), rest.column("id").to_numpy()
                    for a in range(0, len(row), 8192):
                        score = exact(q[row[a : a + 8192]], c[at[a : a + 8192]])
                        for r, s, v in zip(row[a : a + 8192].tolist(), score.tolist(), names[at[a : a + 8192]].tolist()):
                            if len(heaps[r]) < k:
                                heapq.heappush(heaps[r], (s, -v))
                            else:
                                heapq.heappushpop(heaps[r], (s, -v))
        yield from out()

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", metric: str = "inner_product") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of the largest inner product (or cosine), its own row left out.

    The result is exact at every number of components: all tiles of query and candidate blocks
    are visited, and int8 products with error bounds only decide which pairs are recomputed.
    Only vectors of one length meet. Vectors null, empty, zero or with null or non-finite
    components take no part, nor do null ids; rows that repeat an id are one row, with the
    least of their vectors by components. Equal vectors are told by a 61-bit hash, and of
    them those with the smallest ids are kept. Fewer than k candidates give fewer rows; an
    empty side gives none. Other columns are ignored.
    """
    if metric not in ("inner_product", "cosine"):
        raise ValueError(metric)

    def ready(df: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
        """The vectors with their dim and block, and the number of blocks of each dim: one small row for each length of vectors."""
        out = usable(df, id_column, vector_column)
        if metric == "cosine":
            norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
            out = out.withColumn("norm", norm).select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))
        out = out.withColumn("dim", F.size("v"))
        sizes = out.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias("n"))
        return out.join(F.broadcast(sizes), "dim").withColumn("block", F.pmod(F.xxhash64("id", F.lit(17)), F.col("n")).cast("int")).drop("n"), sizes

    rows, row_blocks = ready(candidates, ROW_BLOCK)
    asked, asked_blocks = ready(queries, QUERY_BLOCK)
    task = lambda slab: F.concat_ws(":", F.col("dim").cast("string"), F.col("asked").cast("string"), slab.cast("string"))
    slabs = F.least(F.col("n"), F.lit(SLABS))
    left = gathered(coded(asked), None).withColumnRenamed("block", "asked").join(F.broadcast(row_blocks), "dim").withColumn("slab", F.explode(F.sequence(F.lit(0), slabs - 1)))
    right = gathered(coded(rows), k + 1).join(F.broadcast(row_blocks), "dim").withColumn("slab", F.pmod(F.col("block"), slabs)).drop("n")
    right = right.join(F.broadcast(asked_blocks), "dim").withColumn("asked", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = left.select(task(F.col("slab")).alias("key"), F.lit(0).alias("kind"), "dim", "asked", "payload").union(right.select(task(F.col("slab")), F.lit(1), "dim", "asked", "payload"))
    found = _by_key(pairs, "kind").mapInArrow(_tiles(k), "dim int, asked int, payload binary")
    key = F.concat_ws(":", F.col("dim").cast("string"), F.col("asked").cast("string"))
    wanted = _by_key(found.withColumn("key", key)).mapInArrow(_merged(k), "dim int, asked int, id bigint, rows array<int>")
    # A candidate that very many queries want is one row for each block of queries.
    fetched = wanted.join(rows.select("id", "v").hint("merge"), "id").select(key.alias("key"), F.lit(1).alias("kind"), "dim", "id", "v", "rows")
    own = asked.withColumnRenamed("block", "asked").select(key.alias("key"), F.lit(0).alias("kind"), "dim", "id", "v", F.array().cast("array<int>").alias("rows"))
    return _by_key(own.union(fetched), "kind", "id").mapInArrow(_recomputed(k), "query_id bigint, rank int, vec_id bigint, score double")
