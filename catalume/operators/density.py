"""A map of items: the neighbour graph, density clusters from its spanning forest, and coordinates by attraction and repulsion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalume.adapters import stored
from catalume.operators.similarity_join import MOST_PIVOTS, _pivots, _vectors

#: Rows of a chunk, which is compared at once; of a block, which is a task's side; those from which on blocks are split for more tasks.
CHUNK_ROWS, BLOCK_ROWS, LEAST_ROWS = 512, 1 << 15, 1 << 10
#: Chunks of its block that bound a vector's distances, and neighbours that wait until the least are chosen.
BOUND_CHUNKS, MOST_HITS = 8, 1 << 20
#: Slack on distances against the rounding of products: two equal unit vectors may be 6e-8 apart.
SLACK = 1e-7


def neighbours(items: DataFrame, k: int, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(a, b, d): each vector's k nearest others by the distance of unit vectors, ties to the smaller id; exact.

    Vectors are sorted by the cell of their nearest pivot into blocks, which meet in pairs, a
    task each, chunk by chunk. A vector's k-th distance to what lies close to it in its own
    block bounds what it takes elsewhere, and the bound sinks with what is found; chunks whose
    centres and radii show that they hold nothing nearer are not compared. Of equal vectors
    only the k + 1 of least ids can be neighbours and meet others; any further copy has the
    first k as its neighbours. items: asset_id (unique) and embedding, all of one length, none zero.
    """
    spark = items.sparkSession
    rows = stored(items.select(F.col("asset_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")), "vectors")
    base = stored(rows.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("id"))).where(F.col("r") <= k + 1), "firsts")
    pivots = [v for _, v in _pivots(base.withColumn("kind", F.lit(0)).withColumn("size", F.size("embedding")), most_pivots).values()]
    if not pivots:
        return spark.createDataFrame([], "a bigint, b bigint, d double")
    (centres,) = pivots

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.argmax(_vectors(batch.column(1)) @ centres.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], ["id", "embedding", "cell"])

    dealt = stored(base.select("id", "embedding").mapInArrow(deal, "id bigint, embedding array<float>, cell int"), "cells")
    # One number for each pivot comes to the driver.
    sizes = {r.cell: r["count"] for r in dealt.groupBy("cell").count().collect()}
    side = math.ceil(math.sqrt(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    first, parts, place, n = _blocked(centres, sizes, min(BLOCK_ROWS, max(LEAST_ROWS, -(-sum(sizes.values()) // side))))
    of = lambda values: F.array(*[F.lit(int(v)) for v in values])[F.col("cell")]
    block = (of(first) + F.pmod(F.xxhash64("id"), of(parts))).cast("int")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = _ordered(ids, table.column("place").to_numpy())
        vectors = table.column("embedding").combine_chunks().take(pa.array(order)).flatten().to_numpy().astype(np.float32, copy=False)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids[order].tobytes()]), "vectors": pa.array([vectors.tobytes()]), "bounds": pa.array([_bounds(_unit(vectors, len(ids)), k).tobytes()])})

    placed = dealt.select("id", "embedding", block.alias("block"), of(place).alias("place"))
    blocks = placed.groupBy("block").applyInArrow(pack, "block int, ids binary, vectors binary, bounds binary").repartitionById(n, "block")
    x, y = (blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in ("block", "ids", "vectors", "bounds")]) for s in "xy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for s in "xy":
                    ids, bounds = (np.frombuffer(batch.column(f"{s}_{c}")[row].as_buffer(), t) for c, t in (("ids", np.int64), ("bounds", np.float64)))
                    sides.append((ids, _unit(np.frombuffer(batch.column(f"{s}_vectors")[row].as_buffer(), np.float32), len(ids)), bounds))
                same = batch.column("x_block")[row].as_py() == batch.column("y_block")[row].as_py()
                for own, other, found in _met(*sides, same, k):
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(other), pa.array(found)], ["a", "b", "d"])

    found = x.hint("shuffle_replicate_nl").join(y, F.col("x_block") <= F.col("y_block")).mapInArrow(run, "a bigint, b bigint, d double")
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= k).drop("r")
    if rows.count() == base.count():
        return near
    most = base.groupBy("embedding").agg(F.max("r").alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.col("id")))).alias("b")).where(F.col("n") > k)
    further = rows.join(base.select("id"), "id", "left_anti").join(most, "embedding").select(F.col("id").alias("a"), F.explode("b").alias("b"), F.lit(0.0).alias("d"))
    return near.union(further)


def _unit(vectors: np.ndarray, n: int) -> np.ndarray:
    out = vectors.reshape(n, -1).astype(np.float64)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k least entries, least first, ties to the smaller column; no row is sorted whole."""
    k = min(k, d.shape[1])
    row, column = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((d[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


def _taken(rough: np.ndarray, rows: np.ndarray, columns: np.ndarray, least: np.ndarray, k: int, of_rows: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(askers, others, products): the rows, or else the columns, ask for what reaches their least product, by products of single precision and then exactly; where that is much, each takes its k nearest."""
    low = (least - (rows.shape[1] + 4) * 2.0**-23).astype(np.float32)
    row, column = np.divmod(np.flatnonzero(rough >= (low[:, None] if of_rows else low)), len(columns))
    if len(row) > 2 * k * len(least):
        s = rows @ columns.T if of_rows else columns @ rows.T
        d = np.where(s >= least[:, None], _distances(s), np.inf)
        asker, other = _least(d, k)
        some = np.isfinite(d[asker, other])
        return asker[some], other[some], s[asker, other][some]
    product = np.einsum("ij,ij->i", rows[row], columns[column])
    asker, other = (row, column) if of_rows else (column, row)
    keep = product >= least[asker]
    return asker[keep], other[keep], product[keep]


def _distances(products: np.ndarray) -> np.ndarray:
    """Distances of unit vectors; products that are 1 but for rounding are 0 apart."""
    return np.where(products > 1 - SLACK**2 / 2, 0, np.sqrt(np.maximum(2 - 2 * products, 0))).round(9)


def _ordered(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The order by place, and by id in each chunk, so that a chunk's smaller column has the smaller id."""
    order = np.lexsort((ids, place))
    return order[np.lexsort((ids[order], np.arange(len(ids)) // CHUNK_ROWS))]


def _blocked(centres: np.ndarray, sizes: dict[int, int], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each cell its first block, the blocks it is split over and its place in a chain of near cells; and the number of blocks, of about `most` rows or fewer."""
    first, parts, place = (np.full(len(centres), v) for v in (0, 1, 0))
    left, at, fill, n = np.ones(len(centres), bool), 0, 0, 0
    for k in range(len(centres)):
        left[at], place[at], size = False, k, sizes.get(at, 0)
        parts[at] = max(1, -(-size // most))
        if n == 0 or fill + size > most:
            n, fill = n + int(parts[at]), most if parts[at] > 1 else 0
        first[at], fill = n - parts[at], fill + size
        if left.any():
            at = int(np.argmax(np.where(left, centres @ centres[at], -np.inf)))
    return first, parts, place, n


def _chunks(v: np.ndarray) -> tuple[list[slice], np.ndarray, np.ndarray]:
    """The chunks of unit vectors, their centres, and the largest angle of a chunk to its centre."""
    at = [slice(lo, min(len(v), lo + CHUNK_ROWS)) for lo in range(0, len(v), CHUNK_ROWS)]
    centres = np.array([v[c].sum(0) for c in at])
    length = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = np.where(length > 1e-9, centres / np.maximum(length, 1e-9), v[[c.start for c in at]])
    return at, centres, np.array([np.arccos(np.clip((v[c] @ m).min(), -1, 1)) for c, m in zip(at, centres)])


def _bounds(v: np.ndarray, k: int) -> np.ndarray:
    """For each vector a distance within which k others lie: its k-th in the nearest chunks of its block, or infinity."""
    at, centres, _ = _chunks(v)
    out = np.full(len(v), np.inf)
    for c, m in zip(at, centres):
        near = np.argsort(-(centres @ m), kind="stable")[:BOUND_CHUNKS]
        rows = np.concatenate([np.arange(at[j].start, at[j].stop) for j in near.tolist()])
        s = v[c] @ v[rows].T
        s[rows[None, :] == np.arange(c.start, c.stop)[:, None]] = -np.inf
        if s.shape[1] > k:
            out[c] = np.sqrt(np.maximum(2 - 2 * np.partition(s, -k, axis=1)[:, -k], 0))
    return out


class _Nearest:
    """The k nearest of those offered to each of some vectors, and the products from which on another may be one of them."""

    def __init__(self, ids: np.ndarray, others: np.ndarray, bounds: np.ndarray, k: int) -> None:
        self.ids, self.others, self.bounds, self.k, self.held, self.n = ids, others, bounds.copy(), k, [], 0
        self.least = self._products(self.bounds)

    @staticmethod
    def _products(bounds: np.ndarray) -> np.ndarray:
        return 1 - (np.minimum(bounds, 2) + SLACK) ** 2 / 2

    def offer(self, row: np.ndarray, other: np.ndarray, product: np.ndarray) -> None:
        self.held.append((row, other, _distances(product)))
        self.n += len(row)
        if self.n > MOST_HITS:
            self.chosen()

    def chosen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, others, distances) of the k nearest so far."""
        row, other, d = (np.concatenate(v) for v in zip(*self.held)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((self.others[other], d, row))
        row, other, d = row[order], other[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        full = rank == self.k - 1
        self.bounds[row[full]] = np.minimum(self.bounds[row[full]], d[full])
        self.least = self._products(self.bounds)
        keep = rank < self.k
        self.held, self.n = [(row[keep], other[keep], d[keep])], 0
        return self.held[0]


def _met(x: tuple, y: tuple, same: bool, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ids of neighbours, distances): of blocks (ids, unit vectors, bounds) the k nearest in y for x's vectors, and in x for y's if it is another block; those beyond the bounds are left out."""
    (x_ids, xv, x_bounds), (y_ids, yv, y_bounds) = x, y
    asks, asked = _Nearest(x_ids, y_ids, x_bounds, k), _Nearest(y_ids, x_ids, y_bounds, k)
    x_at, x_centres, x_radius = _chunks(xv)
    y_at, y_centres, y_radius = _chunks(yv)
    x_rough, y_rough = xv.astype(np.float32), yv.astype(np.float32)
    for c, centre, radius in zip(x_at, x_centres, x_radius):
        product = np.clip(y_centres @ centre, -1, 1)
        gap = np.arccos(product) - radius - y_radius
        for j in np.argsort(-product, kind="stable").tolist():
            e = y_at[j]
            reach = asks.bounds[c].max() if same else max(asks.bounds[c].max(), asked.bounds[e].max())
            # An angle of gap is a distance of 2 sin(gap / 2).
            if 2 * np.sin(min(max(gap[j], 0), np.pi) / 2) > reach + SLACK:
                continue
            rough = x_rough[c] @ y_rough[e].T
            row, other, product = _taken(rough, xv[c], yv[e], asks.least[c], k + 1 if same and c == e else k, True)
            if same and c == e:
                row, other, product = (v[row != other] for v in (row, other, product))
            asks.offer(row + c.start, other + e.start, product)
            if not same:
                row, other, product = _taken(rough, xv[c], yv[e], asked.least[e], k, False)
                asked.offer(row + e.start, other + c.start, product)
    for side in (asks,) if same else (asks, asked):
        row, other, d = side.chosen()
        yield side.ids[row], side.others[other], d


def reachability(near: DataFrame, k: int) -> DataFrame:
    """(a, b, w), a < b: each neighbour pair once, at the largest of its distance and both ends' distances to their k-th neighbour (or last, if fewer)."""
    core = near.groupBy("a").agg(F.max("d").alias("core"))
    pairs = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))
    return pairs.join(core.withColumnRenamed("core", "x"), "a").join(core.select(F.col("a").alias("b"), F.col("core").alias("y")), "b").select("a", "b", F.greatest("d", "x", "y").alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w): the minimum spanning forest of (a, b, w), ties by (w, a, b), by Borůvka's rounds.

    In a round every component takes its least edge to another one; the components these
    edges join become one by pointer doubling, and of the edges between two components the
    least stays. The rounds follow the logarithm of the nodes.
    """
    # u and v are the components of the ends; a, b and w name the edge.
    now, parts = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct("w", "a", "b").alias("e")), "edges"), []
    while now.limit(1).count():
        both = now.select("u", "v", "e").union(now.select("v", "u", "e"))
        least = stored(both.groupBy("u").agg(F.min(F.struct("e", "v")).alias("x")).select("u", F.col("x.e").alias("e"), F.col("x.v").alias("to")), "least")
        parts.append(least.select("e.a", "e.b", "e.w").distinct())
        # Of two components that chose each other the smaller is the root.
        other = least.select(F.col("u").alias("to"), F.col("to").alias("back"))
        up = least.join(other, "to").select("u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("to")), F.col("u")).otherwise(F.col("to")).alias("root"))
        roots = _jumped(stored(up, "up"))
        name = lambda c: roots.select(F.col("u").alias(c), F.col("root").alias(f"{c}_"))  # noqa: E731, B023
        moved = now.join(name("u"), "u").join(name("v"), "v").where("u_ <> v_")
        now = stored(moved.groupBy(F.least("u_", "v_").alias("u"), F.greatest("u_", "v_").alias("v")).agg(F.min("e").alias("e")), "edges")
    out = edges.select("a", "b", "w").limit(0)
    for part in parts:
        out = out.union(part)
    return out


def _jumped(up: DataFrame) -> DataFrame:
    """(u, root) with every pointer led to its root: each step doubles its reach."""
    while True:
        next_ = up.select(F.col("u").alias("root"), F.col("root").alias("far"))
        after = stored(up.join(next_, "root", "left").select("u", F.coalesce("far", "root").alias("to"), F.col("root").alias("was")), "up")
        up = after.select("u", F.col("to").alias("root"))
        if not after.where("to <> was").limit(1).count():
            return up


def _merged(edges: DataFrame) -> DataFrame:
    """(u, root): the components of a forest's edges (u, v), for all its nodes; a component's root is its least node."""
    up = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("to")).select("u", F.least("u", "to").alias("root")), "least")
        step = _jumped(least)
        up = step if up is None else stored(up.join(step.select(F.col("u").alias("root"), F.col("root").alias("far")), "root", "left").select("u", F.coalesce("far", "root").alias("root")), "up")
        name = lambda c: step.select(F.col("u").alias(c), F.col("root").alias(f"{c}_"))  # noqa: E731, B023
        edges = stored(edges.join(name("u"), "u").join(name("v"), "v").where("u_ <> v_").select(F.col("u_").alias("u"), F.col("v_").alias("v")).distinct(), "edges")
        if not edges.limit(1).count():
            return up


def levels(low: float, high: float, n: int) -> list[float]:
    """n distances from the least to the largest edge, in equal ratios; the last one takes all edges."""
    low = max(low, high * 1e-3, 1e-9)
    return [low * (high / low) ** (k / max(1, n - 1)) for k in range(n - 1)] + [max(high, low)]


def clusters(forest: DataFrame, nodes: DataFrame, least_size: int = 5, n_levels: int = 12) -> DataFrame:
    """(asset_id, cluster): density clusters; -1 is noise, a cluster's name is its least id at the level where it is largest.

    The forest is cut at `n_levels` distances. A component of at least `least_size` items is a
    branch as long as, going up, it takes in no other such component; where two or more meet,
    a new branch begins. A branch is as stable as the sum over its levels of its items times
    the gain in density (1 / distance) to the level above. Going up, a branch wins against its
    inner branches if it is at least as stable as the best of them together; each item is in
    the outermost winner around it. Every level works on the components of the level below.
    """
    span = forest.agg(F.min("w"), F.max("w")).first()
    ids = nodes.select(F.col("asset_id").cast("bigint").alias("asset_id"))
    if span[0] is None:
        return ids.select("asset_id", F.lit(-1).cast("bigint").alias("cluster"))
    cut = levels(span[0], span[1], n_levels)
    # at: the component of each item at this level; tree: the branches, for each level.
    at = stored(ids.select("asset_id", F.col("asset_id").alias("comp")), "items")
    edges = stored(forest.select(F.col("a").alias("u"), F.col("b").alias("v"), "w"), "edges")
    branches, tree, items = None, [], []
    for k, distance in enumerate(cut):
        inner = edges.where(F.col("w") <= distance).select("u", "v")
        if inner.limit(1).count():
            roots = _merged(inner)
            led = lambda df, c: df.join(roots.select(F.col("u").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")  # noqa: E731, B023
            at = stored(led(at, "comp").select("asset_id", "comp"), "items")
            edges = stored(led(led(edges.where(F.col("w") > distance), "u"), "v").select("u", "v", "w"), "edges")
            if branches is not None:
                branches = led(branches.withColumn("comp", F.col("old")), "comp")
        gain = 1 / distance - (1 / cut[k + 1] if k + 1 < len(cut) else 0.0)
        big = at.groupBy("comp").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
        born = F.col("comp") * len(cut) + k
        if branches is None:
            own = big.select("comp", born.alias("branch"), (F.col("size") * gain).alias("stable"), F.lit(0.0).alias("inner"))
        else:
            held = branches.groupBy("comp").agg(F.count("*").alias("n"), F.min("branch").alias("only"), F.sum("stable").alias("s"), F.sum("inner").alias("i"), F.sum(F.greatest("stable", "inner")).alias("best"))
            one = F.col("n") == 1
            grown = F.col("size") * gain + F.when(one, F.col("s")).otherwise(0.0)
            own = big.join(held, "comp", "left").select("comp", F.when(one, F.col("only")).otherwise(born).alias("branch"), grown.alias("stable"), F.when(one, F.col("i")).otherwise(F.coalesce("best", F.lit(0.0))).alias("inner"))
        own = stored(own.withColumn("old", F.col("comp")), "branches")
        branches = own
        tree.append(own.select(F.lit(k).alias("level"), "comp", "branch", "stable", "inner"))
        items.append(at.select(F.lit(k).alias("level"), "asset_id", "comp"))
    every, places = _all(tree), _all(items)
    # A branch's last level has its sums.
    last = every.groupBy("branch").agg(F.max(F.struct("level", "stable", "inner", "comp")).alias("x"))
    won = last.where(F.col("x.stable") >= F.col("x.inner")).select("branch", F.col("x.comp").alias("cluster"), F.col("x.level").alias("top"))
    of = every.join(won, "branch").select("level", "comp", "cluster", "top")
    found = places.join(of, ["level", "comp"]).groupBy("asset_id").agg(F.max_by("cluster", F.struct("top", "level")).alias("cluster"))
    return ids.join(found, "asset_id", "left").select("asset_id", F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def _moves(held: list[tuple[float, float]], step: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step of (id, x, y, mx, my): towards the mean of the neighbours, if there are any, and away from the held places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, *means = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            away = [np.zeros(len(x)), np.zeros(len(x))]
            for sx, sy in held:
                dx, dy = x - sx, y - sy
                near = 0.1 + dx * dx + dy * dy
                away[0] += dx / near
                away[1] += dy / near
            moved = [c + step * (np.where(batch.column(i).is_valid().to_numpy(zero_copy_only=False), m - c, 0.0) + t / len(held)) for c, m, t, i in zip((x, y), means, away, (3, 4))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(moved[0]), pa.array(moved[1])], ["id", "x", "y"])

    return run


def coordinates(items: DataFrame, edges: DataFrame, rounds: int = 5, sample: int = 256, step: float = 0.2) -> DataFrame:
    """(asset_id, x, y): principal components, then rounds in which edges attract their ends and a fixed sample of items repels all.

    The sample (the `sample` items of least hash) is the one thing sent to every task; an
    item's edges are summed before the shuffle.
    """
    if not items.limit(1).count():
        return items.sparkSession.createDataFrame([], "asset_id bigint, x double, y double")
    rows = items.select("asset_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    at = vector_to_array(F.col("place"))
    first = PCA(k=2, inputCol="features", outputCol="place").fit(rows).transform(rows).select(F.col("asset_id").cast("bigint").alias("id"), at[0].alias("x"), at[1].alias("y"))
    spread = first.agg(F.coalesce(F.stddev("x"), F.lit(1.0)), F.coalesce(F.stddev("y"), F.lit(1.0))).first()
    now = stored(first.select("id", *[(F.col(c) / (s or 1.0)).alias(c) for c, s in zip("xy", spread)]), "places")
    both = stored(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    for _ in range(rounds):
        other = now.select(F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        pull = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.avg("x2").alias("mx"), F.avg("y2").alias("my"))
        held = [(r.x, r.y) for r in now.orderBy(F.xxhash64("id"), "id").limit(sample).select("x", "y").collect()]
        now = stored(now.join(pull, "id", "left").mapInArrow(_moves(held, step), "id bigint, x double, y double"), "places")
    return now.withColumnRenamed("id", "asset_id")


def item_map(items: DataFrame, k: int = 10, least_size: int = 5, n_levels: int = 12, rounds: int = 5) -> DataFrame:
    """(asset_id, x, y, cluster) of all items with a vector; see `neighbours`, `clusters` and `coordinates`. Null and zero vectors have no place."""
    rows = stored(items.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select(F.col("asset_id").cast("bigint").alias("asset_id"), "embedding"), "items")
    near = stored(neighbours(rows, k), "near")
    edges = stored(reachability(near, k), "edges")
    forest = stored(spanning_forest(edges), "forest")
    return coordinates(rows, edges, rounds).join(clusters(forest, rows, least_size, n_levels), "asset_id").select("asset_id", "x", "y", "cluster")
