"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, verification on full n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm import kernels as K
from catalume.llm.common import salted_join, written
from catalume.llm.components import components

NGRAM = 5
SIMILARITY = 0.8
#: Share of the pairs at exactly SIMILARITY that have to meet in a band.
RECALL = 0.998
#: Bands that a choice of rows may take by itself; where one row needs more, it gets them.
MAX_BANDS = 32
#: Documents, and shingles, that a block holds at about most; a verification task takes a pair of blocks.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 19
#: Tasks over which the list of a block's partners is dealt.
SALTS = 8


def banding(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): as many rows as at most `most` bands allow for the recall, 1 - (1 - s^rows)^bands; one row takes as many bands as it needs."""
    if not 0 < similarity <= 1 or not 0 < recall < 1:
        raise ValueError("similarity has to be in (0, 1], recall in (0, 1)")
    need = {rows: ceil(log1p(-recall) / log1p(-(similarity**rows))) if similarity < 1 else 1 for rows in range(1, 17) if similarity**rows > 1e-9}
    rows = max((k for k, bands in need.items() if bands <= most), default=1)
    return need[rows], rows


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles, and bounds; a text of fewer words, but not none, has one shingle."""
    low = K.LOWER[data]
    starts, ends, first = K.words(low, offsets)
    hashes = K.span_hashes(K.prefix_hashes(low), starts, ends)
    count = np.diff(first)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(bounds[-1], np.uint64)
    long = count >= n
    all_windows = K.windows(hashes, n)
    out[K.ranges(bounds[:-1][long], size[long])] = all_windows[K.ranges(first[:-1][long], size[long])]
    for k in np.flatnonzero(~long & (count > 0)).tolist():
        out[bounds[k]] = K.windows(hashes[first[k] : first[k + 1]], int(count[k]))[0]
    return out, bounds


def set_hash(own: np.ndarray) -> tuple[int, int]:
    """128 bits that two equal sets share."""
    return int(K.mix(own).sum(dtype=np.uint64).view(np.int64)), int(K.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands): the distinct shingles' number and 128-bit hash, and the band hashes (empty without words)."""
    draw = np.random.default_rng(1_729)
    multiply = draw.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = draw.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def sign(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, data, offsets in K.slices(batch.column(1)):
            hashes, bounds = shingles(data, offsets, n)
            count, sums = np.zeros(hi - lo, np.int64), np.zeros((hi - lo, 2), np.int64)
            for k in range(hi - lo):
                if bounds[k] < bounds[k + 1]:
                    own = np.unique(hashes[bounds[k] : bounds[k + 1]])
                    count[k], sums[k] = len(own), set_hash(own)
            have = np.flatnonzero(np.diff(bounds))
            keys = np.zeros((len(have), bands), np.uint64)
            if len(have):
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                for b in range(bands):
                    h = np.full(len(have), b, np.uint64)
                    for k in range(b * rows, b * rows + rows):
                        h = K.mix(h ^ np.minimum.reduceat(short * multiply[k] + add[k], bounds[:-1][have]).astype(np.uint64))
                    keys[:, b] = h
            size = np.zeros(hi - lo, np.int32)
            size[have] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield {"doc_id": batch.column(0).slice(lo, hi - lo), "n_shingles": count, "s1": sums[:, 0], "s2": sums[:, 1], "bands": lists}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return K.map_batches(docs, ["doc_id", "text"], sign, f"doc_id {kind}, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>")


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i from left, j from right) with a Jaccard similarity of at least `similarity`, by tiles of a shared-token product."""
    size = np.array([len(s) for s in sets])
    if len(left) * len(right) <= 4:
        pairs = [(i, j) for i in left.tolist() for j in right.tolist() if i != j and min(size[i], size[j]) >= similarity * max(size[i], size[j])]
        pairs = [(i, j) for i, j in pairs if (c := len(np.intersect1d(sets[i], sets[j], assume_unique=True))) >= similarity * (size[i] + size[j] - c) - 1e-9]
        return np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
    token, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    keep = times[where] > 1
    number = np.cumsum(times > 1) - 1
    owner, column = owner[keep], number[where[keep]]
    shared = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        tile = np.zeros((len(sets), width), np.float32)
        tile[owner[a:b], column[a:b] - lo] = 1
        shared += tile[left] @ tile[right].T
    ok = shared >= similarity * (size[left][:, None] + size[right][None, :] - shared) - 1e-6
    i, j = np.nonzero(ok & (left[:, None] != right[None, :]))
    return left[i], right[j]


def _verify(table: pa.Table, similarity: float) -> dict | None:
    """The links inside one block or between two: each member's least partner in its local group and its number of linked documents."""
    node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
    _, first = np.unique(node, return_index=True)  # a repeated row is one member
    node, copies, block = node[first], copies[first], block[first]
    raw = table.column("shingles").combine_chunks()
    sets = [np.frombuffer(raw[int(k)].as_buffer(), np.uint64) for k in first]
    one = block == block.min()
    two = ~one
    if table.column("pair")[0].as_py():
        if not two.any():
            return None  # nobody in the other block
        left, right = np.flatnonzero(one), np.flatnonzero(two)
    else:
        left = right = np.arange(len(node))
    i, j = _links(sets, left, right, similarity)
    if not len(i):
        return None
    links = np.bincount(i, copies[j], len(node))
    if table.column("pair")[0].as_py():
        links += np.bincount(j, copies[i], len(node))
    root = np.arange(len(node))
    while True:  # least label over links; nodes are sorted, so the root is the least node
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    have = np.flatnonzero(links)
    return {"node": node[have], "root": node[root[have]], "links": links[have].astype(np.int64), "many": table.column("many").to_numpy(zero_copy_only=False)[first][have]}


def near_copies(docs: DataFrame, n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row for each document: doc_id, n_shingles, rep_id, class_id and n_links.

    rep_id is the least doc_id with the same set of n-word shingles, class_id the least one
    reachable over links, n_links the number of other documents with a Jaccard similarity
    of at least `similarity`. Equal sets are one member, counted. A member's home is its most
    common band hash; homes, small ones pooled, are dealt into blocks of bounded rows and
    shingles, and two blocks meet in one task if any band hash has members in both. There all pairs are
    verified on their full shingle sets, so every pair of band-mates is, each once; only
    each member's number of links and local root leave the task.

    A text without words is alone (n_links 0), as is a row with null doc_id; a text of
    fewer than n words has one shingle. doc_id tells documents apart: rows that repeat one
    appear each, and count as each other's copies. Shingles are told apart by 64-bit hashes.
    Other columns are ignored.
    """
    spark, (bands, rows) = docs.sparkSession, banding(similarity, recall)
    signed = written(signatures(docs, n, bands, rows), "signatures")
    key = ["s1", "s2", "n_shingles"]
    reps = written(signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "representatives")
    banded = reps.select("rep", "n_shingles", F.explode("bands").alias("band"))
    shared = written(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1"), "bands")
    mates = written(salted_join(banded, shared, ["band"], "n", ["rep"]), "band-mates")
    home = mates.groupBy("rep").agg(F.max(F.struct("n", "band", "least")).alias("h"), F.first("n_shingles").alias("w"))
    home = written(home.select("rep", "h.band", "h.least", "w"), "homes")
    # Small homes are pooled with the home of their band's least member, so that a large group lies in few blocks.
    sizes = home.groupBy("band").agg(F.count("*").alias("n"), F.first("least").alias("rep")).join(home.select("rep", F.col("band").alias("pool")), "rep")
    pools = written(sizes.select("band", "n", F.when(F.col("n") < BLOCK // 2, F.col("pool")).otherwise(F.col("band")).alias("pool")), "home-pools")
    home = written(salted_join(home.select("rep", "band", "w"), pools, ["band"], "n", ["rep"]).select("rep", "pool", "w"), "pooled")
    loads = written(home.groupBy("pool").agg(F.count("*").alias("n"), F.sum("w").alias("size")), "pool-sizes")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES))
    home = salted_join(home, loads, ["pool"], "n", ["rep"]).select("rep", F.xxhash64("pool", F.pmod(F.xxhash64("rep"), parts)).alias("block"))
    home = written(home, "blocks")
    # The blocks of each band meet each other: pairs of blocks, as a common band's members lie in few.
    places = mates.select("rep", "band").join(home.hint("merge"), "rep").select("band", "block").distinct()
    meet = places.join(places.withColumnRenamed("block", "other").hint("merge"), "band").where("block <> other").select("block", "other").distinct()
    partners = written(meet, "block-pairs")
    members = home.withColumnRenamed("rep", "node").join(reps.select(F.col("rep").alias("node"), "copies", *key).hint("merge"), "node")

    def sets(batch: pa.RecordBatch) -> Iterator[dict]:
        s1, s2 = (batch.column(i).to_numpy() for i in (1, 2))
        for lo, hi, data, offsets in K.slices(batch.column(0)):
            hashes, bounds = shingles(data, offsets, n)
            raw, rows = [], []
            for k in range(hi - lo):
                own = np.unique(hashes[bounds[k] : bounds[k + 1]])
                if len(own) and set_hash(own) == (int(s1[lo + k]), int(s2[lo + k])):
                    rows.append(lo + k)
                    raw.append(own.tobytes())
            rows = pa.array(rows, pa.int64())
            yield {c: batch.column(i).take(rows) for i, c in ((3, "block"), (4, "node"), (5, "copies"))} | {"shingles": pa.array(raw, pa.binary())}

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    # The members grow with the corpus, so the texts meet them by a shuffle at every size.
    own = docs.select(F.col("doc_id").alias("node"), "text").join(members.hint("merge"), "node")
    own = K.map_batches(own, ["text", "s1", "s2", "block", "node", "copies"], sets, f"block bigint, node {id_kind}, copies bigint, shingles binary")
    lists = partners.groupBy("block").agg(F.collect_list("other").alias("others")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = own.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(lists.hint("merge"), ["block", "salt"], "left").withColumn("many", F.col("others").isNotNull())
    own = own.withColumn("other", F.explode(F.concat(F.array("block"), F.coalesce("others", F.array().cast("array<bigint>"))))).withColumn("pair", F.col("block") != F.col("other"))
    own = own.withColumn("task", F.concat_ws(":", F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in K.groups(batches, "task"):
            found = _verify(group, similarity) if group.num_rows > 1 else None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in ("node", "root", "links", "many")], ["node", "root", "links", "many"])

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = own.select("task", "pair", "many", "block", "node", "copies", "shingles").repartition(parts, "task").sortWithinPartitions("task")
    found = written(dealt.mapInArrow(verify, f"node {id_kind}, root {id_kind}, links bigint, many boolean"), "links")
    joined = components(found.where("many").select("node", "root"))
    classes = found.where("not many").select("node", "root").union(joined)
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(classes, "node", "left")
    final = reps.select("rep", "copies", *key).join(linked, F.col("rep") == F.col("node"), "left")
    final = written(final.select(*key, "rep", "copies", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "classes")
    counted = F.col("n_shingles").isNotNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    ranked = signed.drop("bands").withColumn("counted", counted)
    alone = ranked.where("not counted").select("doc_id", "n_shingles", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return salted_join(ranked.where("counted"), final, key, "copies", ["doc_id"]).select("doc_id", "n_shingles", F.col("rep").alias("rep_id"), F.col("root").alias("class_id"), F.col("links").alias("n_links")).union(alone)


def keep_one(docs: DataFrame, n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """docs, with all their columns, with the least doc_id of each class; of rows that repeat a doc_id one stays, rows with null doc_id all do."""
    classes = near_copies(docs, n, similarity, recall)
    keep = written(classes.where("doc_id = class_id").select("doc_id"), "kept")
    repeated = keep.groupBy("doc_id").count().where("count > 1").limit(1).count()
    stay = docs.join((keep.distinct() if repeated else keep).hint("merge"), "doc_id", "left_semi")
    if repeated:
        stay = stay.dropDuplicates(["doc_id"])
    return stay.select(*docs.columns).union(docs.where("doc_id is null"))
