"""Similarity search: filter, rank, then fetch metadata for the winners alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.functions.vectors import cosine, dot
from catalume.operators.search import projected


def literal_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def top_k(embeddings: DataFrame, query: Column, k: int = 500, filters: Column | None = None, exclude_id: int | None = None, metric=dot) -> DataFrame:
    """(asset_id, similarity) of the k nearest, ties to the smaller id. The filters come before any product is taken."""
    rows = embeddings if filters is None else embeddings.where(filters)
    if exclude_id is not None:
        rows = rows.where(F.col("asset_id") != exclude_id)
    return rows.select("asset_id", metric(F.col("embedding"), query).alias("similarity")).orderBy(F.desc("similarity"), "asset_id").limit(k)


def top_k_by_item(embeddings: DataFrame, item_id: int, k: int = 500, metric=dot, filters: Column | None = None, exclude: bool = False) -> DataFrame:
    """As top_k, with the stored vector of an item as the query: one row, which meets every other. The item itself is a result, unless excluded."""
    probe = embeddings.where(F.col("asset_id") == item_id).select(F.col("embedding").alias("__query")).limit(1)
    rows = embeddings if filters is None else embeddings.where(filters)
    rows = rows.where(F.col("asset_id") != item_id) if exclude else rows
    return rows.crossJoin(F.broadcast(probe)).select("asset_id", metric(F.col("embedding"), F.col("__query")).alias("similarity")).orderBy(F.desc("similarity"), "asset_id").limit(k)


def with_metadata(ranked: DataFrame, assets: DataFrame, folders: DataFrame, images: DataFrame, audio: DataFrame) -> DataFrame:
    """The ranked ids with the columns of a search result; ids without an asset drop out, the order stays. The ranking is cut, so it is the small side."""
    own = assets.join(F.broadcast(ranked.withColumnRenamed("asset_id", "id")), "id")
    return projected(own, folders, images, audio, ("similarity",)).withColumnRenamed("id", "asset_id").orderBy(F.desc("similarity"), "asset_id")


def post_filter(ranked: DataFrame, text: str) -> DataFrame:
    """Of the ranked rows those whose filename holds the text; the cut to k came before."""
    return ranked.where(F.contains(F.lower("filename"), F.lit(text.lower())))


#: Vectors of a packed block, and results that are made at once.
BLOCK_ROWS, STRIP = 4096, 1 << 18


def packed(rows: DataFrame, name: str) -> DataFrame:
    """Rows in blocks: the one column `name` holds up to BLOCK_ROWS of them as Arrow bytes, in the order in which tasks read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(lo, BLOCK_ROWS))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], [name])

    return rows.mapInArrow(run, f"{name} binary")


def unpacked(data: pa.Scalar) -> pa.Table:
    with pa.ipc.open_stream(data.as_buffer()) as block:
        return block.read_all()


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, norms, known) of a column of arrays in double precision: shorter vectors end in zeros; a null vector or component makes a row unknown."""
    lists = column.combine_chunks()
    lists = lists.cast(pa.list_(pa.float64()))
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    known = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    if flat.null_count:
        known[np.repeat(np.arange(len(size)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    return out, np.linalg.norm(out, axis=1), known


def block_cosines(a: pa.ChunkedArray, b: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, cosines, known) of all of a's vectors and all of b's, a strip of a at a time: a matrix product in double precision, over the shorter length, as `cosine`."""
    (x, x_norm, x_known), (y, y_norm, y_known) = _matrix(a), _matrix(b)
    w = min(x.shape[1], y.shape[1])
    step = max(1, STRIP // max(1, len(y)))
    for lo in range(0, len(x), step):
        scale = x_norm[lo : lo + step, None] * y_norm
        known = (scale != 0) & x_known[lo : lo + step, None] & y_known
        with np.errstate(divide="ignore", invalid="ignore"):
            yield lo, x[lo : lo + step, :w] @ y[:, :w].T / scale, known


def similarity_matrix(items: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """(asset_id, query_id, similarity) of every item and every query by their cosine: blocks of items meet blocks of queries, which are broadcast; nothing is shuffled. With `most`, more queries are an error."""
    if most is not None:
        _at_most(queries, most)
    each = packed(items.select("asset_id", "embedding"), "items").crossJoin(F.broadcast(packed(queries.select("query_id", "embedding"), "queries")))
    names = ["asset_id", "query_id", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, asked in zip(*batch.columns):
                own, asked = unpacked(own), unpacked(asked)
                ids, others = (t.column(0).combine_chunks() for t in (own, asked))
                for lo, near, known in block_cosines(own.column(1), asked.column(1)):
                    i, j = np.divmod(np.arange(near.size), len(others))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + lo)), others.take(pa.array(j)), pa.array(near.ravel(), mask=~known.ravel())], names)

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((items, "asset_id"), (queries, "query_id"))]
    return each.mapInArrow(run, f"asset_id {kinds[0]}, query_id {kinds[1]}, similarity double")


def _at_most(rows: DataFrame, most: int) -> None:
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} vectors to hold against all rows")


def _one_array(rows: DataFrame, most: int) -> DataFrame:
    """One row that holds all (name, embedding) rows as an array; more than `most` are an error."""
    _at_most(rows, most)
    return rows.agg(F.sort_array(F.collect_list(F.struct("name", "embedding"))).alias("__all"))


def hybrid(text_scores: DataFrame, embeddings: DataFrame, k: int, reference_id: int | None = None, text_weight: float = 0.4, vector_weight: float = 0.6) -> DataFrame:
    """(id, score): the best 3k text hits, reranked by their similarity to the reference item and cut to k.

    Only text hits are results. Without a reference the text score decides; a hit without a
    vector has similarity 0. Ties go to the smaller id.
    """
    hits = text_scores.orderBy(F.desc("score"), "id").limit(3 * k).select("id", "score")
    if reference_id is not None:
        probe = embeddings.where(F.col("asset_id") == reference_id).select(F.col("embedding").alias("__query")).limit(1)
        own = embeddings.join(F.broadcast(hits.select(F.col("id").alias("asset_id"))), "asset_id", "left_semi").crossJoin(F.broadcast(probe))
        similar = own.select(F.col("asset_id").alias("id"), cosine(F.col("embedding"), F.col("__query")).alias("__v"))
        hits = hits.join(similar, "id", "left").select("id", (text_weight * F.col("score") + vector_weight * F.coalesce("__v", F.lit(0.0))).alias("score"))
    return hits.orderBy(F.desc("score"), "id").limit(k)


#: The least share of a label, by its group.
TAG_THRESHOLDS = {"style": 0.15, "content": 0.20, "quality": 0.18}


def label_shares(items: DataFrame, labels: DataFrame, most: int = 10_000) -> DataFrame:
    """(asset_id, shares): an array (p, label) of a softmax over the cosines with all labels, which are one broadcast array; nothing is shuffled."""
    held = _one_array(labels.select(F.col("label").alias("name"), "embedding"), most)
    raised = F.transform("__all", lambda s: F.struct(F.exp(F.coalesce(cosine(F.col("embedding"), s["embedding"]), F.lit(0.0))).alias("e"), s["name"].alias("label")))
    scored = items.crossJoin(F.broadcast(held)).select("asset_id", raised.alias("__e")).withColumn("__total", F.aggregate("__e", F.lit(0.0), lambda a, s: a + s["e"]))
    return scored.select("asset_id", F.transform("__e", lambda s: F.struct((s["e"] / F.col("__total")).alias("p"), s["label"].alias("label"))).alias("shares"))


def zero_shot_tags(items: DataFrame, labels: DataFrame, threshold: float = 0.15, most: int = 10) -> DataFrame:
    """(asset_id, tags): for each item its best labels (p, label) over the threshold, the best first."""
    return label_shares(items, labels).select("asset_id", F.slice(F.sort_array(F.filter("shares", lambda s: s["p"] > threshold), asc=False), 1, most).alias("tags"))


def image_tags(items: DataFrame, labels: DataFrame) -> DataFrame:
    """(asset_id, style, style_confidence, tags): the best style, and all content and quality labels, each over its group's threshold.

    labels has group (style, content or quality), label and embedding; each group has a
    softmax of its own. style is null, its confidence 0, if none is over the threshold.
    """
    out = items.select("asset_id")
    for group, least in TAG_THRESHOLDS.items():
        over = F.filter("shares", lambda s: s["p"] > least)  # noqa: B023
        out = out.join(label_shares(items, labels.where(F.col("group") == group)).select("asset_id", F.sort_array(over, asc=False).alias(group)), "asset_id", "left")
    names = lambda c: F.coalesce(F.transform(c, lambda s: s["label"]), F.array().cast("array<string>"))
    best = F.get("style", F.lit(0))
    return out.select("asset_id", best["label"].alias("style"), F.coalesce(best["p"], F.lit(0.0)).alias("style_confidence"), F.concat(names("content"), names("quality")).alias("tags"))
