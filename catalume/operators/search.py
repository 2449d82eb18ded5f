"""Filtered, sorted, paged and counted asset search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.functions import paths
from catalume.functions.text import all_of, match_text
from catalume.operators import fulltext
from catalume.operators.text_index import TextIndex
from catalume.schema import FolderLocation, SearchParams


def folder_filter(location: FolderLocation) -> Column:
    """Rows in a folder (with everything below it), or in an archive (with an optional prefix inside it)."""
    inside = F.col("folder_id") == location.folder_id
    if location.zip_file is None:
        return inside & paths.is_under(F.col("rel_path"), location.rel_path)
    out = inside & (F.col("rel_path") == location.rel_path) & (F.col("zip_file") == location.zip_file) & F.col("zip_entry").isNotNull()
    return out & F.col("zip_entry").startswith(location.zip_prefix) if location.zip_prefix else out


def duration_filter(least: int | None, most: int | None) -> Column:
    """Inclusive bounds; a bound leaves out rows without a duration."""
    c = F.col("duration_ms")
    return all_of([c >= least] * (least is not None) + [c <= most] * (most is not None))


def conditions(params: SearchParams) -> list[Column]:
    """The conjuncts that need the assets alone."""
    out = []
    if params.text.strip():
        out.append(match_text(params.text, {"filename": F.col("filename"), "path": F.col("searchable_path")}, params.column, params.compat))
    if params.asset_type:
        out.append(F.col("asset_type") == params.asset_type)
    if params.location:
        out.append(folder_filter(params.location))
    return out


def with_searchable_path(assets: DataFrame, excludes: DataFrame | None = None) -> DataFrame:
    """assets with searchable_path, without the places that their folder excludes.

    excludes has source_folder_id, zip_file (null for folders) and excluded_path; one
    row for each folder with its set of places is joined.
    """
    if excludes is None:
        return assets.withColumn("searchable_path", paths.searchable_path(F.col("rel_path"), F.col("zip_file"), F.col("zip_entry")))
    place = F.concat(F.coalesce("zip_file", F.lit("")), F.lit("\0"), F.col("excluded_path"))
    sets = excludes.groupBy(F.col("source_folder_id").alias("folder_id")).agg(F.collect_set(place).alias("__excluded"))
    joined = assets.join(sets, "folder_id", "left").withColumn("__excluded", F.coalesce("__excluded", F.array().cast("array<string>")))
    return joined.withColumn("searchable_path", paths.searchable_path(F.col("rel_path"), F.col("zip_file"), F.col("zip_entry"), F.col("__excluded"))).drop("__excluded")


def matching(assets: DataFrame, audio_metadata: DataFrame | None, params: SearchParams, index: TextIndex | None = None) -> DataFrame:
    """The assets that pass all filters. The audio table is joined only for a duration bound.

    With an index of filename and searchable_path, the text's conditions are tested on the
    rows alone whose ids the postings give.
    """
    ids = index.candidates(params.text, params.column, params.compat) if index is not None and params.text.strip() else None
    if ids is not None:
        assets = assets.join(ids, "id", "left_semi")
    out = assets.where(all_of(conditions(params)))
    if params.min_duration_ms is None and params.max_duration_ms is None:
        return out
    kept = audio_metadata.where(duration_filter(params.min_duration_ms, params.max_duration_ms))
    return out.join(kept.select(F.col("asset_id").alias("id")), "id", "left_semi")


def projected(assets: DataFrame, folders: DataFrame, images: DataFrame, audio: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The canonical columns: asset, folder path, image size, audio properties; then the assets' columns in `more`."""
    return (
        assets.join(folders.select(F.col("id").alias("folder_id"), F.col("path").alias("folder_path")), "folder_id")
        .join(images.select(F.col("asset_id").alias("id"), "width", "height"), "id", "left")
        .join(audio.select(F.col("asset_id").alias("id"), "duration_ms", "sample_rate", "channels"), "id", "left")
        .select("id", "filename", "folder_id", "rel_path", "zip_file", "zip_entry", "asset_type", "format", "file_size", "folder_path", "width", "height", "duration_ms", "sample_rate", "channels", *more)
    )


#: Sort modes; every one ends with the id, so pages are stable.
SORTS = {
    "name": lambda: [F.lower("filename"), F.col("filename"), F.col("id")],
    "size": lambda: [F.col("file_size").desc_nulls_last(), F.col("id")],
    "modified": lambda: [F.col("fs_modified_at").desc_nulls_last(), F.col("id")],
    "created": lambda: [F.col("id").desc()],
    "duration": lambda: [F.col("duration_ms").asc_nulls_last(), F.col("id")],
    "relevance": lambda: [F.col("score").desc_nulls_last(), F.col("id")],
}


def page(assets: DataFrame, folders: DataFrame, images: DataFrame, audio: DataFrame, params: SearchParams, index: TextIndex | None = None) -> DataFrame:
    """One page of matches in order: filter, sort and cut first, then the metadata of the page's rows alone.

    The order by relevance is that of BM25 over filename and searchable path, the filename
    twice as heavy; without words all scores are 0.
    """
    if params.is_empty and params.extra.get("empty_is_none"):
        return projected(assets.limit(0), folders, images, audio)
    hits = matching(assets, audio, params, index).join(folders.select(F.col("id").alias("folder_id")), "folder_id", "left_semi")
    if params.sort == "duration":
        hits = hits.join(audio.select(F.col("asset_id").alias("id"), "duration_ms"), "id", "left")
    if params.sort == "relevance":
        hits = with_score(hits, assets, params.text, index)
    order = SORTS[params.sort]()
    hits = hits.orderBy(*order)
    hits = (hits.offset(params.offset) if params.offset else hits).limit(params.limit).drop("duration_ms")
    # The joins may deal the rows anew, so the page, at most `limit` rows, is put in order at the end.
    rank = tuple(c for c in ("fs_modified_at", "score") if c in hits.columns)
    return projected(hits, folders, images, audio, rank).orderBy(*order).drop(*rank)


#: Weights of the columns in the order by relevance.
RELEVANCE = {"filename": 2.0, "searchable_path": 1.0}


def with_score(hits: DataFrame, assets: DataFrame, text: str, index: TextIndex | None = None) -> DataFrame:
    """hits with score, 0 for rows that match by substrings alone."""
    scored = index.bm25(text, RELEVANCE) if index is not None else fulltext.bm25_columns(assets, text, RELEVANCE)
    return hits.join(scored, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def count(assets: DataFrame, audio: DataFrame, params: SearchParams, index: TextIndex | None = None) -> DataFrame:
    """One row n: a plan of its own, without the joins that cannot change the number."""
    return matching(assets, audio, params, index).agg(F.count("*").alias("n"))


def has_more(assets: DataFrame, audio: DataFrame, params: SearchParams) -> DataFrame:
    """One row: how many rows to show, and whether there are more, from a probe of limit + 1."""
    probe = matching(assets, audio, params).select("id").limit(params.limit + 1).agg(F.count("*").alias("n"))
    return probe.select(F.least("n", F.lit(params.limit)).cast("bigint").alias("shown"), (F.col("n") > params.limit).alias("has_more"))


def keyset_page(scored: DataFrame, limit: int, after: tuple[float, int] | None = None) -> DataFrame:
    """The next rows by (score descending, id), after the last row of the page before."""
    if after:
        score, last = after
        scored = scored.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("id") > last)))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def by_ids(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """The assets of a list of ids: a semi-join, whatever its length."""
    return assets.join(ids.select("id").distinct(), "id", "left_semi")


def facets(
    assets: DataFrame, types: list[str] | None = None, styles: list[str] | None = None, categories: list[str] | None = None, duration_category: str | None = None,
    min_width: int | None = None, min_height: int | None = None, tags: list[str] | None = None, is_spritesheet: bool | None = None,
) -> DataFrame:
    """Facet filters over the columns of their names; absent facets add nothing.

    Columns: asset_type, style_primary, sound_category, duration_category, width, height,
    auto_tags and manual_tags (JSON arrays) and is_spritesheet. Every tag has to stand, in
    any case, somewhere in one of the two texts.
    """
    tests = [F.col(c).isin(values) for c, values in (("asset_type", types), ("style_primary", styles), ("sound_category", categories)) if values]
    if duration_category is not None:
        tests.append(F.col("duration_category") == duration_category)
    tests += [F.col(c) >= least for c, least in (("width", min_width), ("height", min_height)) if least is not None]
    for tag in tags or ():
        held = lambda c, tag=tag: F.coalesce(F.contains(F.lower(c), F.lit(tag.lower())), F.lit(False))
        tests.append(held("auto_tags") | held("manual_tags"))
    if is_spritesheet is not None:
        tests.append(F.col("is_spritesheet") == is_spritesheet)
    return assets.where(all_of(tests))


def type_counts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("asset_type").agg(F.count("*").alias("n"))


def info(assets: DataFrame, folders: DataFrame) -> DataFrame:
    """One row: assets, the bytes of their files, and active folders."""
    return assets.agg(F.count("*").alias("assets"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("asset_bytes")).crossJoin(F.broadcast(folders.agg(F.count_if(F.col("status") == "active").alias("active_folders"))))
