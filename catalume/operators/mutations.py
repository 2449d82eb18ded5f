"""Writes as rewrites: each gives the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions import paths
from catalume.operators.diff import keyed
from catalume.schema import ASSET_KEY


def new_rows(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """INSERT OR IGNORE on the identity key: one incoming row for each key that is not stored, the least id first."""
    best = keyed(incoming).groupBy(*ASSET_KEY).agg(F.min_by(F.struct(*incoming.columns), "id").alias("row"))
    return best.join(keyed(stored).select(*ASSET_KEY), list(ASSET_KEY), "left_anti").select("row.*")


def insert_or_ignore(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return stored.unionByName(new_rows(stored, incoming).select(*stored.columns))


def upsert_folder(folders: DataFrame, incoming: DataFrame) -> DataFrame:
    """Folders by path: those not there get the next ids in the order of their paths. Folders are few."""
    fresh = incoming.dropDuplicates(["path"]).join(folders.select("path"), "path", "left_anti")
    top = folders.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    numbered = fresh.crossJoin(F.broadcast(top)).withColumn("id", F.col("__top") + F.row_number().over(Window.orderBy("path"))).drop("__top")
    return folders.unionByName(numbered, allowMissingColumns=True)


def high_water_mark(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("max_id"))


def upsert_keep_first(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """New rows overwrite old ones, but for the columns in `keep`, whose old non-null value stays."""
    a, b = old.alias("a"), new.alias("b")
    there = F.col(f"b.{key}").isNotNull()
    out = []
    for c in old.columns:
        if c == key:
            out.append(F.coalesce(f"a.{c}", f"b.{c}").alias(c))
        elif c in keep:
            out.append(F.coalesce(f"a.{c}", f"b.{c}").alias(c))
        else:
            out.append(F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*out)


def fill_missing(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Upsert of one column, only where it is null; the row's other columns stay."""
    joined = old.join(new.select(key, F.col(column).alias("__new")), key, "full_outer")
    return joined.withColumn(column, F.coalesce(column, "__new")).select(*old.columns)


def upsert_last_wins(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key; of equal times the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*old.columns), F.struct(order, "__new")).alias("row")).select("row.*")


def resolve_errors(errors: DataFrame, successes: DataFrame, now: int | Column) -> DataFrame:
    """Sets resolved_at of unresolved errors of the assets that succeeded: image and audio resolve every category, clap its own."""
    done = successes.groupBy("asset_id").agg(F.max(F.col("category").isin("image", "audio")).alias("__all"), F.max(F.col("category") == "clap").alias("__clap"))
    hit = F.col("resolved_at").isNull() & (F.coalesce("__all", F.lit(False)) | (F.coalesce("__clap", F.lit(False)) & (F.col("category") == "clap")))
    stamp = F.lit(now) if isinstance(now, int) else now
    return errors.join(done, "asset_id", "left").withColumn("resolved_at", F.when(hit, stamp).otherwise(F.col("resolved_at"))).select(*errors.columns)


def append_errors(errors: DataFrame, failures: DataFrame, now: int, buckets: int = 64) -> DataFrame:
    """Failures (asset_id, category, error_message) as new rows, not yet retried, with the next ids after the highest one.

    Rows are ranked inside buckets of their asset, after the counts of the buckets before.
    """
    own = failures.withColumn("__b", F.pmod(F.xxhash64("asset_id", "category", "error_message"), F.lit(buckets)))
    sizes = own.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("asset_id", "category", "error_message"))
    numbered = own.withColumn("__rank", rank).join(F.broadcast(before), "__b").crossJoin(F.broadcast(high_water_mark(errors))).withColumn("id", F.col("max_id") + F.col("__before") + F.col("__rank"))
    fresh = numbered.select("id", "asset_id", "category", "error_message", F.lit(now).cast("bigint").alias("occurred_at"), F.lit(0).alias("retry_count"), F.lit(None).cast("bigint").alias("resolved_at"))
    return errors.unionByName(fresh.select(*errors.columns))


def bump_retries(errors: DataFrame, category: str) -> DataFrame:
    hit = F.col("resolved_at").isNull() & (F.col("category") == category)
    return errors.withColumn("retry_count", F.when(hit, F.col("retry_count") + 1).otherwise(F.col("retry_count")).cast("int"))


def clear_errors(errors: DataFrame, category: str | None = None, only_resolved: bool = False) -> DataFrame:
    """The errors that stay."""
    gone = F.lit(True)
    if category:
        gone = gone & (F.col("category") == category)
    if only_resolved:
        gone = gone & F.col("resolved_at").isNotNull()
    return errors.where(~gone)


def error_detail(errors: DataFrame, assets: DataFrame, folders: DataFrame, category: str | None = None) -> DataFrame:
    """Unresolved errors with their asset and folder, newest first."""
    own = errors.where("resolved_at is null")
    own = own.where(F.col("category") == category) if category else own
    named = own.join(assets.select(F.col("id").alias("asset_id"), "filename", "folder_id", "rel_path"), "asset_id").join(folders.select(F.col("id").alias("folder_id"), F.col("path").alias("folder_path")), "folder_id")
    return named.select("id", "asset_id", "category", "error_message", "retry_count", "occurred_at", "filename", "rel_path", "folder_path").orderBy(F.desc("occurred_at"), F.desc("id"))


def retry_candidates(assets: DataFrame, errors: DataFrame, category: str) -> DataFrame:
    """Assets with an unresolved error of the category, each once."""
    failed = errors.where(F.col("resolved_at").isNull() & (F.col("category") == category))
    return assets.join(failed.select(F.col("asset_id").alias("id")), "id", "left_semi")


def delete_folder(tables: dict[str, DataFrame], folder_id: int) -> dict[str, DataFrame]:
    """All tables without the folder and what depends on it."""
    assets = tables["assets"]
    gone = assets.where(F.col("folder_id") == folder_id).select(F.col("id").alias("asset_id"))
    out = {}
    for name, df in tables.items():
        if name == "source_folders":
            out[name] = df.where(F.col("id") != folder_id)
        elif "asset_id" in df.columns:
            out[name] = df.join(gone, "asset_id", "left_anti")
        elif "folder_id" in df.columns:
            out[name] = df.where(F.col("folder_id") != folder_id)
        elif "source_folder_id" in df.columns:
            out[name] = df.where(~F.col("source_folder_id").eqNullSafe(F.lit(folder_id)))
        else:
            out[name] = df
    return out


def rename_folder(folders: DataFrame, folder_id: int, label: str) -> DataFrame:
    """The folders with the new label; an unknown folder is an error."""
    if not folders.where(F.col("id") == folder_id).limit(1).count():
        raise ValueError(f"no folder {folder_id}")
    return folders.withColumn("label", F.when(F.col("id") == folder_id, label).otherwise(F.col("label")))


def replace_excludes(excludes: DataFrame, folder_id: int, places: DataFrame) -> DataFrame:
    """The excludes with those of one folder replaced by the places (zip_file, excluded_path), each once."""
    fresh = places.select(F.lit(folder_id).cast("bigint").alias("source_folder_id"), "zip_file", "excluded_path").distinct()
    return excludes.where(F.col("source_folder_id") != folder_id).select("source_folder_id", "zip_file", "excluded_path").unionByName(fresh)


def toggle(chosen: Column, place: Column) -> Column:
    """The set without the place if it is in, else with it."""
    return F.when(F.array_contains(chosen, place), F.array_except(chosen, F.array(place))).otherwise(F.array_union(chosen, F.array(place)))


def folder_stats(folders: DataFrame, assets: DataFrame) -> DataFrame:
    """Folders with the number of their assets."""
    n = assets.groupBy(F.col("folder_id").alias("id")).agg(F.count("*").alias("asset_count"))
    return folders.drop("asset_count").join(n, "id", "left").withColumn("asset_count", F.coalesce("asset_count", F.lit(0)))


def latest_sessions(log: DataFrame) -> DataFrame:
    """The state of each scan from an append-only log (session_id, source_folder_id, status, total_files, at); completed_at only if complete."""
    last = log.groupBy("session_id").agg(F.max_by(F.struct("status", "source_folder_id"), "at").alias("last"), F.max("total_files").alias("total_files"), F.min("at").alias("started_at"), F.max("at").alias("__end"))
    return last.select("session_id", "last.source_folder_id", "total_files", "last.status", "started_at", F.when(F.col("last.status") == "complete", F.col("__end")).alias("completed_at"))


def compact(df: DataFrame, path: str, files: int) -> None:
    """Rewrites a table into fewer files at a new path."""
    df.coalesce(files).write.mode("errorifexists").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def id_set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def with_path_index(assets: DataFrame) -> DataFrame:
    return assets.withColumn("searchable_path", paths.searchable_path(F.col("rel_path"), F.col("zip_file"), F.col("zip_entry")))
