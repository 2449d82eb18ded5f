"""Rescans: a full-outer diff on the identity key, and its application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.functions import paths
from catalume.schema import ASSET_KEY


def keyed(assets: DataFrame) -> DataFrame:
    """assets with the two key columns whose nulls are replaced."""
    return assets.withColumn("zip_key", paths.zip_key(F.col("zip_file"))).withColumn("entry_key", paths.entry_key(F.col("zip_entry"), F.col("filename")))


def diff(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """The key, stored_id, listed_id, sizes, times and status: added, removed, modified or unchanged.

    Modified: another size, or the stored time is null, or another time. A listing that
    holds a key twice counts once.
    """
    a = keyed(stored).select(*ASSET_KEY, F.col("id").alias("stored_id"), F.col("file_size").alias("stored_size"), F.col("fs_modified_at").alias("stored_at"))
    b = keyed(listing).dropDuplicates(list(ASSET_KEY)).select(*ASSET_KEY, F.col("id").alias("listed_id"), F.col("file_size").alias("listed_size"), F.col("fs_modified_at").alias("listed_at"))
    changed = (F.col("stored_size") != F.col("listed_size")) | F.col("stored_at").isNull() | ~F.col("stored_at").eqNullSafe(F.col("listed_at"))
    status = F.when(F.col("stored_id").isNull(), "added").when(F.col("listed_id").isNull(), "removed").when(changed, "modified").otherwise("unchanged")
    return a.join(b, list(ASSET_KEY), "full_outer").withColumn("status", status)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count("*").alias("n"))


def apply(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """The assets after a rescan: removed rows gone, modified ones with the listing's size and time, added ones appended."""
    found = diff(stored, listing)
    kept = found.where("stored_id is not null and listed_id is not null").select(F.col("stored_id").alias("id"), "listed_size", "listed_at")
    columns = stored.columns
    updated = stored.join(kept, "id").withColumn("file_size", F.col("listed_size")).withColumn("fs_modified_at", F.col("listed_at")).select(*columns)
    added = keyed(listing).dropDuplicates(list(ASSET_KEY)).join(keyed(stored).select(*ASSET_KEY), list(ASSET_KEY), "left_anti").select(*columns)
    return updated.unionByName(added)


def purge(derived: DataFrame, found: DataFrame, id_column: str = "asset_id") -> DataFrame:
    """A derived table without the rows of removed or modified assets."""
    stale = found.where(F.col("status").isin("removed", "modified")).select(F.col("stored_id").alias(id_column))
    return derived.join(stale, id_column, "left_anti")
