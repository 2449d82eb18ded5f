"""The folder and archive tree: direct and cumulative counts on every node, without recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from catalume.functions import paths

#: Buckets in which nodes are numbered.
BUCKETS = 4096


def nodes(assets: DataFrame) -> DataFrame:
    """(folder_id, dir_type, rel_path, zip_file, zip_prefix, name, parent_path, direct, cumulative, compat_cumulative).

    Each asset adds to all its ancestors: the prefixes of rel_path (dir), its archive (zip)
    and the directories inside (zipdir). compat_cumulative counts entries in a
    subdirectory of an archive twice on the archive and above.
    """
    weight = F.when(F.col("zip_file").isNotNull() & F.contains(F.col("zip_entry"), F.lit("/")), 2).otherwise(1)
    rows = assets.select("folder_id", "rel_path", "zip_file", "zip_entry", weight.alias("w"))
    empty = F.lit(None).cast("string")
    dirs = rows.withColumn("node", F.explode(paths.prefixes(paths.segments(F.col("rel_path"))))).groupBy("folder_id", "node").agg(
        F.count_if(F.col("zip_file").isNull() & (F.col("node") == F.col("rel_path"))).alias("direct"), F.count("*").alias("cumulative"), F.sum("w").alias("compat_cumulative"))
    dirs = dirs.select("folder_id", F.lit("dir").alias("dir_type"), F.col("node").alias("rel_path"), empty.alias("zip_file"), empty.alias("zip_prefix"), "direct", "cumulative", "compat_cumulative")
    zips = rows.where("zip_file is not null").groupBy("folder_id", "rel_path", "zip_file").agg(F.count("*").alias("direct"), F.sum("w").alias("compat_cumulative"))
    zips = zips.select("folder_id", F.lit("zip").alias("dir_type"), "rel_path", "zip_file", empty.alias("zip_prefix"), "direct", F.col("direct").alias("cumulative"), "compat_cumulative")
    inner = paths.entry_directories(F.col("zip_entry"))
    own = F.concat(F.array_join(inner, "/"), F.lit("/"))
    deep = rows.where("zip_file is not null").withColumn("own", own).withColumn("node", F.explode(paths.prefixes(inner))).withColumn("node", F.concat("node", F.lit("/")))
    deep = deep.groupBy("folder_id", "rel_path", "zip_file", "node").agg(F.count_if(F.col("node") == F.col("own")).alias("direct"), F.count("*").alias("cumulative"))
    deep = deep.select("folder_id", F.lit("zipdir").alias("dir_type"), "rel_path", "zip_file", F.col("node").alias("zip_prefix"), "direct", "cumulative", F.col("cumulative").alias("compat_cumulative"))
    last = lambda c: F.element_at(F.split(F.regexp_replace(c, "/$", ""), "/"), -1)
    up = lambda c, tail: F.regexp_replace(c, tail, "")
    named = dirs.unionByName(zips).unionByName(deep)
    kind = F.col("dir_type")
    return named.withColumn("name", F.when(kind == "dir", last(F.col("rel_path"))).when(kind == "zip", F.col("zip_file")).otherwise(last(F.col("zip_prefix")))).withColumn(
        "parent_path", F.when(kind == "dir", F.when(F.contains(F.col("rel_path"), F.lit("/")), up(F.col("rel_path"), "/[^/]*$")).otherwise("")).when(kind == "zip", F.col("rel_path")).otherwise(up(F.col("zip_prefix"), "[^/]+/$")))


def _key(folder, kind, rel_path, zip_file, prefix):
    return F.concat_ws("\0", folder.cast("string"), kind, rel_path, F.coalesce(zip_file, F.lit("")), F.coalesce(prefix, F.lit("")))


def keyed(tree: DataFrame) -> DataFrame:
    """The nodes with their own key and their parent's; nodes at the root have a key of the folder alone."""
    kind, rel, zip_file, prefix, parent = (F.col(c) for c in ("dir_type", "rel_path", "zip_file", "zip_prefix", "parent_path"))
    none = F.lit("")
    key = _key(F.col("folder_id"), kind, rel, zip_file, prefix)
    above = (
        F.when(kind.isin("dir", "zip"), F.when(parent == "", _key(F.col("folder_id"), F.lit("root"), none, none, none)).otherwise(_key(F.col("folder_id"), F.lit("dir"), parent, none, none)))
        .otherwise(F.when(parent == "", _key(F.col("folder_id"), F.lit("zip"), rel, zip_file, none)).otherwise(_key(F.col("folder_id"), F.lit("zipdir"), rel, zip_file, parent)))
    )
    return tree.withColumn("key", key).withColumn("parent_key", above)


def with_child_counts(tree: DataFrame) -> DataFrame:
    own = keyed(tree)
    children = own.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("child_count"))
    return own.join(children, "key", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))


def with_ids(tree: DataFrame) -> DataFrame:
    """Nodes with id (1, 2, ... without gaps) and parent_id, which is null at the root.

    Nodes are ranked inside hash buckets of their keys, after the counts of the buckets
    before, so neither a large folder nor the whole tree is one task.
    """
    own = keyed(tree).withColumn("__b", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    before = own.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("key"))
    own = own.withColumn("__rank", rank).join(F.broadcast(before), "__b").withColumn("id", F.col("__before") + F.col("__rank")).drop("__b", "__rank", "__before")
    return own.join(own.select(F.col("key").alias("parent_key"), F.col("id").alias("parent_id")), "parent_key", "left")


def children(tree: DataFrame, folder_id: int, kind: str = "root", rel_path: str = "", zip_file: str = "", prefix: str = "") -> DataFrame:
    """The children of a node, folders before archives before their directories, by name."""
    key = "\0".join([str(folder_id), kind, rel_path, zip_file, prefix])
    return with_child_counts(tree).where(F.col("parent_key") == key).orderBy("dir_type", F.lower("name"), "name")


def roots(folders: DataFrame, tree: DataFrame, assets: DataFrame) -> DataFrame:
    """The active folders with their name, number of assets and number of children, by name."""
    own = keyed(tree)
    at_root = own.where(F.col("parent_key") == _key(F.col("folder_id"), F.lit("root"), F.lit(""), F.lit(""), F.lit(""))).groupBy("folder_id").agg(F.count("*").alias("child_count"))
    count = assets.groupBy("folder_id").agg(F.count("*").alias("asset_count"))
    active = folders.where("status = 'active'").select("id", "label", "path")
    out = active.join(count.withColumnRenamed("folder_id", "id"), "id", "left").join(at_root.withColumnRenamed("folder_id", "id"), "id", "left")
    zero = F.lit(0)
    return out.select("id", paths.root_name(F.col("label"), F.col("path")).alias("name"), F.coalesce("asset_count", zero).alias("asset_count"), F.coalesce("child_count", zero).alias("child_count")).orderBy(F.lower("name"), "name", "id")


def path_counts(assets: DataFrame) -> DataFrame:
    """Files in folders by path, archives left out."""
    return assets.where("zip_file is null").groupBy("folder_id", "rel_path").agg(F.count("*").alias("n"))


def archive_counts(assets: DataFrame) -> DataFrame:
    return assets.where("zip_file is not null").groupBy("folder_id", "rel_path", "zip_file").agg(F.count("*").alias("n"))


def archive_directories(tree: DataFrame) -> DataFrame:
    """For each archive the sorted list of the directories inside it, without the trailing slash."""
    return tree.where("dir_type = 'zipdir'").groupBy("folder_id", "rel_path", "zip_file").agg(F.sort_array(F.collect_list(F.regexp_replace("zip_prefix", "/$", ""))).alias("dirs"))


def sorted_nodes(tree: DataFrame) -> DataFrame:
    """Nodes as a settings panel lists them: by parent, archives after folders, names in any case."""
    return keyed(tree).orderBy("parent_key", F.col("dir_type") == "zip", F.lower("name"), "name")
