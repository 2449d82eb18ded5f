"""The catalogue as one object: tables in a folder, reads as DataFrames, each write one commit of all that it changes."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from catalume.commits import CommitLog, ConcurrentWrite, file_system
from catalume.operators import diff, mutations, search, tree, vector, work
from catalume.operators.text_index import TextIndex
from catalume.schema import TABLES, SearchParams, struct
from catalume.sources import archives

#: Tables whose rows belong to an asset, and with it to a folder.
DERIVED = ("image_metadata", "audio_metadata", "audio_embeddings", "processing_errors")
#: Tables stored in a part for each folder; a write touches the parts of its folders alone.
PARTED = ("assets", "directories", *DERIVED)
#: The part of rows whose asset is not in the catalogue.
NO_FOLDER = "-1"


class StalePreview(RuntimeError):
    """The folder has been written since its preview was made."""


class Change:
    """A commit in the making: tables are written beside the old ones, and `commit` makes them the catalogue's all at once."""

    def __init__(self, owner: Catalogue) -> None:
        self.owner, (self.number, self.state) = owner, owner.log.head()
        self.state = {"tables": {}, "previews": {}, "next_id": 1, "next_directory": 1, "index": None} | self.state

    def table(self, name: str, parts: list[str] | None = None) -> DataFrame:
        return self.owner._read(self.state, name, parts)

    def _new(self, name: str) -> str:
        return f"{name}/{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame, part: str = "") -> DataFrame:
        """Writes a table, or a part of it, and gives it back as it is stored."""
        at = self._new(name)
        df.select(*_shaped(name, df)).write.parquet(f"{self.owner.path}/{at}")
        self.state["tables"].setdefault(name, {})[part] = at
        return self.table(name, [part])

    def put_parts(self, name: str, df: DataFrame, parts: list[str]) -> None:
        """Writes the parts of a derived table that df's rows make up, by the folders of their assets; parts without rows go."""
        at = self._new(name)
        folder = self.table("assets").select(F.col("id").alias("asset_id"), F.col("folder_id").cast("string").alias("part"))
        placed = df.select(*_shaped(name, df)).join(folder, "asset_id", "left").withColumn("part", F.coalesce("part", F.lit(NO_FOLDER)))
        placed.select(*[f.name for f in struct(name).fields], "part").write.partitionBy("part").parquet(f"{self.owner.path}/{at}")
        fs, where = file_system(self.owner.spark, f"{self.owner.path}/{at}")
        there = {s.getPath().getName().removeprefix("part=") for s in fs.listStatus(where) if s.isDirectory()}
        own = self.state["tables"].setdefault(name, {})
        for part in set(parts) | there:
            own.pop(part, None)
        own.update({part: f"{at}/part={part}" for part in there})

    def drop(self, name: str, part: str) -> None:
        self.state["tables"].get(name, {}).pop(part, None)

    def commit(self) -> None:
        self.owner.log.commit(self.number, self.state)


def _shaped(name: str, df: DataFrame) -> list:
    return [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(name).fields]


class Catalogue:
    """Tables of `catalume.schema` under a path, and a text index of the assets.

    The last commit says which files make up each table, which segments the index has and
    which previews are stored: a reader or a failed job always sees one whole state, and of
    two writers that started from the same state the second gets ConcurrentWrite. Files of
    states before stay until `clean`.
    """

    def __init__(self, spark: SparkSession, path: str, preview_seconds: float = 1800.0, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits")
        self.text = TextIndex(spark, f"{self.path}/text", ["filename", "searchable_path"], buckets=16)
        self.preview_seconds, self.clock = preview_seconds, clock

    def _read(self, state: dict, name: str, parts: list[str] | None = None) -> DataFrame:
        own = state.get("tables", {}).get(name, {})
        at = [p for part, p in own.items() if parts is None or part in parts]
        if not at:
            return self.spark.createDataFrame([], struct(name))
        return self.spark.read.schema(struct(name)).parquet(*[f"{self.path}/{p}" for p in at])

    def table(self, name: str) -> DataFrame:
        return self._read(self.log.head()[1], name)

    @property
    def index(self) -> TextIndex:
        """The text index as the last commit has it."""
        return self.text.at(self.log.head()[1].get("index"))

    def replace(self, name: str, df: DataFrame) -> None:
        """Makes df the table, as a commit of its own."""
        change = Change(self)
        if name in DERIVED:
            change.put_parts(name, df, list(change.state["tables"].get(name, {})))
        elif name in PARTED:
            raise ValueError(f"{name} is written by the folder")
        else:
            change.put(name, df)
        change.commit()

    def folders(self) -> DataFrame:
        return self.table("source_folders").orderBy(F.lower("label"), "path")

    def add_folder(self, root: str, label: str | None = None, now: int = 0) -> int:
        """Registers the folder, lists it once, and adds what is new with the folder's tree, count, warnings and texts: one commit."""
        change = Change(self)
        incoming = self.spark.createDataFrame([(root, label or root.rstrip("/").rsplit("/", 1)[-1], now, 0, "active")], "path string, label string, added_at bigint, asset_count bigint, status string")
        folders = change.put("source_folders", mutations.upsert_folder(change.table("source_folders"), incoming))
        folder_id = folders.where(F.col("path") == root).first()["id"]
        scan = self._scanned(root, folder_id)
        self._insert(change, folder_id, change.table("assets", [str(folder_id)]), scan, now)
        change.commit()
        return folder_id

    def _scanned(self, root: str, folder_id: int) -> DataFrame:
        """One listing of a folder, stored, so that all that follows sees the same files."""
        at = f"{self.path}/scans/{uuid.uuid4().hex}"
        found = archives.scan(self.spark, root, folder_id)
        found.write.parquet(at)
        return self.spark.read.schema(found.schema).parquet(at)

    def _insert(self, change: Change, folder_id: int, stored: DataFrame, scan: DataFrame, now: int, gone: DataFrame | None = None) -> None:
        """Stages the folder's part of the assets (`stored` and what the scan has besides), and what follows from it."""
        part, state = str(folder_id), change.state
        listing = scan.where("error is null").drop("error")
        fresh = mutations.new_rows(stored, listing.withColumn("id", F.lit(0).cast("bigint")))
        numbered, n = self._numbered(fresh, state["next_id"] - 1)
        numbered = numbered.withColumn("created_at", F.lit(now)).withColumn("modified_at", F.lit(now))
        numbered = search.with_searchable_path(numbered, change.table("folder_search_excludes"))
        first = state["next_id"]
        assets = change.put("assets", stored.unionByName(numbered.select(*_shaped("assets", numbered))), part)
        state["next_id"] += n
        state["index"] = self.text.at(state["index"]).staged(assets.where(F.col("id") >= first), gone, fresh=True)
        self._tree(change, folder_id)
        count, warned = assets.count(), archives.warnings(scan).first()["scan_warnings"]
        own = F.col("id") == folder_id
        folders = change.table("source_folders")
        change.put("source_folders", folders.withColumn("asset_count", F.when(own, F.lit(count)).otherwise(F.col("asset_count"))).withColumn("scan_warnings", F.when(own, F.lit(warned)).otherwise(F.col("scan_warnings"))))

    @staticmethod
    def _numbered(rows: DataFrame, top: int) -> tuple[DataFrame, int]:
        """Ids after the highest one, in the order of the identity key, and how many: ranks inside hash buckets, and the buckets' counts before."""
        keyed = diff.keyed(rows).withColumn("__b", F.pmod(F.xxhash64("folder_id", "rel_path", "zip_key", "entry_key"), F.lit(64)))
        sizes = {r["__b"]: r["count"] for r in keyed.groupBy("__b").count().collect()}
        starts, at = [], top
        for b in range(64):
            starts.append(at)
            at += sizes.get(b, 0)
        base = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), (F.col("__b") + 1).cast("int"))
        order = Window.partitionBy("__b").orderBy("folder_id", "rel_path", "zip_key", "entry_key")
        return keyed.withColumn("id", base + F.row_number().over(order)).drop("__b", "zip_key", "entry_key"), at - top

    def _tree(self, change: Change, folder_id: int) -> None:
        """Stages one folder's directories; their ids are new ones, after all given before."""
        part, base = str(folder_id), change.state["next_directory"] - 1
        nodes = tree.with_child_counts(tree.with_ids(tree.nodes(change.table("assets", [part])))).withColumnRenamed("direct", "asset_count").withColumnRenamed("cumulative", "cumulative_asset_count")
        stored = change.put("directories", nodes.withColumn("id", F.col("id") + base).withColumn("parent_id", F.col("parent_id") + base), part)
        change.state["next_directory"] += stored.count()

    def _root(self, change: Change, folder_id: int) -> str:
        found = change.table("source_folders").where(F.col("id") == folder_id).first()
        if found is None:
            raise LookupError(f"no folder {folder_id}")
        return found["path"]

    def preview_rescan(self, folder_id: int) -> DataFrame:
        """What a rescan would change. The listing and the difference are stored with the commit they were made from, one preview for each folder."""
        change = Change(self)
        scan = self._scanned(self._root(change, folder_id), folder_id)
        stored = change.table("assets", [str(folder_id)])
        at = f"previews/{uuid.uuid4().hex}"
        diff.diff(stored, scan.where("error is null").drop("error").withColumn("id", F.lit(0).cast("bigint"))).write.parquet(f"{self.path}/{at}")
        scanned = scan.inputFiles()[0].rsplit("/", 1)[0]
        change.state["previews"][str(folder_id)] = {"diff": at, "scan": f"scans/{scanned.rsplit('/', 1)[1]}", "made": self.clock(), "assets": change.state["tables"].get("assets", {}).get(str(folder_id))}
        change.commit()
        return self.spark.read.parquet(f"{self.path}/{at}")

    def apply_rescan(self, folder_id: int, now: int = 0) -> None:
        """Applies the stored preview as it was shown: a file changed since then waits for the next rescan.

        Without a preview, or with one over half an hour old, it is an error, and with one
        made before another write to the folder StalePreview.
        """
        change = Change(self)
        found = change.state["previews"].pop(str(folder_id), None)
        if found is None:
            raise LookupError(f"no pending rescan preview for folder {folder_id}")
        if self.clock() - found["made"] > self.preview_seconds:
            change.commit()
            raise TimeoutError(f"the rescan preview is older than {self.preview_seconds / 60:g} minutes; preview again")
        if change.state["tables"].get("assets", {}).get(str(folder_id)) != found["assets"]:
            raise StalePreview(f"folder {folder_id} has changed since its preview; preview again")
        self._apply(change, folder_id, self.spark.read.parquet(f"{self.path}/{found['scan']}"), self.spark.read.parquet(f"{self.path}/{found['diff']}"), now)
        change.commit()

    def rescan(self, folder_id: int, now: int = 0) -> None:
        """Previews and applies."""
        self.preview_rescan(folder_id)
        self.apply_rescan(folder_id, now)

    def _apply(self, change: Change, folder_id: int, scan: DataFrame, found: DataFrame, now: int) -> None:
        """Stages a rescan of one folder: its parts of the assets and of what is derived from them, and nothing else."""
        part = str(folder_id)
        own = change.table("assets", [part])
        kept = found.where("status in ('modified', 'unchanged')").select(F.col("stored_id").alias("id"), "listed_size", "listed_at")
        after = own.join(kept, "id").withColumn("file_size", F.col("listed_size")).withColumn("fs_modified_at", F.col("listed_at")).select(*own.columns)
        for name in DERIVED:
            if part in change.state["tables"].get(name, {}):
                change.put(name, diff.purge(change.table(name, [part]), found), part)
        self._insert(change, folder_id, after, scan, now, found.where("status = 'removed'").select("stored_id"))

    def remove_folder(self, folder_id: int) -> None:
        """Drops the folder's parts, its row, excludes and sessions, and its texts."""
        change, part = Change(self), str(folder_id)
        ids = change.table("assets", [part]).select("id")
        change.state["index"] = self.text.at(change.state["index"]).staged(change.table("assets", []), ids)
        for name in PARTED:
            change.drop(name, part)
        rest = mutations.delete_folder({name: change.table(name) for name in ("assets", "source_folders", "folder_search_excludes", "scan_sessions")}, folder_id)
        for name in ("source_folders", "folder_search_excludes", "scan_sessions"):
            change.put(name, rest[name])
        change.state["previews"].pop(part, None)
        change.commit()

    def rename_folder(self, folder_id: int, label: str) -> None:
        change = Change(self)
        change.put("source_folders", mutations.rename_folder(change.table("source_folders"), folder_id, label))
        change.commit()

    def set_excludes(self, folder_id: int, places: DataFrame) -> None:
        """Replaces a folder's excludes; the index gets the texts that this changes."""
        change, part = Change(self), str(folder_id)
        excludes = change.put("folder_search_excludes", mutations.replace_excludes(change.table("folder_search_excludes"), folder_id, places))
        before = change.table("assets", [part])
        after = change.put("assets", search.with_searchable_path(before.drop("searchable_path"), excludes), part)
        changed = after.join(before.select("id", F.col("searchable_path").alias("__old")), "id").where("not (searchable_path <=> __old)").drop("__old")
        change.state["index"] = self.text.at(change.state["index"]).staged(changed)
        change.commit()

    def search(self, params: SearchParams) -> DataFrame:
        state = self.log.head()[1]
        read = lambda name: self._read(state, name)
        return search.page(read("assets"), read("source_folders"), read("image_metadata"), read("audio_metadata"), params, self.text.at(state.get("index")))

    def count(self, params: SearchParams) -> int:
        state = self.log.head()[1]
        return search.count(self._read(state, "assets"), self._read(state, "audio_metadata"), params, self.text.at(state.get("index"))).first()["n"]

    def type_counts(self) -> DataFrame:
        return search.type_counts(self.table("assets"))

    def roots(self) -> DataFrame:
        return tree.roots(self.table("source_folders"), tree.nodes(self.table("assets")), self.table("assets"))

    def pending_counts(self) -> DataFrame:
        return work.pending_counts(self.table("assets"), self.table("image_metadata"), self.table("audio_metadata"), self.table("audio_embeddings"))

    def similar(self, asset_id: int, k: int = 500) -> DataFrame:
        return vector.with_metadata(vector.top_k_by_item(self.table("audio_embeddings"), asset_id, k), self.table("assets"), self.table("source_folders"), self.table("image_metadata"), self.table("audio_metadata"))

    def errors(self, category: str | None = None) -> DataFrame:
        return mutations.error_detail(self.table("processing_errors"), self.table("assets"), self.table("source_folders"), category)

    def clear_errors(self, category: str | None = None, only_resolved: bool = False) -> int:
        before = self.table("processing_errors")
        after = mutations.clear_errors(before, category, only_resolved)
        gone = before.count() - after.count()
        self.replace("processing_errors", after)
        return gone

    def record(self, name: str, rows: DataFrame, now: int = 0) -> None:
        """Adds results of processing: metadata keeps an existing thumbnail, others are replaced; successes resolve errors.

        Only the parts of the rows' folders are rewritten.
        """
        change = Change(self)
        columns = [f.name for f in struct(name).fields]
        rows = rows.select(*_shaped(name, rows))
        folder = change.table("assets").select(F.col("id").alias("asset_id"), F.col("folder_id").cast("string").alias("part"))
        touched = [r["part"] or NO_FOLDER for r in rows.join(folder, "asset_id", "left").select("part").distinct().collect()]
        old = change.table(name, touched)
        if name == "image_metadata":
            after = mutations.upsert_keep_first(old, rows, "asset_id", ["thumbnail_data"])
        else:
            after = mutations.upsert_last_wins(old, rows, "asset_id", "created_at" if name == "audio_embeddings" else "processed_at")
        change.put_parts(name, after.select(*columns), touched)
        category = {"image_metadata": "image", "audio_metadata": "audio", "audio_embeddings": "clap"}[name]
        done = rows.select("asset_id", F.lit(category).alias("category"))
        if set(touched) & set(change.state["tables"].get("processing_errors", {})):
            change.put_parts("processing_errors", mutations.resolve_errors(change.table("processing_errors", touched), done, now), touched)
        change.commit()

    def clean(self, keep: int = 2) -> None:
        """Deletes what only states before the last `keep` name; for times when no older reader is about."""

        def named(state: dict) -> set[str]:
            tables = {at.split("/part=")[0] for parts in state.get("tables", {}).values() for at in parts.values()}
            stored = {p[k] for p in state.get("previews", {}).values() for k in ("diff", "scan")}
            return tables | stored | {f"text/{t}/seg={s}" for s in (state.get("index") or {}).get("segments", []) for t in ("postings", "grams", "docs", "gone")}

        gone = [named(state) for state in self.log.expire(keep)]
        stay = set().union(*[named(self.log.read(n)) for n in self.log.numbers()])
        for at in set().union(*gone) - stay:
            fs, where = file_system(self.spark, f"{self.path}/{at}")
            fs.delete(where, True)

    def info(self) -> DataFrame:
        """One row: assets, active folders, and the bytes and files that the tables have now."""
        size = files = 0
        state = self.log.head()[1]
        for parts in state.get("tables", {}).values():
            for at in parts.values():
                fs, where = file_system(self.spark, f"{self.path}/{at}")
                summary = fs.getContentSummary(where)
                size, files = size + summary.getLength(), files + summary.getFileCount()
        return search.info(self.table("assets"), self.table("source_folders")).withColumn("bytes", F.lit(size).cast("bigint")).withColumn("files", F.lit(files).cast("bigint"))


__all__ = ["Catalogue", "Change", "ConcurrentWrite", "StalePreview"]
