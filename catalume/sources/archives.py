"""Folder and archive listings, and bulk reads of files and archive entries.

Spark lists the files; their contents are opened where they lie, so that listing an archive
reads its directory at the end and not its entries. An archive is opened once for all its
rows; nested archives are opened inside it. What fails is a row with its error, and its
neighbours go on.
"""

from __future__ import annotations

import io
import zipfile
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from functools import partial
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.functions import paths
from catalume.functions.scalars import asset_type, compression_name, warnings_json

ENTRY_SCHEMA = "zip_path string, zip_entry string, file_size bigint, method int, error string"


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, filename, extension, file_size, fs_modified_at) of all files below root, hidden ones left out. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "length", "modificationTime")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:(//)?", "")
    rel = paths.relative_path(F.regexp_replace("path", "/[^/]*$", ""), base)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = found.select("path", rel.alias("rel_path"), name.alias("filename"), extension.alias("extension"), F.col("length").alias("file_size"), F.unix_timestamp("modificationTime").alias("fs_modified_at"))
    return out.where(~F.col("filename").startswith(".") & ~F.col("rel_path").rlike(r"(^|/)\."))


def places(spark: SparkSession, root: str) -> DataFrame:
    """(filename, extension, rel_path, file_size) of what lies directly below root: its files, and each folder in it as one place with the bytes of all files below it."""
    found = files(spark, root)
    top = F.when(F.col("rel_path") == "", F.col("filename")).otherwise(F.substring_index("rel_path", "/", 1))
    each = found.groupBy(top.alias("filename")).agg(F.sum("file_size").alias("file_size"))
    return each.select("filename", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).alias("extension"), F.lit("").alias("rel_path"), "file_size")


def folder_bytes(spark: SparkSession, root: str) -> DataFrame:
    """One row: the files below root and their bytes."""
    return files(spark, root).agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def _located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path.removeprefix("file:"))


def opened(path: str) -> BinaryIO:
    """A file that can seek, on any file system that Arrow knows by the path's scheme."""
    fs, at = _located(path)
    return fs.open_input_file(at)


def list_entries(data: bytes | BinaryIO, prefix: str = "") -> Iterator[tuple[str, int | None, int | None, str | None]]:
    """(entry path, size, method, error) of an archive's files; archives inside it are listed in place of themselves.

    An inner archive that cannot be read is one row with its error.
    """
    with zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data) as archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            name = prefix + info.filename
            if info.filename.lower().endswith(".zip"):
                try:
                    inner = list(list_entries(_inner(archive, info.filename), name + "/"))
                except Exception as e:  # whatever a broken archive raises is this entry's
                    inner = [(name, None, None, str(e) or type(e).__name__)]
                yield from inner
            else:
                yield name, info.file_size, info.compress_type, None


def _entry_rows(path: str, data: bytes | None) -> list[tuple]:
    try:
        return [(path, *row) for row in list_entries(opened(path) if data is None else data)]
    except Exception as e:  # whatever a broken archive raises is this archive's
        return [(path, None, None, None, str(e) or type(e).__name__)]


def entries(archives: DataFrame) -> DataFrame:
    """ENTRY_SCHEMA rows of archives given by path, or as (path, content); a broken archive, outer or inner, is one row with its error."""
    held = "content" in archives.columns

    schema = pa.schema([("zip_path", pa.string()), ("zip_entry", pa.string()), ("file_size", pa.int64()), ("method", pa.int32()), ("error", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # one archive at a time leaves Arrow's memory
                content = (batch.column(1)[row].as_py() or b"") if held else None
                rows = _entry_rows(batch.column(0)[row].as_py(), content)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return archives.select("path", *["content"] * held).mapInArrow(scan, ENTRY_SCHEMA)


def archive_paths(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all archives below root, dealt over tasks."""
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files(spark, root).where("extension = 'zip'").select("path").repartition(parts, "path")


def read_files(wanted: DataFrame) -> DataFrame:
    """(path, data, error) of whole files given by path: plain files as they are."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with opened(path) as f:
                        row = {"data": [f.read()], "error": [None]}
                except Exception as e:  # the row's own failure
                    row = {"data": [None], "error": [f"Failed to read file {path}: {e}"]}
                yield pd.DataFrame({"path": [path]} | row)

    return wanted.select("path").mapInPandas(load, "path string, data binary, error string")


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[zZ][iI][pP]").load(root).select("path", "content")


def _in_archives(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all archives below root, with the archive's rel_path, zip_file and time."""
    archives = files(spark, root).where("extension = 'zip'").select("path", "rel_path", F.col("filename").alias("zip_file"), "fs_modified_at")
    return entries(archive_paths(spark, root)).withColumnRenamed("zip_path", "path").join(archives, "path")


def scan(spark: SparkSession, root: str, folder_id: int) -> DataFrame:
    """All that one pass over root finds: the rows of `listing` with error, and a row for each broken archive, whose place is in zip_file and zip_entry.

    Files of other types than the assets' are dropped. Ids are left to the writer.
    """
    none = F.lit(None).cast("string")
    plain = files(spark, root).withColumn("asset_type", asset_type(F.col("extension"))).where("asset_type is not null")
    plain = plain.select(F.lit(folder_id).cast("bigint").alias("folder_id"), "rel_path", "filename", none.alias("zip_file"), none.alias("zip_entry"), none.alias("zip_compression"), "asset_type", F.col("extension").alias("format"), "file_size", "fs_modified_at", none.alias("error"))
    name = F.element_at(F.split("zip_entry", "/"), -1)
    inner = _in_archives(spark, root).withColumn("extension", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))).withColumn("asset_type", asset_type(F.col("extension"))).where("asset_type is not null or error is not null")
    inside = inner.select(F.lit(folder_id).cast("bigint").alias("folder_id"), "rel_path", name.alias("filename"), "zip_file", "zip_entry", compression_name(F.col("method")).alias("zip_compression"), "asset_type", F.col("extension").alias("format"), "file_size", "fs_modified_at", "error")
    return plain.unionByName(inside)


def listing(spark: SparkSession, root: str, folder_id: int) -> DataFrame:
    """The assets below root, in folders and in (nested) archives."""
    return scan(spark, root, folder_id).where("error is null").drop("error")


def warnings(found: DataFrame) -> DataFrame:
    """One row: the warnings of a scan as a JSON array (null if there are none), `place: error` for each broken archive, in order."""
    place = F.concat_ws("/", F.nullif("rel_path", F.lit("")), "zip_file", "zip_entry")
    broken = found.where("error is not null").select(F.concat(place, F.lit(": "), "error").alias("w"))
    return broken.agg(F.sort_array(F.collect_list("w")).alias("w")).select(warnings_json(F.col("w")).alias("scan_warnings"))


def scan_warnings(spark: SparkSession, root: str) -> DataFrame:
    return warnings(scan(spark, root, 0))


#: Bytes of nested archives that a worker keeps, and of one nested archive at most.
CACHE_BYTES, MOST_INNER = 256 << 20, 1 << 30


class ArchiveCache:
    """Opened nested archives by key, the least recently used ones dropped when their bytes are over the budget.

    An archive is pinned while it is read from; pinned ones stay even over the budget, so one
    that is larger than the budget is held for as long as it is in use and no longer.
    """

    def __init__(self, budget: int = CACHE_BYTES) -> None:
        self.budget, self.bytes, self.opened = budget, 0, 0
        self.held: OrderedDict[str, tuple[zipfile.ZipFile, int]] = OrderedDict()
        self.pins: Counter[str] = Counter()

    @contextmanager
    def open(self, key: str, load: Callable[[], bytes]) -> Iterator[zipfile.ZipFile]:
        if key not in self.held:
            data = load()
            self.held[key] = (zipfile.ZipFile(io.BytesIO(data)), len(data))
            self.bytes += len(data)
            self.opened += 1
        self.held.move_to_end(key)
        self.pins[key] += 1
        self._drop()
        try:
            yield self.held[key][0]
        finally:
            self.pins[key] -= 1
            self._drop()

    def _drop(self) -> None:
        for key in [k for k in self.held if not self.pins[k]]:
            if self.bytes <= self.budget:
                return
            archive, size = self.held.pop(key)
            archive.close()
            self.bytes -= size


_CACHE = ArchiveCache()


def worker_cache() -> ArchiveCache:
    """What a worker keeps from one batch to the next; a function, so that tasks take their own process's and no copy."""
    return _CACHE


def _inner(archive: zipfile.ZipFile, entry: str, most: int = MOST_INNER) -> bytes:
    """A nested archive's bytes; one that is larger than `most`, whatever its directory says, is an error."""
    with archive.open(entry) as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"nested archive of more than {most} bytes")
    return data


def _read(archive: zipfile.ZipFile, entry: str, cache: ArchiveCache, name: str) -> bytes:
    """The bytes of an entry; the nested archives on the way come from the cache, under the outer one's name and their own path."""
    low, at = entry.lower(), 0
    with ExitStack() as pinned:
        while (end := low.find(".zip/", at)) >= 0:
            load = partial(_inner, archive, entry[at : end + 4])
            archive, at = pinned.enter_context(cache.open(f"{name}::{entry[: end + 4]}", load)), end + 5
        return archive.read(entry[at:])


def _version(path: str) -> str:
    """A file's path with its size and time, so that a changed archive is another one."""
    fs, at = _located(path)
    info = fs.get_file_info(at)
    return f"{path}@{info.size}@{info.mtime_ns}"


def read_entries(contents: DataFrame | None, wanted: DataFrame) -> DataFrame:
    """(zip_path, zip_entry, data, error) of the wanted (zip_path, zip_entry) rows; what fails is an error in its row.

    An archive's wanted entries are gathered beside it, so it is opened once: where it lies,
    or, with contents (path, content), from there. Nested archives of those that lie in files
    stay open from batch to batch, see `ArchiveCache`.
    """
    lists = wanted.groupBy("zip_path").agg(F.collect_set("zip_entry").alias("entries"))
    held = contents is not None
    joined = contents.select(F.col("path").alias("zip_path"), "content").join(lists, "zip_path") if held else lists.withColumn("content", F.lit(None).cast("binary"))

    schema = pa.schema([("zip_path", pa.string()), ("zip_entry", pa.string()), ("data", pa.binary()), ("error", pa.string())])

    def one(path: str, name: str, data: bytes | None, error: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path, name, data, error), schema)], schema=schema)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, names, content in zip(batch.column("zip_path"), batch.column("entries"), batch.column("content")):
                path, names = path.as_py(), names.as_py()
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py() or b"") if held else opened(path))
                except Exception as e:  # a broken archive fails for each of its wanted entries
                    yield from (one(path, name, None, str(e)) for name in names)
                    continue
                cache, own = (ArchiveCache(), "held") if held else (worker_cache(), _version(path))
                with archive:
                    for name in sorted(names):
                        try:
                            data, error = _read(archive, name, cache, own), None
                        except Exception as e:  # the entry's own failure
                            data, error = None, str(e)
                        yield one(path, name, data, error)

    return joined.select("zip_path", "entries", "content").mapInArrow(load, "zip_path string, zip_entry string, data binary, error string")
