"""Paths: searchable paths, composition, archive boundaries, tree keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    """The non-empty segments of a slash path; null has none."""
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")


def prefixes(parts: Column) -> Column:
    """'a', 'a/b', 'a/b/c' for the segments a, b, c."""
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))


def entry_directories(zip_entry: Column) -> Column:
    """The directory segments of an archive entry."""
    parts = segments(zip_entry)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def searchable_path(rel_path: Column, zip_file: Column, zip_entry: Column, excludes: Column | None = None) -> Column:
    """Folder segments, then the directories inside the archive, joined by spaces, without the excluded places.

    `excludes` is an array of `zip_file || char(0) || path`, with an empty zip_file for
    folders. A segment is left out if the path that ends with it is excluded.
    """

    def kept(parts: Column, archive: Column) -> Column:
        if excludes is None:
            return parts
        return F.filter(parts, lambda _, i: ~F.array_contains(excludes, F.concat(archive, F.lit("\0"), F.array_join(F.slice(parts, 1, i + 1), "/"))))

    inside = F.when(zip_file.isNotNull(), entry_directories(zip_entry)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(kept(segments(rel_path), F.lit("")), kept(inside, F.coalesce(zip_file, F.lit("")))), " ")


def relative_path(parent: Column, root: Column) -> Column:
    """The parent folder below the root, with forward slashes and none at either end."""
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/+$", "")
    return F.regexp_replace(F.substring(tidy(parent), F.length(tidy(root)) + 1, 1_000_000), "^/+|/+$", "")


def _joined(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def filesystem_path(root: Column, rel_path: Column, name: Column) -> Column:
    """Where the file (or the archive that holds it) is on disk."""
    return _joined("/", root, rel_path, name)


def display_path(root: Column, rel_path: Column, filename: Column, zip_file: Column, zip_entry: Column) -> Column:
    """The folder path, then for archive members the archive and the entry."""
    return F.when(zip_file.isNotNull(), _joined("/", root, rel_path, zip_file, zip_entry)).otherwise(_joined("/", root, rel_path, filename))


def first_archive_boundary(entry: Column) -> Column:
    """The position of the slash after the first `.zip`, counted from 0; null if the entry is not nested."""
    at = F.instr(F.lower(entry), F.lit(".zip/"))
    return F.when(at > 0, at + 3)


def last_archive(entry: Column) -> Column:
    """The deepest archive's path inside the entry, null if there is none."""
    return F.nullif(F.regexp_extract(entry, r"(?i)^(.*\.zip)/", 1), F.lit(""))


def nested_key(zip_path: Column, entry: Column) -> Column:
    """outer::deepest nested archive, null for entries that are not nested."""
    inner = last_archive(entry)
    return F.when(inner.isNotNull(), F.concat(zip_path, F.lit("::"), inner))


def node_key(folder_id: Column, rel_path: Column, zip_file: Column, zip_prefix: Column) -> Column:
    """folder:<id>:<path>, zip:<id>:<path>:<archive>, or zip:<id>:<path>:<archive>:<prefix> for a directory inside an archive."""
    return F.when(zip_file.isNull(), F.concat_ws(":", F.lit("folder"), folder_id, rel_path)).otherwise(
        F.concat_ws(":", F.lit("zip"), folder_id, rel_path, zip_file, zip_prefix))


def root_name(label: Column, path: Column) -> Column:
    """The label, else the path's last segment, else the path."""
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), path)


def zip_key(zip_file: Column) -> Column:
    return F.coalesce(zip_file, F.lit(""))


def entry_key(zip_entry: Column, filename: Column) -> Column:
    return F.coalesce(zip_entry, filename)


def is_under(path: Column, prefix: str) -> Column:
    """The path is the prefix or below it; '' holds everything. Case counts, and % or _ mean themselves."""
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")
