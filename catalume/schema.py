"""Logical tables and query parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

TABLES: dict[str, str] = {
    "source_folders": "id bigint, path string, label string, added_at bigint, last_scanned_at bigint, asset_count bigint, status string, scan_warnings string",
    "folder_search_excludes": "id bigint, source_folder_id bigint, zip_file string, excluded_path string",
    "assets": "id bigint, filename string, folder_id bigint, rel_path string, zip_file string, zip_entry string, zip_compression string, searchable_path string, asset_type string, format string, file_size bigint, fs_modified_at bigint, created_at bigint, modified_at bigint",
    "image_metadata": "asset_id bigint, width int, height int, thumbnail_data binary, processed_at bigint",
    "audio_metadata": "asset_id bigint, duration_ms bigint, sample_rate int, channels int, processed_at bigint",
    "audio_embeddings": "asset_id bigint, embedding array<float>, model_version string, created_at bigint",
    "directories": "id bigint, folder_id bigint, parent_id bigint, name string, rel_path string, zip_file string, zip_prefix string, asset_count bigint, cumulative_asset_count bigint, child_count bigint, dir_type string",
    "scan_sessions": "id bigint, source_folder_id bigint, total_files bigint, processed_files bigint, status string, started_at bigint, completed_at bigint, error string",
    "processing_errors": "id bigint, asset_id bigint, category string, error_message string, occurred_at bigint, retry_count int, resolved_at bigint",
}

#: What makes two rows the same asset; null parts are replaced, so a plain equi-join works.
ASSET_KEY = ("folder_id", "rel_path", "zip_key", "entry_key")
CATEGORIES = ("image", "audio", "clap")


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


@dataclass(frozen=True)
class FolderLocation:
    """A place in the tree: a folder (rel_path '' is all of it) or, with zip_file, an archive or a directory inside it."""

    folder_id: int
    rel_path: str = ""
    zip_file: str | None = None
    zip_prefix: str | None = None


@dataclass(frozen=True)
class SearchParams:
    """Filters of a search; what is absent adds nothing."""

    text: str = ""
    column: str = "anywhere"  # or "filename", "path"
    asset_type: str | None = None
    location: FolderLocation | None = None
    min_duration_ms: int | None = None
    max_duration_ms: int | None = None
    limit: int = 5000
    offset: int = 0
    compat: bool = False
    sort: str = "name"
    extra: dict = field(default_factory=dict)

    @property
    def is_empty(self) -> bool:
        return not self.text.strip() and self.location is None
