"""The catalogue's tables as views over the driver's tables; one SQL text each, valid in Spark and in DuckDB."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from catalume.commits import file_system

_NAMED = """SELECT *,
    CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN lang WHEN 2 THEN concat(lang, '/s', CAST(doc_id % 5 AS STRING))
      ELSE concat(lang, '/s', CAST(doc_id % 5 AS STRING), '/t', CAST(doc_id % 2 AS STRING)) END AS rel_path,
    concat(CASE doc_id % 5 WHEN 0 THEN 'Metal_Hit' WHEN 1 THEN 'footstep-wood' WHEN 2 THEN 'UI click' WHEN 3 THEN 'hitman' ELSE 'forest.amb' END,
      '_', CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN '.png' ELSE '.wav' END) AS filename
  FROM {documents}"""

VIEWS: dict[str, str] = {
    "assets": f"""SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) + 1 AS folder_id, rel_path, filename,
  CASE WHEN doc_id % 3 = 0 THEN concat('pack', CAST(doc_id % 4 AS STRING), '.zip') END AS zip_file,
  CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 9 WHEN 0 THEN filename WHEN 3 THEN concat('sfx/', filename) ELSE concat('inner.zip/a/b/', filename) END END AS zip_entry,
  CASE WHEN doc_id % 2 = 0 THEN 'image' ELSE 'audio' END AS asset_type, CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'wav' END AS format,
  n_chars AS file_size, 1000000 + doc_id AS fs_modified_at
FROM ({_NAMED}) t""",
    "source_folders": """SELECT CAST(substr(source, 4) AS BIGINT) + 1 AS id, concat('/data/', source) AS path,
  CASE WHEN CAST(substr(source, 4) AS BIGINT) % 3 = 0 THEN '' ELSE upper(source) END AS label,
  CASE WHEN CAST(substr(source, 4) AS BIGINT) % 7 = 6 THEN 'missing' ELSE 'active' END AS status
FROM (SELECT DISTINCT source FROM {documents}) s""",
    "image_metadata": """SELECT l.doc_id AS asset_id, CAST(l.doc_id % 300 AS INT) AS width, CAST(l.doc_id % 200 AS INT) AS height,
  CASE WHEN l.doc_id % 4 = 0 THEN 'thumb' END AS thumbnail_data, 1000 + l.doc_id AS processed_at
FROM {labels} l WHERE l.doc_id % 2 = 0""",
    "audio_metadata": """SELECT l.doc_id AS asset_id, d.n_chars * 10 AS duration_ms, CAST(44100 AS INT) AS sample_rate, CAST(1 + l.doc_id % 2 AS INT) AS channels
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id WHERE l.doc_id % 2 = 1""",
    "processing_errors": """SELECT event_id AS id, event_id % 1000 AS asset_id, CASE event_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'clap' END AS category,
  concat('failed ', CAST(event_id % 7 AS STRING)) AS error_message, event_id AS occurred_at, CAST(event_id % 3 AS INT) AS retry_count,
  CASE WHEN event_id % 2 = 0 THEN event_id + 5 END AS resolved_at
FROM {events} WHERE event_type = 'error'""",
    "excludes": """SELECT folder_id AS source_folder_id, zip_file, excluded_path FROM (
  SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) + 1 AS folder_id FROM {documents}) f
CROSS JOIN (SELECT CAST(NULL AS STRING) AS zip_file, 'en/s1' AS excluded_path UNION ALL SELECT NULL, 'fr' UNION ALL SELECT 'pack0.zip', 'inner.zip/a' UNION ALL SELECT 'pack3.zip', 'sfx') x
WHERE folder_id % 2 = 1""",
}

#: A rescan: a seventeenth is gone, every thirteenth file has grown, and some are new.
VIEWS["listing"] = f"""SELECT id, folder_id, rel_path, filename, zip_file, zip_entry, asset_type, format,
  file_size + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS file_size, fs_modified_at FROM ({VIEWS["assets"]}) a WHERE id % 17 <> 0
UNION ALL SELECT id + 1000000, folder_id, rel_path, concat('new_', filename), zip_file, CASE WHEN zip_entry IS NOT NULL THEN concat('new/', zip_entry) END, asset_type, format,
  file_size, fs_modified_at FROM ({VIEWS["assets"]}) b WHERE id % 29 = 0"""

_TABLES = ("documents", "labels", "events", "embeddings", "part", "orders", "lineitem", "pages", "conversations", "benchmark", "customer", "nation", "region", "supplier")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the checkpoint folder that the session was given.

    Without either a cluster has no safe place, which is an error; one process on one machine,
    as in tests, gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Folders that the library's own steps have left in the shared folder, by session.
_LEFT: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; `release` deletes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _LEFT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and what reads it twice computes it once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what the library's steps have left in this session; to be called when their results are stored elsewhere."""
    for path in _LEFT.pop(spark.sparkContext.applicationId, []):
        fs, at = file_system(spark, path)
        fs.delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the parquet tables of a folder."""
    text = VIEWS[name]
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text})


def sql(*names: str) -> str:
    """The views as common table expressions for the SQL side."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in _TABLES})})" for n in names) + " "
