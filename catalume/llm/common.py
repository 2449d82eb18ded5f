"""What the operators share on the Spark side: tables, and the shared folder for written results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.adapters import shared_folder

__all__ = ["documents", "left", "release", "salted_join", "shared_path", "table", "written"]

#: Rows of one key from which a salted join deals the key over several tasks.
SALT_ROWS = 512
#: Slots of the table that tells both sides which keys are hot: the bound on what is broadcast.
SALT_SLOTS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; `release` deletes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _LEFT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Folders that operators have written, by session, oldest first.
_LEFT: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Deletes a table that `written` gave; for steps of a loop that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def left(spark: SparkSession) -> int:
    """How many folders operators have written in this session."""
    return len(_LEFT.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> None:
    """Deletes what operators have written in this session (since so many folders), but for the folders that `keep` reads.

    To be called when a result has been stored: DataFrames that operators gave read these
    folders until then.
    """
    kept = [f.rsplit("/", 1)[0] for f in keep.inputFiles()] if keep is not None else []
    mine = _LEFT.get(spark.sparkContext.applicationId, [])
    stay = mine[:since] + [p for p in mine[since:] if any(k.endswith(p.rsplit("/", 1)[1]) for k in kept)]
    for path in mine[since:]:
        if path not in stay:
            _delete(spark, path)
    _LEFT[spark.sparkContext.applicationId] = stay


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, spread: list[str], how: str = "inner") -> DataFrame:
    """left joined with the one row that right has for each key, where right's column `n` says how many rows of left have the key.

    A key of over SALT_ROWS rows is dealt by a hash of the `spread` columns over n / SALT_ROWS
    tasks, and right's row is sent to each. Which keys are hot stands in a table of
    SALT_SLOTS slots by the keys' hash, the largest n in each: that bounds the broadcast, and
    a key that shares a hot key's slot is merely dealt as well.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SALT_SLOTS))
    hot = right.where(F.col(n) > SALT_ROWS).groupBy(slot.alias("__slot")).agg(F.max(F.ceil(F.col(n) / SALT_ROWS)).cast("int").alias("__salts"))
    if not hot.limit(1).count():
        return left.join(right.hint("merge"), keys, how)
    flags = F.broadcast(hot)
    salted = left.withColumn("__slot", slot).join(flags, "__slot", "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__slot", "__salts")
    copies = right.withColumn("__slot", slot).join(flags, "__slot", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__slot", "__salts")
    return salted.join(copies.hint("merge"), [*keys, "__salt"], how).drop("__salt")
