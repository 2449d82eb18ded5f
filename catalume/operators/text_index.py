"""A stored text index that writes keep up: segments with tombstones, looked up together and merged on compaction."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.commits import CommitLog, file_system
from catalume.functions.text import literal_tokens, query_parts, query_words, trigrams, word_tokens

#: Columns of the index's tables; each has seg (the segment's name) and, but for the last two, bucket as folders.
SCHEMAS = {
    "postings": "token string, id bigint, name string, length int, n int, seg string, bucket int",
    "grams": "gram string, id bigint, name string, seg string, bucket int",
    "docs": "id bigint, length int, seg string",
    "gone": "id bigint, seg string",
}
#: Rows of a segment's table for each file of a bucket.
FILE_ROWS = 4_000_000
#: Words or trigrams of a query that are looked up; a longer query's others are verified alone.
MOST_KEYS = 60


class TextIndex:
    """Words and trigrams of named text columns, by id.

    A write adds a segment: the postings of its texts, and the ids that it replaces or deletes,
    which count no more in earlier segments. Nothing written is changed; a commit adds the
    segment's name to the state. A word's bucket follows from its first two characters, so a
    word and a prefix of two characters are each found in one folder of a segment.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.columns, self.buckets = spark, path.rstrip("/"), list(columns), buckets
        self.log, self.fixed = CommitLog(spark, f"{self.path}/commits"), None

    def at(self, state: dict | None) -> TextIndex:
        """The index in a state that its owner keeps, as `staged` gives it; None is the empty one."""
        out = TextIndex(self.spark, self.path, self.columns, self.buckets)
        out.fixed = state or {}
        return out

    def _state(self) -> tuple[int, dict]:
        number, state = self.log.head() if self.fixed is None else (0, self.fixed)
        return number, state or {"segments": [], "n": 0, "length": 0, "buckets": self.buckets, "gone": 0}

    def _bucket(self, column: str, state: dict) -> Column:
        return F.pmod(F.xxhash64(F.substring(column, 1, 2) if column == "token" else F.col(column)), F.lit(state["buckets"])).cast("int")

    def _table(self, name: str, state: dict) -> DataFrame:
        """The rows of all segments of a state, with place, the segment's number in order."""
        segments = state["segments"]
        if not segments:
            return self.spark.createDataFrame([], SCHEMAS[name]).withColumn("place", F.lit(0))
        rows = self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/seg={s}" for s in segments if self._has(name, s)] or [f"{self.path}/{name}"])
        return rows.withColumn("place", F.array_position(F.array(*map(F.lit, segments)), F.col("seg")))

    def _has(self, name: str, segment: str) -> bool:
        fs, at = file_system(self.spark, f"{self.path}/{name}/seg={segment}")
        return fs.exists(at)

    def _store(self, name: str, segment: str, rows: DataFrame, files: int = 1) -> None:
        out = f"{self.path}/{name}/seg={segment}"
        if "bucket" in rows.columns:
            key = rows.columns[0]
            rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(files))).sortWithinPartitions("bucket", key, "id").write.partitionBy("bucket").parquet(out)
        else:
            rows.write.parquet(out)

    def _rows(self, texts: DataFrame, id_column: str, state: dict) -> dict[str, Callable[[], DataFrame]]:
        """Postings, trigrams and lengths of texts; the array of one struct binds each row's tokens."""
        own = texts.select(F.col(id_column).cast("bigint").alias("id"), *self.columns)
        tokens = own.select("id", F.explode(F.array(F.struct(*[word_tokens(F.col(c)).alias(c) for c in self.columns]))).alias("t"))
        length = sum((F.size(F.col("t")[c]) for c in self.columns), F.lit(0)).cast("int")

        def postings() -> DataFrame:
            each = tokens.select("id", length.alias("length"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col("t")[c].alias("words")) for c in self.columns])).alias("x"))
            counted = each.select("id", "length", F.col("x.name").alias("name"), F.explode("x.words").alias("token")).groupBy("token", "id", "name", "length").agg(F.count("*").cast("int").alias("n"))
            return counted.select("token", "id", "name", "length", "n").withColumn("bucket", self._bucket("token", state))

        def grams() -> DataFrame:
            each = own.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), trigrams(F.coalesce(c, F.lit(""))).alias("grams")) for c in self.columns])).alias("x"))
            return each.select(F.explode("x.grams").alias("gram"), "id", F.col("x.name").alias("name")).select("gram", "id", "name").withColumn("bucket", self._bucket("gram", state))

        return {"postings": postings, "grams": grams, "docs": lambda: tokens.select("id", length.alias("length"))}

    def live(self, state: dict | None = None) -> DataFrame:
        """(id, length) of the texts that count."""
        state = state or self._state()[1]
        return self._alive(self._table("docs", state), state).select("id", "length")

    def _alive(self, rows: DataFrame, state: dict) -> DataFrame:
        """Without the rows of ids that a later segment has replaced or deleted."""
        if not state["gone"]:
            return rows
        last = self._table("gone", state).groupBy("id").agg(F.max("place").alias("__gone"))
        return rows.join(last, "id", "left").where("__gone is null or place >= __gone").drop("__gone")

    def write(self, texts: DataFrame, deleted: DataFrame | None = None, id_column: str = "id", fresh: bool = False) -> None:
        """Adds a segment: the texts (each id once), in place of what their ids had, and without the ids in `deleted`.

        `fresh` says that no id of the texts is in the index, which spares the look at those
        it has. Ids that are not there may be deleted; null ids and texts count as nothing
        and as empty. A write that meets another one raises ConcurrentWrite and leaves no
        trace in the state.
        """
        number, state = self._state()
        self.log.commit(number, self._staged(state, texts, deleted, id_column, fresh))

    def staged(self, texts: DataFrame, deleted: DataFrame | None = None, id_column: str = "id", fresh: bool = False) -> dict:
        """As `write`, but for the commit: the state is its owner's to commit together with others."""
        return self._staged(self._state()[1], texts, deleted, id_column, fresh)

    def _staged(self, state: dict, texts: DataFrame, deleted: DataFrame | None, id_column: str, fresh: bool) -> dict:
        segment = uuid.uuid4().hex
        texts = texts.where(F.col(id_column).isNotNull())
        rows = self._rows(texts, id_column, state)
        self._store("docs", segment, rows["docs"]())
        docs = self.spark.read.schema("id bigint, length int").parquet(f"{self.path}/docs/seg={segment}")
        n, length = docs.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if n:
            files = 1 + n // FILE_ROWS
            self._store("postings", segment, rows["postings"](), files)
            self._store("grams", segment, rows["grams"](), files)
        touched = [] if fresh else [docs.select("id")]
        if deleted is not None:
            touched.append(deleted.select(F.col(deleted.columns[0]).cast("bigint").alias("id")))
        gone = less = 0
        if touched and state["n"]:
            ids = reduce(DataFrame.union, touched).distinct()
            self._store("gone", segment, self.live(state).join(ids, "id", "left_semi").select("id", "length"))
            gone, less = self.spark.read.parquet(f"{self.path}/gone/seg={segment}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return state | {"segments": [*state["segments"], segment], "n": state["n"] + n - gone, "length": state["length"] + length - less, "gone": state["gone"] + gone}

    def delete(self, ids: DataFrame) -> None:
        self.write(self.spark.createDataFrame([], "id bigint, " + ", ".join(f"{c} string" for c in self.columns)), ids)

    def compact(self) -> None:
        """Merges all segments into one without what is gone; the old ones stay for running searches until `clean`."""
        number, state = self._state()
        segment, files = uuid.uuid4().hex, 1 + state["n"] // FILE_ROWS
        for name in ("docs", "postings", "grams"):
            rows = self._alive(self._table(name, state), state).drop("seg", "place")
            self._store(name, segment, rows.select([c for c in [f.split()[0] for f in SCHEMAS[name].split(", ")] if c != "seg"]), files)
        self.log.commit(number, state | {"segments": [segment], "gone": 0})

    def clean(self, keep: int = 1) -> None:
        """Deletes the segments that only states before the last `keep` name."""
        old = {s for state in self.log.expire(keep) for s in state["segments"]}
        stay = {s for number in self.log.numbers() for s in self.log.read(number)["segments"]}
        for segment in old - stay:
            for name in SCHEMAS:
                fs, at = file_system(self.spark, f"{self.path}/{name}/seg={segment}")
                fs.delete(at, True)

    def _asked(self, keys: list[str], column: str, state: dict) -> list[int]:
        """The buckets of words or trigrams."""
        rows = self.spark.createDataFrame([(k,) for k in keys], f"{column} string").select(self._bucket(column, state).alias("b")).distinct().collect()
        return [r.b for r in rows]

    def _word_rows(self, words: list[str], state: dict) -> tuple[DataFrame, list[Column]]:
        """The postings of words, the last one a prefix, from their folders alone; and a condition for each word."""
        tests = [F.col("token") == w for w in words[:-1]] + [F.col("token").startswith(words[-1])]
        rows = self._table("postings", state)
        if all(len(w) > 1 for w in words[-1:]):
            rows = rows.where(F.col("bucket").isin(self._asked(words, "token", state)))
        return rows.where(reduce(Column.__or__, tests)), tests

    def candidates(self, text: str, target: str = "anywhere", compat: bool = False) -> DataFrame | None:
        """(id) of all texts that may match a query as `match_text` has it, and few others; None if the index can't tell.

        By words: every word, the last one a prefix, stands in some column. By substrings:
        all trigrams of each term stand in one column. Ids are met by bits, aggregated before
        the shuffle, so a word of very many texts is not one task. What is gone may be among
        the ids; whoever asks looks at the rows themselves.
        """
        state = self._state()[1]
        held = None if target == "anywhere" or compat else {"path": "searchable_path"}.get(target, target)
        within = lambda rows: rows.where(F.col("name") == held) if held else rows
        words, parts = query_words(text, compat), query_parts(text, compat)
        none = self.spark.createDataFrame([], "id bigint")
        found = [none]
        if words:
            rows, tests = self._word_rows([*words[: MOST_KEYS - 1], words[-1]] if len(words) > MOST_KEYS else words, state)
            bits = reduce(Column.bitwiseOR, [F.when(t, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, t in enumerate(tests)])
            found.append(within(rows).groupBy("id").agg(F.bit_or(bits).alias("bits")).where(F.col("bits") == (1 << len(tests)) - 1).select("id"))
        if words and parts:
            keys = {p: list(dict.fromkeys(p[i : i + 3] for i in range(len(p) - 2))) for p in parts if len(p) >= 3}
            grams = list(dict.fromkeys(g for own in keys.values() for g in own))[:MOST_KEYS]
            if not grams:
                return None
            rows = within(self._table("grams", state)).where(F.col("bucket").isin(self._asked(grams, "gram", state)) & F.col("gram").isin(grams))
            bit = F.element_at(F.create_map(*[F.lit(x) for k, g in enumerate(grams) for x in (g, 1 << k)]), F.col("gram")).cast("bigint")
            by_id = rows.groupBy("id").agg(*[F.bit_or(F.when(F.col("name") == c, bit).otherwise(0)).alias(f"b{k}") for k, c in enumerate(self.columns)])
            wanted = [sum(1 << grams.index(g) for g in own if g in grams) for own in keys.values()]
            tests = [reduce(Column.__or__, [F.col(f"b{k}").bitwiseAND(F.lit(w)) == w for k in range(len(self.columns))]) for w in wanted]
            found.append(by_id.where(reduce(Column.__and__, tests)).select("id"))
        return reduce(DataFrame.union, found).distinct()

    def bm25(self, text: str, weights: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score) as `fulltext.bm25_columns` has it over the live texts, from the words' folders and the state's totals."""
        state = self._state()[1]
        terms = list(dict.fromkeys(literal_tokens(text)))
        if not terms:
            return self.spark.createDataFrame([], "id bigint, score double")
        rows, tests = self._word_rows(terms, state)
        weight = F.element_at(F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, float(w))]), F.col("name"))
        own = self._alive(rows.where(F.col("name").isin(list(weights))), state)
        tf = own.groupBy("id", "length").agg(*[F.sum(F.when(t, weight * F.col("n")).otherwise(0.0)).alias(f"tf{k}") for k, t in enumerate(tests)])
        df = tf.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
        n, mean = F.lit(state["n"]), F.lit(state["length"] / max(1, state["n"]))
        score = F.lit(0.0)
        for k in range(len(terms)):
            f, d = F.col(f"tf{k}"), F.col(f"df{k}")
            score = score + F.log(1 + (n - d + 0.5) / (d + 0.5)) * (f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("length") / mean)))
        return tf.crossJoin(F.broadcast(df)).select("id", score.alias("score"))
