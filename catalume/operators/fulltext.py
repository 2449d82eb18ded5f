"""Inverted index, BM25, boolean, phrase and proximity search, snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.functions.text import fold_literal, has_word, literal_tokens, trigrams, word_tokens


def word_index(texts: DataFrame, columns: list[str], id_column: str = "id") -> DataFrame:
    """(id, column, pos, token) of every word."""
    each = [texts.select(F.col(id_column).alias("id"), F.lit(c).alias("column"), F.posexplode(word_tokens(F.col(c))).alias("pos", "token")) for c in columns]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def trigram_index(texts: DataFrame, columns: list[str], id_column: str = "id") -> DataFrame:
    """(id, column, gram) of every distinct trigram."""
    each = [texts.select(F.col(id_column).alias("id"), F.lit(c).alias("column"), F.explode(trigrams(F.col(c))).alias("gram")) for c in columns]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def bm25(texts: DataFrame, query: str, column: str = "text", id_column: str = "id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the texts that hold any query word. Only the query's words are counted; nothing but one row of statistics meets every text.

    A generator of one row a text binds its tokens, so that no filter on the counts is pushed
    below them and makes the tokens anew.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
    """
    terms = list(dict.fromkeys(literal_tokens(query)))

    def count(t: Column) -> Column:
        return F.struct(F.size(t).alias("length"), *[(F.size(t) - F.size(F.array_remove(t, w))).alias(f"tf{k}") for k, w in enumerate(terms)])

    counted = texts.select(F.col(id_column).alias("id"), F.inline(F.transform(F.array(word_tokens(F.col(column))), count)))
    return _scored(counted, len(terms), k1, b)


def bm25_columns(texts: DataFrame, query: str, weights: dict[str, float], id_column: str = "id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) over several columns: a word's count in a column weighs as much as the column, and a text's length is that of all columns.

    The last word is a prefix, as in the search. Texts without any of the words are left out.
    """
    terms = list(dict.fromkeys(literal_tokens(query)))
    each = F.struct(*[word_tokens(F.col(c)).alias(f"t{k}") for k, c in enumerate(weights)])

    def times(s: Column, n: int, word: str) -> Column:
        own = (lambda t: F.size(F.filter(t, lambda x: x.startswith(word)))) if n == len(terms) - 1 else (lambda t: F.size(t) - F.size(F.array_remove(t, word)))
        return sum((own(s[f"t{k}"]) * float(w) for k, w in enumerate(weights.values())), F.lit(0.0))

    def count(s: Column) -> Column:
        length = sum((F.size(s[f"t{k}"]) for k in range(len(weights))), F.lit(0))
        return F.struct(length.alias("length"), *[times(s, n, w).alias(f"tf{n}") for n, w in enumerate(terms)])

    counted = texts.select(F.col(id_column).alias("id"), F.inline(F.transform(F.array(each), count)))
    return _scored(counted, len(terms), k1, b)


def _scored(counted: DataFrame, terms: int, k1: float, b: float) -> DataFrame:
    """(id, score) from id, length and tf0, tf1, ...: one row of statistics meets every row that holds a word."""
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(terms)])
    score: Column = F.lit(0.0)
    for k in range(terms):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean"))))
    some = counted.where(" or ".join(f"tf{k} > 0" for k in range(terms)) or "false")
    return some.crossJoin(F.broadcast(stats)).select("id", score.alias("score"))


def _index_rows(texts: DataFrame, column: str, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Postings (token, id, length, places) and lengths (id, length) of the texts. A text's postings are made where it is read, without a shuffle."""
    tokens = texts.select(F.col(id_column).alias("id"), F.explode(F.array(word_tokens(F.col(column)))).alias("t"))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not size.sum():
                continue
            words = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            entry = row * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(entry, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], np.diff(entry[order]) > 0)))
            first = order[start]
            places = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
            own = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([words.dictionary.take(words.indices.take(pa.array(first))), batch.column(0).take(own), pa.array(size[row[first]].astype(np.int32)), places], ["token", "id", "length", "places"])

    kind = tokens.schema["id"].dataType.simpleString()
    postings = tokens.mapInArrow(invert, f"token string, id {kind}, length int, places array<int>")
    return postings, tokens.select("id", F.size("t").alias("length"))


def _write_index(postings: DataFrame, lengths: DataFrame, path: str, buckets: int) -> None:
    # A common token's postings lie in several files of its folder, so none grows with the corpus.
    dealt = postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    lengths.write.parquet(f"{path}/lengths")
    written = lengths.sparkSession.read.schema("id bigint, length int").parquet(f"{path}/lengths")
    written.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/stats")


def write_index(texts: DataFrame, path: str, column: str = "text", id_column: str = "id", buckets: int = 256) -> None:
    """The stored full-text index of a column: postings (token, id, length, places) dealt into folders by a hash of the token, the texts' lengths, and one row of statistics.

    A search reads only the folders of its words. It is made once for many searches; a new
    path for a new version.
    """
    _write_index(*_index_rows(texts, column, id_column), path, buckets)


def refresh_index(spark: SparkSession, path: str, new_path: str, changed: DataFrame, texts: DataFrame, column: str = "text", id_column: str = "id") -> None:
    """The index at a new path after changes: the `changed` ids (column id) leave it, and the texts come in; deleted ids have no text."""
    gone = changed.select(F.col("id")).union(texts.select(F.col(id_column))).distinct()
    stay = lambda schema, name: spark.read.schema(schema).parquet(f"{path}/{name}").join(gone, "id", "left_anti")
    postings, lengths = _index_rows(texts, column, id_column)
    old = stay("token string, id bigint, length int, places array<int>", "postings").select("token", "id", "length", "places")
    buckets = spark.read.parquet(f"{path}/stats").first()["buckets"]
    _write_index(old.union(postings), stay("id bigint, length int", "lengths").select("id", "length").union(lengths), new_path, buckets)


def _postings(spark: SparkSession, path: str, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """The terms' postings, from their folders alone, and the statistics."""
    stats = spark.read.parquet(f"{path}/stats")
    buckets = stats.first()["buckets"]
    asked = spark.createDataFrame([(t,) for t in terms], "token string").select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()
    postings = spark.read.schema("token string, id bigint, length int, places array<int>, bucket int").parquet(f"{path}/postings")
    return postings.where(F.col("bucket").isin([r.b for r in asked]) & F.col("token").isin(terms)), stats


def bm25_from_index(spark: SparkSession, path: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) as `bm25`, from a stored index."""
    terms = list(dict.fromkeys(literal_tokens(query)))
    if not terms:
        return spark.createDataFrame([], "id bigint, score double")
    postings, stats = _postings(spark, path, terms)
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    tf, idf = F.size("places"), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    own = postings.join(F.broadcast(df.crossJoin(stats.select("n", "mean"))), "token")
    return own.select("id", (idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean"))))).alias("s")).groupBy("id").agg(F.sum("s").alias("score"))


def phrase_from_index(spark: SparkSession, path: str, words: str) -> DataFrame:
    """(id) of the texts in which the words stand consecutively, from a stored index: places are shifted by the word's place in the phrase and met."""
    terms = literal_tokens(words)
    if not terms:
        return spark.createDataFrame([], "id bigint")
    postings, _ = _postings(spark, path, list(dict.fromkeys(terms)))
    shift = F.create_map(*[F.lit(x) for t in dict.fromkeys(terms) for x in (t, ",".join(str(k) for k, w in enumerate(terms) if w == t))])
    starts = postings.select("id", F.explode(F.split(shift[F.col("token")], ",")).alias("k"), "places").select("id", "k", F.explode("places").alias("p"))
    return starts.groupBy("id", (F.col("p") - F.col("k").cast("int")).alias("start")).agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("id").distinct()


def phrase(tokens: Column, words: list[str]) -> Column:
    """The words stand consecutively: one scan of the tokens, joined by the space that no token holds."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(words)} ") if words else F.lit(False)


def near(tokens: Column, a: str, b: str, distance: int) -> Column:
    """Both words stand with at most `distance` words between them: one pass that keeps the last place of each."""

    def step(s: Column, t: Column) -> Column:
        i = s["i"] + 1
        x, y = F.when(t == a, i).otherwise(s["x"]), F.when(t == b, i).otherwise(s["y"])
        return F.struct(i.alias("i"), x.alias("x"), y.alias("y"), (s["hit"] | F.coalesce(F.abs(x - y) <= distance + 1, F.lit(False))).alias("hit"))

    none = F.lit(None).cast("int")
    return F.aggregate(tokens, F.struct(F.lit(0).alias("i"), none.alias("x"), none.alias("y"), F.lit(False).alias("hit")), step, lambda s: s["hit"])


def boolean_condition(query: str, tokens: Column) -> Column:
    """A condition for `a AND b`, `a OR b`, `a NOT b`, parentheses, "a phrase", prefix* and NEAR(a b, n); adjacent terms are joined by AND.

    NOT binds tightest, then AND, then OR, each from left to right.
    """
    items = re.findall(r'NEAR\(\s*\S+\s+\S+?\s*(?:,\s*\d+\s*)?\)|"[^"]*"|[()]|[^\s()"]+', query)
    at = 0

    def peek() -> str | None:
        return items[at] if at < len(items) else None

    def take() -> str:
        nonlocal at
        at += 1
        return items[at - 1]

    def either() -> Column:
        out = both()
        while peek() == "OR":
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = without()
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                take()
            out = out & without()
        return out

    def without() -> Column:
        out = term()
        while peek() == "NOT":
            take()
            out = out & ~term()
        return out

    def term() -> Column:
        item = peek()
        if item is None or item in (")", "AND", "OR", "NOT"):
            raise ValueError(f"a term is missing in {query!r}")
        take()
        if item == "(":
            out = either()
            if peek() != ")":
                raise ValueError(f"a parenthesis is open in {query!r}")
            take()
            return out
        if m := re.fullmatch(r"NEAR\(\s*(\S+)\s+(\S+?)\s*(?:,\s*(\d+)\s*)?\)", item):
            return near(tokens, fold_literal(m[1]), fold_literal(m[2]), int(m[3] or 10))
        if item.startswith('"'):
            return phrase(tokens, literal_tokens(item))
        words = literal_tokens(item.rstrip("*"))
        if item.endswith("*") and len(words) == 1:
            return has_word(tokens, words[0], prefix=True)
        return phrase(tokens, words) if len(words) > 1 else has_word(tokens, words[0]) if words else F.lit(False)

    out = either()
    if at < len(items):
        raise ValueError(f"a parenthesis is missing in {query!r}")
    return out


def prefix_terms(query: str) -> str:
    """Each term as a prefix, unless the query has an operator."""
    return query if re.search(r'["()*]|\b(AND|OR|NOT|NEAR)\b', query) else " ".join(t + "*" for t in query.split())


def snippet(text: Column, term: str, around: int = 30, before: str = "[", after: str = "]") -> Column:
    """The first place of the term with its surroundings, marked; the text's beginning if it is absent."""
    at = F.instr(F.lower(text), F.lit(term.lower()))
    start = F.greatest(at - around, F.lit(1))
    n = len(term)
    return F.when(at > 0, F.concat(F.substring(text, start, at - start), F.lit(before), F.substring(text, at, F.lit(n)), F.lit(after), F.substring(text, at + n, F.lit(around)))).otherwise(F.substring(text, 1, around * 2))
