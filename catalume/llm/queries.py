"""The registered queries of the numbered operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm import ann, collocations, decontamination, language_id, licenses, maxent_lm, ngram_join, packing, secrets, spelling, suffix_dedup, token_counts, warc
from catalume.llm.common import documents, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def remainder(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(documents(spark, sf_dir), 5, 0.8)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors.where("vec_id % 20 = 0"), vectors, 20)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), 10)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maxent_lm.score(documents(spark, sf_dir), remainder(7) != 2)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), BYTE_BPE, 512)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, sf_dir)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(documents(spark, sf_dir), WORDS)

    def text(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(documents(spark, sf_dir), BYTE_BPE, 1024, 0))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(remainder(4) != 2), PIECES)
    return language_id.predict(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), longest=3, least=10, share=50, most=2000)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), every=199, least_length=6, least_n=5, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), least_bytes=0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


_OP11_SQL = """
with pieces as (
  select lang, row_number() over () as id, piece from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)
),
split as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, w, unnest(range(1, len(w) + 1)) as i from split), range(1, 4) as t(k) where i + k - 1 <= len(w)
),
counts as (select lang, k, phrase, count(*) as f, string_split(phrase, ' ') as w from grams group by lang, k, phrase),
totals as (select lang, sum(f)::bigint as n from counts where k = 1 group by lang),
candidates as (select lang, k, phrase, w, f as a from counts where k > 1 and f >= 10),
longer as (select lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as phrase, a as over from candidates where k = 3),
kept as (
  select c.* from candidates c left join (select lang, phrase, max(over) as over from longer group by all) using (lang, phrase)
  where over is null or 100 * over < 50 * a
),
cuts as (select lang, phrase, a, cut, array_to_string(w[1:cut], ' ') as x, array_to_string(w[cut + 1:], ' ') as y from kept, range(1, 3) as t(cut) where cut < k),
scored as (
  select lang, cuts.phrase, a, cut, u.f as l, v.f as r, ((a::hugeint * a * 1000000) // (u.f::hugeint * v.f))::bigint as score
  from cuts join counts u using (lang) join counts v using (lang) where u.phrase = x and v.phrase = y
),
best as (select lang, phrase, a, arg_min(struct_pack(l, r, score), (score, cut)) as s from scored group by lang, phrase, a),
ranked as (select lang, row_number() over (partition by lang order by s.score desc, a desc, phrase) as rank, phrase, a, s.l as l, s.r as r, s.score as score from best)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""

#: CRC-32 of the UTF-8 bytes of k, which stand in hexadecimal in x, over a table of the 256 checksums of single bytes.
_CRC_SQL = """
crc_table as (
  select list(list_reduce(list_concat([i], range(8)), lambda c, b: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as t from range(256) r(i)
),
hashed as (
  select k, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::int, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h
  from (select k, hex(encode(k)) as x from keys), crc_table
)"""

_OP12_SQL = f"""
with recursive docs as (select coalesce(doc_id::varchar, '') as id, coalesce(text, '') as text from documents),
runs as (
  select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from (select id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from docs)
),
counted as (select id, run, id || ':' || run as k, count(*) as n from runs where length(run) >= 6 group by all),
keys as (select distinct k from counted), {_CRC_SQL},
cut as (
  select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n
  from counted join hashed using (k)
),
words as (select word, sum(n)::bigint as n from cut where length(word) >= 6 group by word having sum(n) >= 5),
holes as (select word, n, substr(word, 1, i::int) as a, substr(word, i::int + 2) as b from words, lateral (select unnest(range(length(word))) as i)),
pairs as (
  select x.word, y.word as near, y.n as near_n from holes x join holes y on x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, y.word, y.n from holes x join words y on y.word = x.a || x.b
  union select y.word, x.word, x.n from holes x join words y on y.word = x.a || x.b
),
best as (select word, count(distinct near) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from pairs group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 5 * n then near end as form, case when near_n >= 5 * n then near_n end as form_n
  from words w left join best using (word)
),
chain as (
  select word, word as root, form as next from forms
  union all select c.word, f.word, f.form from chain c join forms f on f.word = c.next
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from forms f join chain c on c.word = f.word and c.next is null
"""


_OP13_SQL = """
with pages_ as (select page_id, coalesce(html, '') as html from pages),
bits as (select page_id, octet_length(encode(html))::bigint as payload_bytes, unhex(sha1(html))::bit::varchar as b from pages_),
coded as (
  select page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_reduce(list_concat([0], list_transform(range(5), lambda j: substr(b, (5 * i + j + 1)::int, 1)::int)), lambda x, y: 2 * x + y)::int + 1, 1)), 'string_agg', '') as payload_digest
  from bits
),
ranked as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as best from coded)
select page_id, payload_bytes, payload_digest, case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id <> best then best end as refers_to
from ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": _OP11_SQL, "op12_spelling_variants": _OP12_SQL, "op13_warc": _OP13_SQL}
