"""Collocations, spelling variants and web archives against brute force, round trips and SQL."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from catalume.llm import collocations as C
from catalume.llm import queries as Q
from catalume.llm import spelling, warc
from catalume.llm.common import shared_path, written

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, word string, n long, archive string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """(doc_id, text, lang) with further columns, of names that operators use inside."""
    return spark.createDataFrame([(*r, "s", 1, 2, "w", 3, "a") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    draw = np.random.default_rng(11)
    names = ["new york", "Ice cream", "au revoir", "a a a a", "été là-bas", "of the"]
    out = [None, "", " \t ", "...", "a", "x" * 3000, "New\tYork\x0bnew  york;ice\x0ccream!Ice cream", "\x00 \x00 b"]
    for k in range(60):
        words = [names[draw.integers(6)] if draw.random() < 0.4 else f"w{draw.integers(40)}" for _ in range(40)]
        out.append("".join(w + [" ", " ", ", ", "\n", "  "][draw.integers(5)] for w in words))
    out.append(" ".join(f"w{draw.integers(30)}" for _ in range(3000)))
    return out + out[8:20]


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs = ["en", None, "und", "en"]
    return table(spark, [(k if k % 9 else None, t, langs[k % 4]) for k, t in enumerate(texts)])


def brute_counts(rows, longest):
    out = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    out[lang or "und", tuple(words[i : i + k])] += 1
    return out


def brute_collocations(rows, longest=3, least=10, share=50, most=2000):
    f = brute_counts(rows, longest)
    candidates = {p: n for p, n in f.items() if len(p[1]) > 1 and n >= least}
    over = Counter()
    for (lang, w), n in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                over[lang, w[i : i + k]] = max(over[lang, w[i : i + k]], n)
    out = []
    for lang in {p[0] for p in f}:
        rows_ = []
        for (own, w), a in candidates.items():
            if own == lang and not 100 * over[own, w] >= share * a:
                score, cut = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
                rows_.append((-score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]]))
        n = sum(v for (own, w), v in f.items() if own == lang and len(w) == 1)
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:most])]
    return sorted(out)


def test_collocations(docs):
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    want = brute_collocations(rows)
    got = C.collocations(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10
    few = sorted(map(tuple, C.collocations(docs, longest=4, least=3, share=70, most=7).collect()))
    assert few == brute_collocations(rows, 4, 3, 70, 7) and len(few) == 14
    assert C.collocations(docs.limit(0)).collect() == []


def test_phrases_of_small_blocks_and_buckets(docs, monkeypatch):
    """Texts longer than a block, cut between words; a sketch of many buckets gives the same counts."""
    monkeypatch.setattr(C, "BUCKET_PHRASES", 500)
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    want = {(lang, " ".join(w)): n for (lang, w), n in brute_counts(rows, 3).items() if n >= 3}
    for size in (60, 700):
        stored = written(C.blocks(docs, 3, size), "blocks")
        assert stored.count() > 10
        got = {(r.lang, r.phrase): r.f for r in C.frequent_phrases(stored, 3, 3).collect()}
        assert got == want
    with pytest.raises(ValueError):
        C.frequent_phrases(stored, 3, 256)


@pytest.mark.parametrize("text", ["a b c d e f g h", "a b\nc d e\nf", "abcdefghijkl", "abcdefghijkl m\nabcdefghijkl m n o p", "a", ""])
@pytest.mark.parametrize("limit", [1, 2, 3, 5, 8, 100])
def test_parts_add_up(text, limit):
    def counts(t):
        return Counter({w: n for (_, w), n in brute_counts([("x", t.decode())], 3).items()})

    total = Counter()
    for body, again in C.parts(text.encode(), limit, 3):
        total.update(counts(body))
        total.subtract(counts(again))
    assert +total == counts(text.encode()) and min(total.values(), default=0) >= 0


def brute_variants(rows, every=199, least_length=6, least_n=5, ratio=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= least_length
    counts = {w: n for w, n in counts.items() if n >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    links = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and near(w, v)] for w in counts}
    form = {w: min(links[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: v if v and counts[v] >= ratio * counts[w] else None for w, v in form.items()}
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(links[w]), form[w], counts.get(form[w]), root))
    return sorted(out)


def test_variants(spark):
    draw = np.random.default_rng(4)
    bases = ["straße" "n", "collocation", "Éléphant", "aaaaaaa", "ÀÉÎõüÿ", "minimum"]
    words = []
    for base in bases:
        for size in (400, 60, 11, 5):
            at = int(draw.integers(len(base)))
            word = base if size == 400 else [base[:at] + base[at + 1 :], base[:at] + "q" + base[at:], base[:at] + "z" + base[at + 1 :]][draw.integers(3)]
            words += [word] * size
    words += ["aaaaaa"] * 70 + ["aaaaaaaa"] * 6 + ["aaaaaab"] * 14 + ["aaaaabb"] * 5 + ["short"] * 50 + ["chained"] * 400 + ["chainee"] * 62 + ["chaineea"] * 8 + ["y" * 300] * 5 + ["y" * 301] * 30
    draw.shuffle(words)
    rows = [(k if k % 5 else None, " ".join(words[a : a + 90]), "en") for k, a in enumerate(range(0, len(words), 90))]
    rows += [(1, None, None), (2, "", None), (3, "1 2 ×÷ ßßßßßß", "x"), rows[1], (4, "naïve" * 2000, "x")]
    docs = table(spark, rows)
    pairs = [(i, t) for i, t, _ in rows]
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    for every in (199, 3):
        want = brute_variants(pairs, every)
        assert sorted(map(tuple, spelling.variants(docs, every).select(columns).collect())) == want
        assert every == 3 or any(r[3] and r[5] != r[3] for r in want), "a chain of forms"
    assert spelling.variants(docs.limit(0)).collect() == []


def test_a_near_pair_has_an_equal_band():
    import pyarrow as pa

    draw = np.random.default_rng(8)
    letters = [*map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))]
    for _ in range(200):
        word = "".join(draw.choice(letters, 9))
        at, new = int(draw.integers(9)), str(draw.choice(letters))
        for other in (word[:at] + new + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + new + word[at:]):
            assert any(m[0] == m[1] for m in spelling.masks(pa.array([word, other])))


def test_archives_of_pages(spark):
    html = ["<p>é</p>", "", None, "a\r\n\r\nb", "x" * 5000, "WARC/1.1\r\n\r\nfiledesc://x\n", "<p>é</p>", "", "HTTP/1.1 200 OK\r\n\r\n"]
    rows = [(k if k != 3 else None, f"http://h/{k} é\n?q= 1" if k % 4 else None, html[k % 9], "x", 5) for k in range(40)] + [(7, "http://h/7", "", "x", 5)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string, offset int").repartition(3)
    for least in (0, 1, 10):
        best = {}
        for i, _, h, *_ in rows:
            best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
        want, seen = [], set()
        for i, _, h, *_ in rows:
            data = (h or "").encode()
            mine = len(data) < least or i == best[h or ""] and (i, h) not in seen
            seen.add((i, h))
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if mine else "revisit", None if mine else best[h or ""]))
        assert sorted(map(repr, map(tuple, warc.archived(pages, least).collect()))) == sorted(map(repr, want))
    assert warc.archived(pages.limit(0)).collect() == []


def test_archives_are_valid_and_refer_to_their_responses(spark):
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    pages = spark.createDataFrame([(k, f"http://h/{k}", "same" if k % 3 else "a" * k) for k in range(30)], "page_id long, url string, html string").coalesce(2)
    warc.write_arc(warc.http_records(pages, "20031231235958"), arc, 1200)
    files = [r.content for r in spark.read.format("binaryFile").load(arc).collect()]
    assert len(files) > 4 and {gzip.decompress(f).split(b"\n")[1][:1] for f in files} == {b"1", b"2"}
    warc.convert(spark, arc, out)
    rows = warc.warc_index(spark, out).collect()
    assert len([r for r in rows if r.record_type == "warcinfo"]) == len(files)
    by_id = {r.record_id: r for r in rows}
    assert len(by_id) == len(rows) == 30 + len(files)
    for r in rows:
        assert r.error is None
        if r.record_type == "revisit":
            to = by_id[r.refers_to_id]
            assert (to.record_type, to.payload_digest, to.rank) == ("response", r.payload_digest, r.refers_to_rank) and to.rank == 29
        if r.record_type != "warcinfo":
            assert (r.date, r.target_uri) == ("2003-12-31T23:59:58Z", f"http://h/{r.rank}")
    content = spark.read.format("binaryFile").load(out).first().content
    assert all(r["error"] is None for r in warc.warc_records(gzip.decompress(content)))


V1 = b"filedesc://IA.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"


def test_arc_lines_of_both_versions_and_damage():
    one = b"http://a b/ 1.2.3.4 19970101 text/html 30\nHTTP/1.0 200 OK\nX: 1\n\nhello\n!!\n"
    dns = b"dns:a 1.2.3.4 19961301000000 text/dns 3\nabc\n"
    found = list(warc.arc_records(V1 + one + dns))
    assert [r["url"] for r in found] == ["filedesc://IA.arc", "http://a b/", "dns:a"] and not any(r["error"] for r in found)
    assert found[1]["block"].endswith(b"hello\n!!") and warc.http_parts(found[1]["block"])[1] == b"hello\n!!"
    assert [warc.warc_type(r) for r in found] == ["warcinfo", "response", "resource"]
    assert [warc.warc_date(r["archive-date"]) for r in found] == ["1996-09-23T14:21:03Z", "1997-01-01T00:00:00Z", "1970-01-01T00:00:00Z"]
    two = b"http://c/ 9.9.9.9 20010203040506 text/html 200 SUM - 77 f.arc 4\nbody\n"
    (row,) = warc.arc_records(two)
    assert (row["url"], row["result-code"], row["checksum"], row["offset"], row["at"], row["block"]) == ("http://c/", "200", "SUM", "77", 0, b"body")
    # A declared length that is too small: what is skipped gives one row with error, the next record is found again.
    bad = b"http://x/ 1.1.1.1 19970101000000 text/html 2\nlonger than said\n"
    found = list(warc.arc_records(V1 + bad + dns))
    assert [r["error"] for r in found] == [None, None, "no header line", None] and found[-1]["block"] == b"abc"
    (row,) = warc.arc_records(b"http://x/ 1.1.1.1 19970101000000 text/html 50\nshort")
    assert row["error"] == "shorter than declared"
    damaged = warc.member(V1) + warc.member(dns)[:-12]
    assert list(warc.arc_records(damaged))[-1]["error"].startswith("damaged")
    assert list(warc.arc_records(b"")) == []
    record = warc.warc_record("x", {"at": 5, "url": "dns:a", "ip-address": "1.2.3.4", "archive-date": "1997", "content-type": "text/dns", "block": b"abc"})
    (row,) = warc.warc_records(record)
    assert row["warc-type"] == "resource" and row["warc-ip-address"] == "1.2.3.4" and row["error"] is None
    assert [r["error"] for r in warc.warc_records(record.replace(b"abc", b"abd"))] == ["warc-block-digest differs"]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    found = con.sql(Q.oracle_sql()[name])
    order = [found.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in order)) for r in found.fetchall())
