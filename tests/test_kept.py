"""What is stored and kept up: commits, the text index, the catalogue's folders and previews."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalume.commits import CommitLog, ConcurrentWrite
from catalume.functions.text import match_text
from catalume.operators import fulltext
from catalume.operators.text_index import TextIndex
from catalume.plans.catalogue import Catalogue, Change, StalePreview
from catalume.schema import SearchParams

SCHEMA = "id long, filename string, searchable_path string"
WEIGHTS = {"filename": 2.0, "searchable_path": 1.0}


def test_of_two_commits_one_wins(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.head() == (0, {})
    assert log.commit(0, {"a": 1}) == 1 and log.head() == (1, {"a": 1})
    with pytest.raises(ConcurrentWrite):
        log.commit(0, {"a": 2})
    assert log.commit(1, {"a": 3}) == 2 and log.expire(1) == [{"a": 1}] and log.numbers() == [2]


def rows(changed=()):
    names = ["Metal_Hit 1.wav", "metal footstep", "UI click", "hitman", "Été à la mer", "", None, "a", "ab", "xmetalx hitx", "hit hit hit", "日本語 テスト"]
    out = {k: (names[k % len(names)], f"packs/{k % 5} sfx" if k % 3 else None) for k in range(60)}
    out.update(changed)
    return out


QUERIES = ["hit", "metal hit", "HIT metal", "ete", "Été", "u", "ui", "tman", "meta", "a", "la mer", "a b", "sfx 2", "2 sfx", "日本", "日本語", "zzz", "!!!", "hit tep", "metal_hit"]


def check(spark, index, table, queries):
    """Candidates hold all matches; scores equal those of a scan."""
    texts = spark.createDataFrame([(k, *v) for k, v in table.items()], SCHEMA)
    held = texts.cache()
    for k, q in enumerate(queries):
        for target, compat in [("anywhere", False)] + [("filename", False), ("path", True)] * (k % 4 == 1):
            want = {r.id for r in held.where(match_text(q, {"filename": F.col("filename"), "path": F.col("searchable_path")}, target, compat)).collect()}
            ids = index.candidates(q, target, compat)
            if ids is not None:
                got = {r.id for r in ids.collect()}
                assert want <= got, (q, target, compat)
                assert compat or min(map(len, q.split())) < 3 or len(got) <= len(want) + 10, (q, target)
        if k % 3 == 0:
            a, b = index.bm25(q, WEIGHTS), fulltext.bm25_columns(held, q, WEIGHTS)
            assert {r.id: round(r.score, 9) for r in a.collect()} == {r.id: round(r.score, 9) for r in b.collect()}, q
    held.unpersist()


def test_index_follows_writes(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), ["filename", "searchable_path"], buckets=4)
    assert index.candidates("hit").count() == 0 and index.bm25("hit", WEIGHTS).count() == 0
    make = lambda t: spark.createDataFrame([(k, *v) for k, v in t.items()], SCHEMA)
    first = rows()
    index.write(make(first), fresh=True)
    changes = {3: ("metal bell", "x"), 4: (None, None), 77: ("new hit", "packs")}
    index.write(make(changes), spark.createDataFrame([(10,), (999,), (None,)], "id long"))
    index.delete(spark.createDataFrame([(20,)], "id long"))
    index.write(make({20: ("back hit", None)}))
    table = {k: v for k, v in rows(changes).items() if k not in (10, 20)} | {20: ("back hit", None)}
    assert {r.id for r in index.live().collect()} == set(table)
    check(spark, index, table, QUERIES)
    index.compact()
    check(spark, index, table, QUERIES[:4])
    assert len(index._state()[1]["segments"]) == 1 and index._state()[1]["n"] == len(table)
    index.clean()
    assert len(list((tmp_path / "i" / "postings").iterdir())) == 1
    index.write(make({}), None)
    assert index.candidates("bell").collect()[0].id == 3


def test_a_lookup_reads_the_words_folders_alone(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), ["filename", "searchable_path"], buckets=64)
    index.write(spark.createDataFrame([(k, f"word{k} name{k}", "p") for k in range(500)], SCHEMA), fresh=True)
    plan = index.candidates("name7", "filename")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert index.candidates("name7 word7", "filename").count() == 11  # 7 and 70 to 79


def folder(tmp_path, name, files):
    out = tmp_path / name
    out.mkdir()
    for f in files:
        (out / f).parent.mkdir(exist_ok=True)
        (out / f).write_bytes(b"x" * 10)
    return out


def test_apply_does_what_was_shown(spark, tmp_path):
    a, b = folder(tmp_path, "a", ["one.png", "two.wav"]), folder(tmp_path, "b", ["three.png"])
    now = [1000.0]
    c = Catalogue(spark, str(tmp_path / "c"), clock=lambda: now[0])
    first, second = c.add_folder(str(a)), c.add_folder(str(b))
    ids = {r.filename: r.id for r in c.table("assets").collect()}
    c.record("image_metadata", spark.createDataFrame([(ids["one.png"], 1, 1, 5), (ids["three.png"], 1, 1, 5)], "asset_id long, width int, height int, processed_at long"))
    kept = {n: p[str(second)] for n, p in c.log.head()[1]["tables"].items() if str(second) in p}
    (a / "one.png").unlink()
    (a / "new.png").write_bytes(b"y")
    assert {r.status for r in c.preview_rescan(first).collect()} == {"removed", "added", "unchanged"}
    (a / "late.png").write_bytes(b"z")  # comes after the preview and waits for the next one
    c.apply_rescan(first, 7)
    assert sorted(r.filename for r in c.table("assets").collect()) == ["new.png", "three.png", "two.wav"]
    assert [r.asset_id for r in c.table("image_metadata").collect()] == [ids["three.png"]]
    # The other folder's files were not written again.
    assert kept == {n: p[str(second)] for n, p in c.log.head()[1]["tables"].items() if str(second) in p} and len(kept) == 3
    assert [r.filename for r in c.search(SearchParams("new")).collect()] == ["new.png"] and c.count(SearchParams("one")) == 0
    c.rescan(first)
    assert c.count(SearchParams("late")) == 1 and c.count(SearchParams("ate")) == 1
    c.preview_rescan(first)
    now[0] += 1801
    with pytest.raises(TimeoutError):
        c.apply_rescan(first)
    with pytest.raises(LookupError):
        c.apply_rescan(first)
    c.preview_rescan(second)
    c.set_excludes(second, spark.createDataFrame([(None, "x")], "zip_file string, excluded_path string"))
    with pytest.raises(StalePreview):
        c.apply_rescan(second)
    c.remove_folder(first)
    assert c.count(SearchParams("late")) == 0 and c.count(SearchParams("three")) == 1
    c.clean(1)
    assert c.count(SearchParams("three")) == 1 and c.table("directories").count() >= 0


def test_a_failed_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    a = folder(tmp_path, "a", ["one.png"])
    c = Catalogue(spark, str(tmp_path / "c"))
    fid = c.add_folder(str(a))
    c.preview_rescan(fid)
    (a / "two.png").write_bytes(b"y")
    c.preview_rescan(fid)
    before = c.log.head()
    monkeypatch.setattr(Catalogue, "_tree", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        c.apply_rescan(fid)
    assert c.log.head() == before and c.table("assets").count() == 1
    monkeypatch.undo()
    c.apply_rescan(fid)
    assert c.table("assets").count() == 2


def test_two_writers_lose_nothing(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path / "c"))
    c.add_folder(str(folder(tmp_path, "a", ["one.png"])))
    mine = Change(c)
    mine.put("source_folders", mine.table("source_folders").withColumn("label", F.lit("mine")))
    c.rename_folder(1, "theirs")
    with pytest.raises(ConcurrentWrite):
        mine.commit()
    assert c.folders().first().label == "theirs"
