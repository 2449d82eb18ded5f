"""Golden rows and edge cases of the catalogue operators."""

import pytest
from pyspark.sql import functions as F

from catalume.functions import paths, scalars, vectors
from catalume.functions.text import match_text, word_tokens
from catalume.operators import diff, duplicates, fulltext, mutations, search, tree, vector, work
from catalume.schema import FolderLocation, SearchParams, struct

GOLDEN = [(1, "Metal_Hit-01.wav", "Packs Impacts"), (2, "footstep wood.wav", "Foley Metal"), (3, "Été.png", "images"), (4, "hitman.png", "metal sub")]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLDEN, "id int, filename string, searchable_path string")


def found(golden, text, column="anywhere", compat=False):
    columns = {"filename": F.col("filename"), "path": F.col("searchable_path")}
    return sorted(r.id for r in golden.where(match_text(text, columns, column, compat)).collect())


@pytest.mark.parametrize(("text", "column", "compat", "ids"), [
    ("hit", "anywhere", False, [1, 4]), ("HIT", "anywhere", False, [1, 4]), ("eta", "anywhere", False, [1, 2, 4]), ("me", "anywhere", False, [1, 2, 4]),
    ("metal hit", "anywhere", False, [1, 4]), ("metal hit", "filename", False, [1]), ("ete", "anywhere", False, [3]), ("été", "anywhere", False, [3]),
    ("hit-01", "anywhere", False, [1]), ("100%", "anywhere", False, []), ("it's", "anywhere", False, [1, 4]), ("metal zz", "anywhere", False, []), ("metal zz", "anywhere", True, [1, 2, 4]), ("--", "anywhere", False, []),
])
def test_text_golden(golden, text, column, compat, ids):
    assert found(golden, text, column, compat) == ids


def test_compat_binds_the_target_to_the_first_term(spark):
    rows = spark.createDataFrame([(9, "metal one", "hit path")], "id int, filename string, searchable_path string")
    assert found(rows, "metal hit", "filename", True) == [9]
    assert found(rows, "metal hit", "filename", False) == []


def test_boolean_phrase_near_prefix(spark):
    rows = spark.createDataFrame([(1, "metal hit one"), (2, "wood"), (3, "hit the metal"), (4, None)], "id int, t string").select("id", word_tokens(F.col("t")).alias("w"))

    def ids(q):
        return [r.id for r in rows.where(fulltext.boolean_condition(q, F.col("w"))).orderBy("id").collect()]

    assert ids("hit OR wood") == [1, 2, 3]
    assert ids("hit NOT one") == [3]
    assert ids('"metal hit"') == [1]
    assert ids("NEAR(hit metal, 1)") == [1, 3]
    assert ids("NEAR(hit metal, 0)") == [1]
    assert ids("wo*") == [2]
    assert ids("(hit AND one) OR wood") == [1, 2]
    with pytest.raises(ValueError):
        fulltext.boolean_condition("(hit", F.col("w"))
    assert fulltext.prefix_terms("a b") == "a* b*" and fulltext.prefix_terms("a OR b") == "a OR b"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "ms"), [("50ms", 50), ("1.5s", 1500), ("2m", 120_000), ("2m30s", 150_000), ("1:30", 90_000), ("7", 7000), ("", None), ("abc", None),
    ("30sec", 30_000), ("2 min", 120_000), ("2min30sec", 150_000), ("1.5m30s", 120_000), ("2M 30S", 150_000), (".5s", None), ("1.", None), ("1:30.5", 90_500), ("1.5:30", None), ("50 MS", 50), ("0.4ms", 0), ("2h", None)])
def test_parse_duration(spark, text, ms):
    assert one(spark, scalars.parse_duration(F.lit(text))) == ms


@pytest.mark.parametrize(("ms", "label"), [(0, "0ms"), (999, "999ms"), (1000, "1s"), (12_345, "12.3s"), (12_250, "12.3s"), (1050, "1.1s"), (1150, "1.1s"), (1450, "1.4s"), (59_999, "60.0s"), (60_000, "1m"), (90_400, "1m30s"), (90_500, "1m31s"), (119_900, "1m60s")])
def test_duration_label(spark, ms, label):
    """One decimal as a fixed-point print of the double gives it, rounded seconds from a minute on."""
    assert one(spark, scalars.format_duration_label(F.lit(ms))) == label


def test_tags_and_categories(spark):
    lit = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    for tags, want in ((["Male speech, man speaking"], "Voice"), (["Metal", "Musical instrument"], "Music"), (["Loud BANG", "Speech"], "Impact"), (["Wind chime", "Explosion"], "Ambient"), (["Metal", "Click"], "Effect"), ([], "Effect")):
        assert one(spark, scalars.sound_category(lit(*tags))) == want
    found = one(spark, scalars.audio_tags(lit("a", "b", "c"), F.array(F.lit(2.0), F.lit(-0.8), F.lit(-0.9))))
    assert [t.label for t in found] == ["a", "b"] and found[0].confidence == pytest.approx(0.8808, abs=1e-4)
    assert len(one(spark, scalars.audio_tags(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: i.cast("string")), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: i.cast("double"))))) == 10
    assert [p[0] for p in scalars.DURATION_PRESETS] == ["< 100ms", "< 1s", "1-10s", "10-60s", "1-5 min", "> 1 min"]
    assert abs(one(spark, scalars.timestamp_now("ms")) / 1000 - one(spark, scalars.timestamp_now())) < 60
    assert one(spark, scalars.duration_category(F.lit(5000))) == "medium" and one(spark, scalars.format_similarity(F.lit(0.126))) == "13%"


def test_node_keys(spark):
    null = F.lit(None).cast("string")
    key = lambda z, p: one(spark, paths.node_key(F.lit("3"), F.lit("a/b"), z, p))
    assert [key(null, null), key(F.lit("z.zip"), null), key(F.lit("z.zip"), F.lit("in/"))] == ["folder:3:a/b", "zip:3:a/b:z.zip", "zip:3:a/b:z.zip:in/"]


def test_image_tags_have_a_threshold_for_each_group(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "asset_id long, embedding array<float>")
    labels = spark.createDataFrame([("style", "pixel", [1.0, 0.0]), ("style", "vector", [0.0, 1.0]), ("content", "tree", [1.0, 0.1]), ("content", "rock", [0.1, 1.0])] + [("quality", f"q{k}", [1.0 - k / 5, k / 5]) for k in range(6)], "group string, label string, embedding array<float>")
    got = {r.asset_id: r for r in vector.image_tags(items, labels).collect()}
    assert got[1].style == "pixel" and got[2].style == "vector" and got[1].tags[:2] == ["tree", "rock"] and got[1].style_confidence == pytest.approx(0.731, abs=1e-3)
    assert len([t for t in got[1].tags if t[0] == "q"]) < 6
    with pytest.raises(ValueError, match="more than"):
        vector.similarity_matrix(items, items.withColumnRenamed("asset_id", "query_id"), most=1)


def test_hybrid_reranks_text_hits_alone(spark):
    text = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7), (4, 0.1)], "id long, score double")
    vectors_ = spark.createDataFrame([(1, [0.0, 1.0]), (3, [1.0, 0.0]), (9, [1.0, 0.0])], "asset_id long, embedding array<float>")
    got = [(r.id, r.score) for r in vector.hybrid(text, vectors_, 1, 9).collect()]
    assert got == [(3, pytest.approx(0.4 * 0.7 + 0.6))]
    assert [r.id for r in vector.hybrid(text, vectors_, 2, 9).collect()] == [3, 1] and [r.id for r in vector.hybrid(text, vectors_, 2).collect()] == [1, 2]


def test_ewma_over_many_parts(spark):
    """A key whose ticks lie in many tasks has the rate of the plain fold."""
    import random

    draw = random.Random(2)
    rows = [(k, i, None if draw.random() < 0.05 else float(draw.choice([0, 0, 3, 8]))) for k in ("a", "b", None) for i in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.k: (r.n, r.rate) for r in work.ewma(spark.createDataFrame(rows, "k string, i int, v double"), "k", ["i"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for k in ("a", "b", None):
        rate = 0.0
        for _, _, v in [r for r in rows if r[0] == k]:
            rate = (v or 0.0) if rate == 0 else 0.9 * rate + 0.1 * (v or 0.0)
        assert got[k] == (400, pytest.approx(rate))


def test_rates_follow_the_reference(spark):
    ticks = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([0, 0, 10, 10])] + [("z", 0, 0.0)], "k string, i int, v double")
    assert {r.k: r.rate for r in work.ewma(ticks, "k", ["i"], "v").collect()} == {"k": pytest.approx(10.0), "z": 0.0}
    events = spark.createDataFrame([("k", 1000 * s) for s in range(20)], "k string, ms long")
    assert {r.rate for r in work.sliding_rate(events.where("ms > 0"), "k", F.col("ms"), F.lit(True)).where("ms >= 5000").collect()} == {1.0}


def test_embed_batches_join_files_of_all_folders(spark, monkeypatch):
    monkeypatch.setattr(work, "SLICE_IDS", 7)
    rows = spark.createDataFrame([(k, k % 9, f"f{k % 4}", None, None) for k in range(70)] + [(100 + k, 1, "", "a.zip", f"x{k}") for k in range(33)], "id long, folder_id long, rel_path string, zip_file string, zip_entry string")
    got = {}
    for r in work.embed_batches(rows).collect():
        got.setdefault((r.group_key, r.batch), []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {(None, 0): list(range(32)), (None, 1): list(range(32, 64)), (None, 2): list(range(64, 70)), ("1/a.zip", 0): list(range(100, 132)), ("1/a.zip", 1): [132]}


def test_hamming_pairs_against_brute_force(spark):
    import random

    draw = random.Random(4)
    values = [draw.getrandbits(64) for _ in range(60)]
    values += [v ^ sum(1 << b for b in draw.sample(range(64), k % 13)) for k, v in enumerate(values)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = sorted((r.a, r.b, r.similarity) for r in duplicates.hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, hash long")).collect())
    want = [(a, b, 1 - d / 64) for a in range(120) for b in range(a + 1, 120) if (d := (values[a] ^ values[b]).bit_count()) < 10]
    assert got == want and len(got) >= 40


def test_small_writers(spark, tmp_path):
    errors = spark.createDataFrame([(7, 1, "image", "old", 3, 1, None)], "id long, asset_id long, category string, error_message string, occurred_at long, retry_count int, resolved_at long")
    failures = spark.createDataFrame([(k % 5, "audio", f"e{k % 3}") for k in range(40)], "asset_id long, category string, error_message string")
    after = mutations.append_errors(errors, failures, 99).collect()
    assert sorted(r.id for r in after) == [7, *range(8, 48)] and {(r.occurred_at, r.retry_count) for r in after if r.id > 7} == {(99, 0)}
    chosen = F.array(F.lit("a"), F.lit("b"))
    assert sorted(one(spark, mutations.toggle(chosen, F.lit("a")))) == ["b"] and sorted(one(spark, mutations.toggle(chosen, F.lit("c")))) == ["a", "b", "c"]
    mutations.compact(failures.repartition(6), str(tmp_path / "c"), 2)
    assert len(spark.read.parquet(str(tmp_path / "c")).inputFiles()) <= 2 and spark.read.parquet(str(tmp_path / "c")).count() == 40
    mutations.export_json(errors, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().error_message == "old"
    folders = spark.createDataFrame([(3, "/a", "A")], "id long, path string, label string")
    assert sorted((r.id, r.path) for r in mutations.upsert_folder(folders, spark.createDataFrame([("/c", "C"), ("/b", "B"), ("/a", "X")], "path string, label string")).collect()) == [(3, "/a"), (4, "/b"), (5, "/c")]


def test_stored_index(spark, tmp_path):
    texts = spark.createDataFrame([(1, "metal hit metal"), (2, "the metal of rights reserved all rights reserved"), (3, "All Rights, reserved!"), (4, None), (5, "rights all")], "id long, text string")
    path = str(tmp_path / "index")
    fulltext.write_index(texts, path, buckets=4)
    for q in ("metal", "all metal absent", "hit"):
        want = {r.id: pytest.approx(r.score) for r in fulltext.bm25(texts, q).collect()}
        assert {r.id: r.score for r in fulltext.bm25_from_index(spark, path, q).collect()} == want
    assert sorted(r.id for r in fulltext.phrase_from_index(spark, path, "all rights reserved").collect()) == [2, 3]
    new = str(tmp_path / "next")
    fulltext.refresh_index(spark, path, new, spark.createDataFrame([(2,), (5,)], "id long"), spark.createDataFrame([(5, "all metal"), (6, "metal metal here")], "id long, text string"))
    after = spark.createDataFrame([(1, "metal hit metal"), (3, "All Rights, reserved!"), (4, None), (5, "all metal"), (6, "metal metal here")], "id long, text string")
    assert {r.id: r.score for r in fulltext.bm25_from_index(spark, new, "all metal").collect()} == {r.id: pytest.approx(r.score) for r in fulltext.bm25(after, "all metal").collect()}
    assert [r.id for r in fulltext.phrase_from_index(spark, path, "metal hit metal").collect()] == [1] and fulltext.bm25_from_index(spark, path, "--").count() == 0


def test_scalars(spark):
    assert [one(spark, scalars.format_file_size(F.lit(n))) for n in (1023, 1024, 1_048_576)] == ["1023 B", "1.0 KB", "1.0 MB"]
    assert one(spark, scalars.format_duration_clock(F.lit(9_999))) == "0:09.999" and one(spark, scalars.format_duration_clock(F.lit(61_000))) == "1:01"
    assert one(spark, scalars.thumbnail_size(F.lit(256), F.lit(192))) == (128, 96) and one(spark, scalars.thumbnail_size(F.lit(64), F.lit(1))) == (64, 1)
    assert one(spark, scalars.parse_category(F.lit("Audio"))) == "audio"
    with pytest.raises(Exception, match="unknown category"):
        one(spark, scalars.parse_category(F.lit("invalid")))
    assert one(spark, scalars.frames_to_ms(F.lit(4410), F.lit(44_100))) == 100
    assert one(spark, scalars.compression_name(F.lit(8))) == "deflate" and one(spark, scalars.compression_name(F.lit(77))) == "unknown"
    assert one(spark, scalars.warnings_json(F.array().cast("array<string>"))) is None
    assert one(spark, scalars.hamming_similarity(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))) == 1 - 2 / 64
    assert one(spark, scalars.format_similarity(F.lit(0.555))) == "56%"
    assert one(spark, scalars.slow_load_ms(F.lit(15 << 20))) == 5000


@pytest.mark.parametrize(("entry", "at"), [("inner.zip/folder/image.png", 9), ("folder/image.png", None), ("archive.zip", None), ("ARCHIVE.ZIP/image.png", 11), ("outer.zip/inner.zip/file.png", 9)])
def test_archive_boundary(spark, entry, at):
    assert one(spark, paths.first_archive_boundary(F.lit(entry))) == at


def test_paths(spark):
    lit = F.lit
    assert one(spark, paths.filesystem_path(lit("D:/Assets"), lit("Packs/textures"), lit("grass.png"))) == "D:/Assets/Packs/textures/grass.png"
    assert one(spark, paths.filesystem_path(lit("D:/Assets"), lit(""), lit("grass.png"))) == "D:/Assets/grass.png"
    assert one(spark, paths.relative_path(lit("D:\\Assets\\Packs\\sfx\\"), lit("D:/Assets"))) == "Packs/sfx"
    assert one(spark, paths.nested_key(lit("o.zip"), lit("a.zip/b.ZIP/x.wav"))) == "o.zip::a.zip/b.ZIP"
    assert one(spark, paths.root_name(lit(""), lit("/data/x"))) == "x"
    args = (lit("Packs/SFX"), lit("s.zip"), lit("v1/loud/hit.wav"))
    assert one(spark, paths.searchable_path(*args)) == "Packs SFX v1 loud"
    assert one(spark, paths.searchable_path(*args, F.array(lit("\0Packs"), lit("s.zip\0v1")))) == "SFX loud"


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    assert one(spark, vectors.dot(a, a)) == 1.0 and one(spark, vectors.dot(a, b)) == 0.0
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0)))) is None
    raw = spark.createDataFrame([([0.1, 0.2, -0.3, 0.4],), (None,)], "v array<float>").select(vectors.decode_vector(vectors.encode_vector("v")).alias("v")).collect()
    assert raw[0].v == pytest.approx([0.1, 0.2, -0.3, 0.4]) and raw[1].v is None
    assert one(spark, vectors.middle(F.sequence(F.lit(1), F.lit(10)), 4)) == [4, 5, 6, 7]


def test_tree_counts_and_the_compat_excess(spark):
    rows = [(1, 1, "p", "z.zip", e, e.split("/")[-1]) for e in ("a/x", "a/b/y", "z")]
    assets = spark.createDataFrame(rows, "id long, folder_id long, rel_path string, zip_file string, zip_entry string, filename string")
    got = {(r.dir_type, r.zip_prefix): (r.direct, r.cumulative, r.compat_cumulative, r.child_count) for r in tree.with_child_counts(tree.nodes(assets)).collect()}
    assert got == {("dir", None): (0, 3, 5, 1), ("zip", None): (3, 3, 5, 1), ("zipdir", "a/"): (1, 2, 2, 1), ("zipdir", "a/b/"): (1, 1, 1, 0)}


def assets_of(spark, rows):
    full = [(i, f, 1, "", z, e, None, "", "audio", "wav", s, t, 0, 0) for i, f, z, e, s, t in rows]
    return spark.createDataFrame(full, struct("assets"))


def test_rescan(spark):
    stored = assets_of(spark, [(1, "a", None, None, 1, 5), (2, "b", None, None, 1, None), (3, "c", None, None, 1, 5), (4, "d", None, None, 1, 5)])
    listed = assets_of(spark, [(0, "a", None, None, 1, 5), (0, "b", None, None, 1, 5), (0, "c", None, None, 2, 5), (7, "e", None, None, 1, 5), (7, "e", None, None, 1, 5)])
    status = {r.entry_key: r.status for r in diff.diff(stored, listed).collect()}
    assert status == {"a": "unchanged", "b": "modified", "c": "modified", "d": "removed", "e": "added"}
    after = {r.id: (r.filename, r.file_size) for r in diff.apply(stored, listed).collect()}
    assert after == {1: ("a", 1), 2: ("b", 1), 3: ("c", 2), 7: ("e", 1)}
    empty = stored.limit(0)
    assert diff.diff(empty, empty).count() == 0
    assert mutations.insert_or_ignore(stored, stored).count() == 4


def test_batches(spark):
    rows = [(k, f"n{k}", "o.zip", f"inner.zip/{k}", 1, 0) for k in range(10)] + [(100 + k, f"m{k}", "p.zip", str(k), 1, 0) for k in range(33)] + [(200, "f", None, None, 1, 0)]
    plan = work.batch_plan(assets_of(spark, rows)).groupBy("kind", "batch").count().collect()
    assert {(r.kind, r.batch): r["count"] for r in plan} == {("nested", 0): 8, ("nested", 1): 2, ("archive", 0): 16, ("archive", 1): 16, ("archive", 2): 1, ("file", 0): 1}
    assert {r.kind: r.staged for r in work.group_order(work.batch_plan(assets_of(spark, rows))).collect()} == {"nested": False, "archive": True, "file": False}


def test_ewma_equals_the_fold(spark):
    ticks = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([10, 0, 5, 5, 20])], "k string, i int, v double")
    rate = 10.0
    for v in (0, 5, 5, 20):
        rate = 0.9 * rate + 0.1 * v
    assert work.ewma(ticks, "k", ["i"], "v").first().rate == pytest.approx(rate)
    assert one(spark, work.eta_seconds(F.lit(100), F.lit(20), F.lit(7.0), F.lit(True))) == 12
    assert one(spark, work.eta_seconds(F.lit(100), F.lit(20), F.lit(7.0), F.lit(False))) is None


def test_thumbnails_and_errors(spark):
    assets = spark.createDataFrame([(i, "image", None) for i in range(1, 6)], "id long, asset_type string, zip_entry string").withColumn("zip_compression", F.lit(None).cast("string"))
    images = spark.createDataFrame([(1, 64, 64, None), (2, 500, 64, None), (3, 500, 64, "t"), (4, None, None, None)], "asset_id long, width int, height int, thumbnail_data string")
    assert sorted(r.id for r in work.needs_thumbnail(assets, images).collect()) == [2, 4, 5]
    errors = spark.createDataFrame([(1, 1, "image", None), (2, 1, "clap", None), (3, 2, "clap", None), (4, 2, "audio", None)], "id long, asset_id long, category string, resolved_at long")
    done = spark.createDataFrame([(1, "image"), (2, "clap")], "asset_id long, category string")
    assert {r.id: r.resolved_at for r in mutations.resolve_errors(errors, done, 9).collect()} == {1: 9, 2: 9, 3: 9, 4: None}


def test_search_page(spark):
    assets = search.with_searchable_path(assets_of(spark, [(1, "b_hit", None, None, 1, 0), (2, "A_hit", None, None, 1, 0), (3, "c_hit", "z.zip", "en/c_hit", 1, 0)]).drop("searchable_path"))
    folders = spark.createDataFrame([(1, "/root")], "id long, path string")
    images, audio = spark.createDataFrame([], struct("image_metadata")), spark.createDataFrame([(1, 500, 1, 1, 0)], struct("audio_metadata"))
    ask = lambda **k: [r.id for r in search.page(assets, folders, images, audio, SearchParams(**k)).orderBy(F.lower("filename")).collect()]
    assert ask(text="hit") == [2, 1, 3]
    assert ask(text="hit", limit=1, offset=1) == [1]
    assert ask(text="hit", min_duration_ms=500, max_duration_ms=500) == [1]
    assert ask(location=FolderLocation(1, "", "z.zip", "en/")) == [3]
    assert ask(location=FolderLocation(1, "e")) == []
    assert ask(extra={"empty_is_none": True}) == []


def test_hamming_and_vector_ties(spark):
    hashes = spark.createDataFrame([(1, 0), (2, 3), (3, -1)], "id long, hash long")
    assert [(r.a, r.b) for r in duplicates.hamming_pairs(hashes, 10).collect()] == [(1, 2)]
    rows = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0])], "asset_id long, embedding array<float>")
    assert [r.asset_id for r in vector.top_k_by_item(rows, 1, 2).collect()] == [1, 2]
    assert [r.asset_id for r in vector.top_k(rows, vector.literal_vector([1.0, 0.0]), 2, exclude_id=1).collect()] == [2, 3]


def test_upserts(spark):
    old = spark.createDataFrame([(1, 5, "t"), (2, 5, None)], "asset_id long, width int, thumbnail_data string")
    new = spark.createDataFrame([(1, 7, "n"), (2, 7, "n"), (3, 7, None)], "asset_id long, width int, thumbnail_data string")
    got = {r.asset_id: (r.width, r.thumbnail_data) for r in mutations.upsert_keep_first(old, new, "asset_id", ["thumbnail_data"]).collect()}
    assert got == {1: (7, "t"), 2: (7, "n"), 3: (7, None)}
    got = {r.asset_id: (r.width, r.thumbnail_data) for r in mutations.fill_missing(old, new, "asset_id", "thumbnail_data").collect()}
    assert got == {1: (5, "t"), 2: (5, "n"), 3: (None, None)}
    with pytest.raises(ValueError):
        mutations.rename_folder(spark.createDataFrame([(1, "a")], "id long, label string"), 2, "b")
