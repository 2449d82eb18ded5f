"""Work that is cut into parts: pairs by blocks, windows over ranges, medians by passes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalume.operators import similarity_join as J
from catalume.operators import work


def vectors(spark, draw, clusters, each, dim=16, noise=0.02):
    centres = draw.normal(size=(clusters, dim))
    rows = [(k * each + i, [float(x) for x in c + noise * draw.normal(size=dim)], int(k % 2)) for k, c in enumerate(centres) for i in range(each)]
    return rows


def brute(rows, threshold):
    best = {}
    for i, v, label in rows:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            key = (label, tuple(np.float32(v).tolist()))
            n, least = best.get(key, (0, i))
            best[key] = (n + 1, min(least, i))
    own = [(i, label, np.array(v) / np.linalg.norm(v), n) for (label, v), (n, i) in best.items()]
    out = {}
    for x in own:
        for y in own:
            if x[0] < y[0] and x[1] == y[1] and len(x[2]) == len(y[2]) and x[2] @ y[2] >= threshold:
                out[x[0], y[0]] = (round(float(x[2] @ y[2]), 6), x[3], y[3])
    return out


@pytest.mark.parametrize("threshold", [0.98, 0.6, 0.0, -1.0])
def test_cosine_pairs(spark, monkeypatch, threshold):
    draw = np.random.default_rng(2)
    rows = vectors(spark, draw, 6, 8)
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.1], [3.0], [-3.0]]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)]
    rows += [(2000 + k, rows[0][1], 0) for k in range(7)] + [(3000, rows[5][1], None), (3001, rows[6][1], None), rows[3]]
    monkeypatch.setattr(J, "PIVOT_ROWS", 7)
    items = spark.createDataFrame(rows, "asset_id long, embedding array<double>, kind_ int")
    got = {(r.a, r.b): (round(r.similarity, 6), r.n_a, r.n_b) for r in J.cosine_pairs(items, threshold, "kind_", block_rows=5).collect()}
    assert got == brute(rows, threshold)
    classes = {r.asset_id: r.representative for r in J.representatives(items, "kind_").collect()}
    assert classes[2006] == 0 and classes[3001] == 3001 and 1000 not in classes


def test_pairs_prune_clustered_vectors(spark, monkeypatch):
    """Pairs compared are under a tenth of all."""
    draw = np.random.default_rng(3)
    rows = vectors(spark, draw, 40, 50, dim=32)
    monkeypatch.setattr(J, "PIVOT_ROWS", 10)
    items = spark.createDataFrame([(i, v, 0) for i, v, _ in rows], "asset_id long, embedding array<double>, t int")
    base = J.distinct_vectors(items, "t").cache()
    plan = J.block_pairs(J.placed(base, 0.95, J._pivots(base, 1024)), 64)
    # A block has a chunk's share of its ring's rows.
    share = lambda n: n / F.ceil(n / 64)
    itself = F.when((F.col("ring") == F.col("ring2")) & (F.col("chunk") == F.col("chunk2")), 0.5).otherwise(1.0)
    compared = plan.agg(F.sum(itself * share(F.col("rows")) * share(F.col("rows2")))).first()[0]
    assert compared < len(rows) ** 2 / 2 / 10
    assert J.cosine_pairs(items, 0.95, "t").count() == len(brute([(i, v, 0) for i, v, _ in rows[:50]], 0.95)) * 40
    assert J.cosine_pairs(items.limit(0), 0.9, "t").count() == 0


@pytest.fixture
def many_parts(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def ticks(spark):
    draw = np.random.default_rng(5)
    rows = [(int(draw.choice([1, 1, 1, 2, 3])), int(draw.integers(0, 5000)), k, None if k % 17 == 0 else float(draw.integers(0, 100)), bool(draw.integers(2))) for k in range(3000)]
    rows += [(None, 10 * k, 5000 + k, float(k % 7), True) for k in range(50)] + [(4, None, 6000, 1.0, True)]
    return spark.createDataFrame(rows, "key int, ms long, id long, v double, ok boolean").repartition(3)


def test_ticks_of_one_key_are_many_tasks(spark, ticks, many_parts):
    cut = work._cut(ticks, "key", ["ms", "id"])
    parts = {r["__part"]: r["count"] for r in cut.where("key = 1").groupBy("__part").count().collect()}
    assert len(parts) > 1 and max(parts.values()) < 1500
    got = {r.id: r.delta for r in work.tick_delta(ticks, "key", ["ms", "id"], "v").collect()}
    own = {}
    for r in sorted(ticks.collect(), key=lambda r: (str(r.key), r.ms if r.ms is not None else -1, r.id)):
        before = own.get(r.key)
        # Of null and a number Spark's greatest takes the number.
        assert got[r.id] == max(0.0, r.v - (before or 0.0)) if r.v is not None else got[r.id] == 0.0, r
        own[r.key] = r.v
    assert work.tick_delta(ticks.limit(0), "key", ["ms", "id"], "v").count() == 0


def test_running_totals_and_rates(spark, ticks, many_parts):
    rows = ticks.where("v is not null and ms is not null").collect()
    total = {}
    want = {}
    for r in sorted(rows, key=lambda r: (r.ms, r.id)):
        total[r.key] = want[r.id] = total.get(r.key, 0.0) + r.v
    got = {r.id: r.t for r in work.running_total(ticks.where("v is not null and ms is not null"), "key", ["ms", "id"], "v", "t").collect()}
    assert got == pytest.approx(want)
    rates = {r.id: r.rate for r in work.sliding_rate(ticks, "key", F.col("ms"), F.col("ok"), 1).collect()}
    every = ticks.collect()
    for r in every:
        if r.ms is None:
            assert rates[r.id] is None
        else:
            assert rates[r.id] == sum(o.ok for o in every if o.key == r.key and o.ms is not None and r.ms - 1000 < o.ms <= r.ms)


def test_medians(spark, monkeypatch):
    monkeypatch.setattr(work, "SELECT_ROWS", 20)
    monkeypatch.setattr(work, "SELECT_BUCKETS", 8)
    draw = np.random.default_rng(6)
    inf, nan = float("inf"), float("nan")
    own = {
        "even": draw.normal(size=400).tolist(), "odd": draw.lognormal(0, 6, 401).tolist(), "same": [3.0] * 90, "two": [1.0] * 50 + [2.0] * 50, "one": [5.0], "none": [None, None],
        "inf": [-inf] * 3 + [1.0, 2.0] + [inf] * 4, "nan": [1.0, nan, nan], "wide": [10.0**k for k in range(-150, 150)], None: [4.0, None, 8.0],
    }
    rows = [(k, v) for k, values in own.items() for v in values]
    df = spark.createDataFrame(rows, "key string, v double").repartition(4)
    got = {r.key: r for r in work.timing_stats(df, "key", "v").collect()}
    want = {r.key: r for r in df.groupBy("key").agg(F.count("*").alias("n"), F.median("v").alias("median")).collect()}
    assert {k: (r.n, repr(r.median)) for k, r in got.items()} == {k: (r.n, repr(r.median)) for k, r in want.items()}
    assert work.medians(df.limit(0), "key", "v").count() == 0


def test_pivots_that_prune_nothing_are_left_out(spark, monkeypatch):
    """Random vectors at a low threshold were copied into half of all cells; clustered ones keep their cells."""
    monkeypatch.setattr(J, "PIVOT_ROWS", 10)
    draw = np.random.default_rng(4)
    rows = [(k, v, 0) for k, v in enumerate(draw.normal(size=(600, 64)).tolist())]
    base = J.distinct_vectors(spark.createDataFrame(rows, "asset_id long, embedding array<double>, t int"), "t").cache()
    pivots = J._pivots(base, 1024)
    assert J.placed(base, 0.25, pivots).count() > 5 * len(rows)
    assert J.placed(base, 0.25, J._worthwhile(base, 0.25, pivots)).count() == len(rows)
    near = [(i, v, 0) for i, v, _ in vectors(spark, draw, 30, 20, dim=32)]
    base = J.distinct_vectors(spark.createDataFrame(near, "asset_id long, embedding array<double>, t int"), "t").cache()
    pivots = J._pivots(base, 1024)
    assert sum(len(n) for n, _ in J._worthwhile(base, 0.95, pivots).values()) > 10


def test_matrices_by_blocks_equal_the_column_expression(spark, monkeypatch):
    """More queries than one array could hold before; odd vectors as `cosine` has them."""
    from catalume.functions.vectors import cosine
    from catalume.operators import duplicates, vector

    draw = np.random.default_rng(8)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [1.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(k, v, k % 2) for k, v in enumerate([*odd, *draw.normal(size=(30, 3)).tolist()])] + [(90, [1.0, 2.0, 3.0], None), (91, [1.0, 2.0, 3.0], None)]
    items = spark.createDataFrame(rows, "asset_id long, embedding array<float>, label int").repartition(3)
    asked = items.where("asset_id % 3 <> 1").select(F.col("asset_id").alias("query_id"), F.col("embedding").alias("e2"), F.col("label").alias("l2"))
    plain = items.crossJoin(asked).withColumn("similarity", cosine(F.col("embedding"), F.col("e2"))).cache()
    shown = lambda v: "null" if v is None else "nan" if np.isnan(v) else round(v, 9)
    monkeypatch.setattr(vector, "BLOCK_ROWS", 4)
    got = {(r.asset_id, r.query_id): shown(r.similarity) for r in vector.similarity_matrix(items, asked.withColumnRenamed("e2", "embedding")).collect()}
    assert got == {(r.asset_id, r.query_id): shown(r.similarity) for r in plain.collect()}
    want = plain.where("label = l2 and asset_id <> query_id and similarity >= 0.2")
    pairs = duplicates.same_type_pairs(items, items.where("asset_id % 3 <> 1"), 0.2)
    assert sorted((r.probe_id, r.asset_id, shown(r.similarity)) for r in pairs.collect()) == sorted((r.query_id, r.asset_id, shown(r.similarity)) for r in want.collect())
    many = spark.range(10_001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert vector.similarity_matrix(items.limit(2), many).count() == 20_002
    assert vector.similarity_matrix(items, many.limit(0)).count() == 0 and vector.similarity_matrix(items.limit(0), many).count() == 0


def test_postings_are_made_without_a_shuffle(spark):
    from catalume.functions.text import word_tokens
    from catalume.operators import fulltext

    texts = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "b Ä-a b b"), (5, "c")], "id long, text string").repartition(2)
    postings, lengths = fulltext._index_rows(texts, "text", "id")
    assert "Aggregate" not in postings._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for r in texts.select("id", word_tokens(F.col("text")).alias("t")).collect():
        for k, w in enumerate(r.t or []):
            want.setdefault((w, r.id, len(r.t)), []).append(k)
    assert {(r.token, r.id, r.length): r.places for r in postings.collect()} == want
    assert postings.count() == len(want) and lengths.count() == texts.select(F.explode(F.array(word_tokens(F.col("text"))))).count()
