"""Requests as a stream, and writes by slices."""

from __future__ import annotations

import pandas as pd

from catalume.plans import kept_queries
from catalume.plans import queries as Q
from catalume.plans.kept_queries import request_messages
from catalume.streaming import progress


def state():
    return {"pending": [], "taken": [], "loaded": 0, "failed": 0}


def test_the_stack():
    s = state()
    take = lambda n, seq=0: progress.folded_requests(s, [(seq, "take", [], n)])[0]
    play = lambda *m: progress.folded_requests(s, [(0, a, ids, 0) for a, ids in m])
    play(("request", [1, 2, 3]), ("request", [2, 4]))
    assert take(2) == (0, [4, 3], 2, 2, 0, 0)  # the latest first, 2 keeps its place
    play(("request", [4, 5]))
    assert s["pending"] == [1, 2, 5] and s["taken"] == [4, 3]  # 4 is being worked on
    play(("cancel", [2, 3, 9]), ("request", [3, 2]))
    assert s["pending"] == [1, 5, 3, 2] and s["taken"] == [4]
    play(("done", [4, 4, 5]), ("fail", [1]))
    assert (s["loaded"], s["failed"], s["taken"]) == (1, 0, [])
    assert take(-1)[1] == [] and take(9) == (0, [2, 3, 5, 1], 0, 4, 1, 0)
    play(("fail", [1, 2]), ("nothing", [7]))
    assert s["failed"] == 2
    play(("clear", []))
    assert s == state()


def test_the_stream_plays_the_same_messages(spark):
    events = request_messages(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).collect()
    want = []
    for user in {r.user_id for r in events}:
        rows = sorted(((r.seq, r.action, r.ids, r.n) for r in events if r.user_id == user))
        want += [(user, seq, ",".join(map(str, ids)), *rest) for seq, ids, *rest in progress.folded_requests(state(), rows)]
    got = [tuple(r) for r in Q.queries()["stream_requests"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want) and len({r[2] for r in got}) > 5


def test_state_goes_over_micro_batches(spark, tmp_path):
    rows = [(1, 1, "request", [5, 6], None), (1, 2, "take", None, 1), (2, 3, "request", [7], None)]
    later = [(1, 4, "take", [None], 5), (2, 5, "take", [], 5), (3, 6, "take", [], 5)]
    schema = "s long, seq long, action string, ids array<long>, n int"
    for k, part in enumerate((rows, later)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = progress.request_stack(stream, "s").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {(r.s, r.seq): (r.ids, r.queued, r.processing) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 2): ([6], 1, 1), (1, 4): ([5], 0, 2), (2, 5): ([7], 0, 1), (3, 6): ([], 0, 0)}


def test_a_bad_row_fails_alone(spark, tmp_path):
    out = str(tmp_path / "files")
    (tmp_path / "files").mkdir()

    def write(frame: pd.DataFrame, name: str) -> None:
        if (frame["v"] < 0).any():
            raise ValueError("negative")
        frame.to_csv(f"{out}/{name}.csv", index=False)

    rows = spark.createDataFrame([(k, -1 if k in (3, 40, 41) else k) for k in range(100)], "k long, v long").coalesce(1)
    for _ in range(2):  # a repeated attempt stores nothing twice
        got = {r.k: r.error for r in progress.write_slices(rows, "k", write, "b0", 16).collect()}
    assert {k for k, e in got.items() if e} == {3, 40, 41} and set(got) == set(range(100)) and got[3] == "negative"
    files = [pd.read_csv(f) for f in (tmp_path / "files").iterdir()]
    assert sorted(k for f in files for k in f["k"]) == [k for k in range(100) if k not in (3, 40, 41)]
    assert max(map(len, files)) == 16
    assert progress.write_slices(rows.limit(0), "k", write, "b1").count() == 0


def test_a_bad_row_costs_few_writes_and_a_task_one_file(spark, tmp_path):
    """Of 64 rows with a bad one, 63 were written one by one before."""
    tried = spark.sparkContext.accumulator(0)

    def write(frame: pd.DataFrame, name: str) -> None:
        tried.add(1)
        if (frame["k"] == 41).any():
            raise ValueError("bad")

    rows = spark.range(128).withColumnRenamed("id", "k").coalesce(1)
    assert [r.k for r in progress.write_slices(rows, "k", write, "b").collect() if r.error] == [41]
    assert tried.value == 2 + 2 * 6
    sink = kept_queries._Refusing(str(tmp_path / "rows"), most_slices=3)
    for _ in range(2):  # a repeated attempt stores nothing twice
        got = progress.write_slices(spark.range(1000).withColumnRenamed("id", "event_id").repartition(3, "event_id"), "event_id", sink, "b").collect()
    bad = set(range(7, 1000, 101))
    assert {r.event_id for r in got if r.error == "refused"} == bad and len(got) == 1000
    assert sorted(f.name for f in (tmp_path / "rows").iterdir()) == ["b-0.parquet", "b-1.parquet", "b-2.parquet"]
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == [k for k in range(1000) if k not in bad]
