"""Streams of assets, requests and progress ticks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import nullcontext

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def chunks(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 32) -> DataFrame:
    """A stream of parquet chunks in bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def write_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Hands each micro-batch to `sink` (states that change take mode "update"); a restart from the checkpoint goes on after the last finished batch."""
    writer = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _marked(events: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark on ts, for which it has to be a timestamp with a time zone; tables need none."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, n, total) by event-time windows; what is later than `late` is dropped on streams."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _marked(events, late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events without a longer gap."""
    out = _marked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_requests(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests with each id once within the watermark."""
    return _marked(requests, late).dropDuplicatesWithinWatermark(["id"]) if requests.isStreaming else requests.dropDuplicates(["id"])


def ewma_stream(ticks: DataFrame, key: str, order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """(key, n, rate) after each micro-batch: the moving average is the state of its key, ticks are folded in order; a rate of 0 takes the next value."""
    kind = ticks.schema[key].dataType.simpleString()

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, rate = state.get if state.exists else (0, 0.0)
        for v in pd.concat(list(frames)).sort_values(order)[value]:
            rate = float(v) if rate == 0 else (1 - alpha) * rate + alpha * float(v)
            n += 1
        state.update((n, rate))
        yield pd.DataFrame({key: [name[0]], "n": [n], "rate": [rate]})

    return ticks.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n bigint, rate double", "n bigint, rate double", "update", GroupStateTimeout.NoTimeout)


#: Rows of a write, and how often what has come is written.
FLUSH_ROWS, FLUSH_EVERY = 64, "100 milliseconds"


def write_slices(rows: DataFrame, key: str, write: Callable[[pd.DataFrame, str], None], name: str, size: int = FLUSH_ROWS) -> DataFrame:
    """(key, error) of rows handed to `write` in slices of at most `size`; a slice that fails is halved again and again, so a bad row fails alone.

    `write` runs in tasks and gets a slice and its name, which is the same when a task or a
    micro-batch is repeated (for equal input), so that it can put the slice in place of an earlier attempt. A slice
    that has failed has stored nothing that counts: `write` is all or nothing.

    If `write` has a method `opened`, a task calls it with its own name and gives its slices
    to what the context holds; the context ends when the task's rows have, and then stores
    them, so that a task can make one file of many slices.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        with write.opened(f"{name}-{part}") if hasattr(write, "opened") else nullcontext(write) as put:
            for frame in frames:
                errors: list[str | None] = [None] * len(frame)
                for lo in range(0, len(frame), size):
                    label = f"{name}-{part}-{n}"
                    n += 1
                    left = [(lo, min(lo + size, len(frame)), label)]
                    while left:
                        a, b, own = left.pop()
                        try:
                            put(frame.iloc[a:b], own)
                        except Exception as e:
                            if b - a == 1:  # the row's own failure
                                errors[a] = str(e) or type(e).__name__
                            else:
                                middle = (a + b) // 2
                                left += [(middle, b, f"{label}-{middle - lo}-{b - lo}"), (a, middle, f"{label}-{a - lo}-{middle - lo}")]
                yield pd.DataFrame({key: frame[key].to_numpy(), "error": pd.Series(errors, dtype=object)})

    return rows.mapInPandas(run, f"{key} {kind}, error string")


def flushed(stream: DataFrame, key: str, write: Callable[[pd.DataFrame, str], None], outcome: str, checkpoint: str, every: str | None = FLUSH_EVERY, size: int = FLUSH_ROWS) -> StreamingQuery:
    """Writes a stream's rows by `write_slices` when `size` have come or `every` has passed; what became of each row is stored under `outcome`.

    A micro-batch repeated from the checkpoint has the names of the first attempt. Without
    `every` what is there is written and the query ends.
    """

    def flush(rows: DataFrame, batch: int) -> None:
        write_slices(rows, key, write, f"batch-{batch}", size).write.mode("overwrite").parquet(f"{outcome}/batch={batch}")

    return write_batches(stream, flush, checkpoint, every)


def folded_requests(state: dict, messages: list[tuple]) -> list[tuple]:
    """Plays messages (seq, action, ids, n) against a session's state and gives a row for each `take`: (seq, ids, queued, processing, loaded, failed).

    state has pending (ids, the latest last), taken, loaded and failed. request: ids that are
    neither pending nor taken come on top, in their order. cancel: ids leave both, and may be
    asked for again. take: up to n ids from the top are taken. done and fail: taken ids leave
    and are counted; others are ignored. clear: all is as in the beginning.
    """
    out = []
    pending, taken = dict.fromkeys(state["pending"]), dict.fromkeys(state["taken"])
    for seq, action, ids, n in messages:
        if action == "request":
            pending.update(dict.fromkeys(i for i in ids if i not in pending and i not in taken))
        elif action == "cancel":
            for i in ids:
                pending.pop(i, None)
                taken.pop(i, None)
        elif action in ("done", "fail"):
            ended = [i for i in dict.fromkeys(ids) if i in taken]
            for i in ended:
                del taken[i]
            state["loaded" if action == "done" else "failed"] += len(ended)
        elif action == "clear":
            pending, taken = {}, {}
            state["loaded"] = state["failed"] = 0
        elif action == "take":
            batch = [pending.popitem()[0] for _ in range(min(max(0, n), len(pending)))]
            taken.update(dict.fromkeys(batch))
            out.append((seq, batch, len(pending), len(taken), state["loaded"], state["failed"]))
    state["pending"], state["taken"] = list(pending), list(taken)
    return out


_TAKES = "seq bigint, ids array<bigint>, queued int, processing int, loaded bigint, failed bigint"


def request_stack(messages: DataFrame, key: str, idle_ms: int | None = None) -> DataFrame:
    """(key, seq, ids, queued, processing, loaded, failed): the batches that workers take from each session's stack of requests, see `folded_requests`.

    messages: key, seq (the order inside a key and micro-batch), action, ids and n. A stack
    lives as the state of its key and, with `idle_ms`, is forgotten after that time without a
    message (for queries that go on; one that ends when all is read waits for its timers).
    Null ids and actions of another name count as nothing.
    """
    kind = messages.schema[key].dataType.simpleString()
    columns = ["seq", "ids", "queued", "processing", "loaded", "failed"]

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending, taken, loaded, failed = state.get if state.exists else ([], [], 0, 0)
        own = {"pending": list(pending), "taken": list(taken), "loaded": loaded, "failed": failed}
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        played = [(int(s), a, [int(i) for i in (ids if ids is not None else []) if i == i and i is not None], 0 if n != n or n is None else int(n)) for s, a, ids, n in zip(rows["seq"], rows["action"], rows["ids"], rows["n"])]
        found = folded_requests(own, played)
        state.update((own["pending"], own["taken"], own["loaded"], own["failed"]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if found:
            yield pd.DataFrame(found, columns=columns).assign(**{key: name[0]})[[key, *columns]]

    held = "pending array<bigint>, taken array<bigint>, loaded bigint, failed bigint"
    return messages.select(key, "seq", "action", "ids", "n").groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {_TAKES}", held, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


class Latest:
    """Latest wins: a newer query of the same name cancels the one that runs."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.version = spark, name, 0

    def run(self, action: Callable[[], object]) -> object | None:
        """The action's result, or None if a newer one has come meanwhile."""
        if self.version:
            self.spark.interruptTag(f"{self.name}-{self.version}")
        self.version += 1
        own = self.version
        self.spark.addTag(f"{self.name}-{own}")
        try:
            out = action()
        finally:
            self.spark.removeTag(f"{self.name}-{own}")
        return out if own == self.version else None
