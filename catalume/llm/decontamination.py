"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows.

The items' windows are made and made distinct in tasks. A table of them within BROADCAST_BYTES,
which is measured on the table itself, is broadcast as sorted hashes with the words that verify
a hit. A larger one stays a table: the documents' windows that a bitmap of fixed size lets
through are joined with it by their hashes, and the same words verify the same hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm import kernels as K
from catalume.llm.common import written

#: Bytes of the table of windows up to which it is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Bits of the bitmap that lets windows of documents through to the join: a broadcast of 2 MB whatever the benchmark.
BITMAP_BITS = 24
#: Tasks over which the join deals each window of the benchmark, as one passage may be in a third of all documents.
SALTS = 16
_CHUNKS = 64
_TABLE_BITS = 20
#: Columns of the shuffled way: a key of each row, and its candidate windows.
_ROW, _HITS = "__decontamination_row", "__decontamination_hits"

#: What a scan finds in a slice of texts: first word of each text, whether each word is hit, (first word, items) of the verified windows, words' starts and ends.
Found = tuple[np.ndarray, np.ndarray, list[tuple[int, list[str]]], np.ndarray, np.ndarray]


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(size, h, words, items): each distinct window of n words, or of a whole item of fewer (but not none), with the ids of its items as strings; null reads "None"."""

    def scan(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, data, offsets in K.slices(batch.column(1)):
            low = K.LOWER[data]
            starts, ends, first = K.words(low, offsets)
            raw, h = low.tobytes(), K.span_hashes(K.prefix_hashes(low), starts, ends)
            count = np.diff(first)
            text = np.repeat(np.arange(hi - lo), count)
            for size in np.unique(np.minimum(count, n)).tolist():
                if not size:
                    continue
                at = np.arange(len(h) - size + 1)
                at = at[(text[at] == text[at + size - 1]) & ((count[text[at]] == size) | (size == n))]
                words = [b" ".join(raw[a:b] for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist())) for i in at.tolist()]
                yield {"size": np.full(len(at), size, np.int32), "h": K.windows(h, size)[at].view(np.int64), "words": pa.array(words, pa.binary()), "item": batch.column(0).slice(lo, hi - lo).take(pa.array(text[at]))}

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("item"), "text")
    each = K.map_batches(named, ["item", "text"], scan, "size int, h bigint, words binary, item string")
    return each.groupBy("size", "h", "words").agg(F.collect_set("item").alias("items"))


class WindowTable:
    """The windows as arrays: sorted hashes that propose, words that verify, and the items of each."""

    def __init__(self, table: pa.Table) -> None:
        table = table.combine_chunks().sort_by([("h", "ascending")]) if table.num_rows else table
        self.h = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(self.h, kind="stable")  # as unsigned numbers
        self.h = self.h[order]
        table = table.take(pa.array(order))
        self.size = table.column("size").to_numpy()
        self.words = table.column("words").cast(pa.large_binary()).combine_chunks()
        self.items = table.column("items").combine_chunks()
        self.sizes = np.unique(self.size).tolist()
        self.hit = np.zeros(1 << _TABLE_BITS, bool)
        self.hit[self.h >> np.uint64(64 - _TABLE_BITS)] = True

    def __getstate__(self) -> dict:
        # Arrow arrays travel as one stream, so that what is sent is what they hold.
        sink = pa.BufferOutputStream()
        table = pa.table([self.words, self.items], ["words", "items"])
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "items", "hit")} | {"stream": sink.getvalue().to_pybytes()}

    def __setstate__(self, state: dict) -> None:
        table = pa.ipc.open_stream(state.pop("stream")).read_all().combine_chunks()
        self.__dict__.update(state, words=table.column(0).combine_chunks(), items=table.column(1).combine_chunks())
        self.hit = np.zeros(1 << _TABLE_BITS, bool)
        self.hit[self.h >> np.uint64(64 - _TABLE_BITS)] = True

    def candidates(self, hashes: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, size, entry) of the windows whose hash and size are in the table."""
        for size in self.sizes:
            own = K.windows(hashes, size)
            at = np.flatnonzero(self.hit[own >> np.uint64(64 - _TABLE_BITS)])
            at = at[text[at] == text[at + size - 1]] if len(at) else at
            entry = np.searchsorted(self.h, own[at])
            for i, e in zip(at.tolist(), entry.tolist()):
                while e < len(self.h) and self.h[e] == own[i]:
                    if self.size[e] == size:
                        yield i, size, e
                    e += 1

    def find(self, data: np.ndarray, offsets: np.ndarray, _: pa.Array | None) -> Found:
        low, starts, ends, first, hashes, text = _parts(data, offsets)
        return _verified(low, starts, ends, first, ((i, size, self.words[e].as_buffer(), self.items[e]) for i, size, e in self.candidates(hashes, text)))


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, words' starts and ends, first word of each text, hashes of the words, and each word's text."""
    low = K.LOWER[data]
    starts, ends, first = K.words(low, offsets)
    return low, starts, ends, first, K.span_hashes(K.prefix_hashes(low), starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def _verified(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, proposed: Iterator[tuple]) -> Found:
    """What is left of the proposed (first word, size, words, items) when the words are compared."""
    cover = np.zeros(len(starts) + 1, np.int64)
    found = []
    for i, size, words, items in proposed:
        if b" ".join(low[a:b].tobytes() for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist())) == bytes(words):
            found.append((i, items.as_py() if isinstance(items, pa.Scalar) else items))
            cover[i] += 1
            cover[i + size] -= 1
    return first, np.cumsum(cover)[:-1] > 0, found, starts, ends


def _find_joined(data: np.ndarray, offsets: np.ndarray, hits: pa.Array) -> Found:
    """As WindowTable.find, from the candidate windows that the join has put beside each text."""
    low = K.LOWER[data]
    starts, ends, first = K.words(low, offsets)
    proposed = ((int(first[k]) + h["at"], h["size"], h["words"], h["items"]) for k, own in enumerate(hits.to_pylist()) for h in own or ())
    return _verified(low, starts, ends, first, proposed)


def _bitmap(table: DataFrame) -> np.ndarray:
    """Which leading BITMAP_BITS bits the windows' hashes have, put together in tasks by chunks of the bitmap."""
    step = (1 << BITMAP_BITS) // _CHUNKS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITMAP_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS)] = True
        used = [c for c in range(_CHUNKS) if bits[c * step : c * step + step].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(bits[c * step : c * step + step]).tobytes() for c in used], pa.binary())], ["chunk", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, np.uint8)
                whole[c] = own | whole[c] if c in whole else own
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([x.tobytes() for x in whole.values()], pa.binary())], ["chunk", "bits"])

    out = np.zeros(1 << BITMAP_BITS, bool)
    for r in table.select("h").mapInArrow(partial, "chunk int, bits binary").repartition(_CHUNKS, "chunk").mapInArrow(merged, "chunk int, bits binary").collect():
        out[r.chunk * step : r.chunk * step + step] = np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    return out


def _joined(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs with a column of candidate windows, by an equi-join on hashes.

    Each row has a key of its own, so null and repeated doc_ids are rows like all others; the
    rows are written, so that the key is the same wherever it is read.
    """
    keyed = written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "decontamination-rows")
    sizes = [r.size for r in table.select("size").distinct().collect()]
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(table)))

    def scan(batch: pa.RecordBatch) -> Iterator[dict]:
        known = np.unpackbits(bits.value).astype(bool)
        for lo, hi, data, offsets in K.slices(batch.column(1)):
            _, _, _, first, hashes, text = _parts(data, offsets)
            for size in sizes:
                own = K.windows(hashes, size)
                at = np.flatnonzero(known[own >> np.uint64(64 - BITMAP_BITS)])
                at = at[text[at] == text[at + size - 1]] if len(at) else at
                yield {"row": batch.column(0).slice(lo, hi - lo).take(pa.array(text[at])), "at": (at - first[text[at]]).astype(np.int32), "size": np.full(len(at), size, np.int32), "h": own[at].view(np.int64)}

    own = K.map_batches(keyed, [_ROW, "text"], scan, "row bigint, at int, size int, h bigint").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    dealt = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # A row's candidates are no more than its own windows.
    hits = own.join(dealt, ["size", "h", "salt"]).groupBy(F.col("row").alias(_ROW)).agg(F.collect_list(F.struct("at", "size", "words", "items")).alias(_HITS))
    return keyed.join(hits, _ROW, "left").select(*docs.columns, _HITS)


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, output: Callable[[pa.RecordBatch, list[tuple]], pa.RecordBatch], schema) -> DataFrame:
    """`output` of each batch of docs and of what was found in its slices of texts; the way of finding depends on the size of the table of windows."""
    table = written(windows(benchmark, n), "benchmark-windows")
    size = table.agg(F.coalesce(F.sum(F.octet_length("words") + 32 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8)), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        kept = docs.sparkSession.sparkContext.broadcast(WindowTable(table.toArrow()))
        find = lambda *x: kept.value.find(*x)
    else:
        docs, find = _joined(docs, table), _find_joined
    shuffled = _HITS in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hits = batch.column(batch.num_columns - 1) if shuffled else None
            batch = batch.select(batch.schema.names[:-1]) if shuffled else batch
            texts = batch.column(batch.schema.get_field_index("text"))
            yield output(batch, [(data, offsets, *find(data, offsets, hits.slice(lo, hi - lo) if shuffled else None)) for lo, hi, data, offsets in K.slices(texts)])

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """What each document shares with the benchmark: doc_id, n_words, n_hit, item_ids (sorted strings), contaminated.

    A word is hit if it lies inside any occurrence of an item's window. Null or empty text has
    no words; null item_id reads "None"; repeated rows, and rows of null or repeated doc_id,
    are scanned each; other columns are ignored. The result is the same whether the windows
    are broadcast or joined.
    """

    def output(batch: pa.RecordBatch, slices: list[tuple]) -> pa.RecordBatch:
        items: list[list[str]] = []
        words, hits = [], []
        for _, _, first, hit, found, _, _ in slices:
            own: list[set[str]] = [set() for _ in range(len(first) - 1)]
            for at, ids in found:
                own[int(np.searchsorted(first, at, "right")) - 1].update(ids)
            items += [sorted(x) for x in own]
            words.append(np.diff(first))
            hits.append(K.sums(hit, first))
        n_hit = np.concatenate(hits)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words)), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "item_ids", "contaminated"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _scanned(docs.select("doc_id", "text"), benchmark, n, output, f"doc_id {kind}, n_words bigint, n_hit bigint, item_ids array<string>, contaminated boolean")


def _without_hits(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The texts without everything from a run's first hit byte to its last."""
    keep = np.ones(len(data) + 1, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        for i in range(int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b, "left"))):
            x, y = max(a, first[i]), min(b, first[i + 1])
            if x < y:
                keep[starts[x] : ends[y - 1]] = 0
    return [data[a:b][keep[a:b] > 0].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """docs, with all their columns, without the contaminated documents or (remove="spans") without the hit words' spans.

    With "spans" a text loses everything from a run's first hit byte to its last; null stays
    null, and all rows stay. With "documents" rows of null text stay.
    """

    def clean(batch: pa.RecordBatch, slices: list[tuple]) -> pa.RecordBatch:
        return batch.filter(pa.array(np.concatenate([K.sums(hit, first) == 0 for _, _, first, hit, _, _, _ in slices])))

    def cut(batch: pa.RecordBatch, slices: list[tuple]) -> pa.RecordBatch:
        where = batch.schema.get_field_index("text")
        texts = [t for data, offsets, first, hit, _, starts, ends in slices for t in _without_hits(data, offsets, first, hit, starts, ends)]
        texts = [t if valid else None for t, valid in zip(texts, batch.column(where).is_valid().to_pylist())]
        return batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))

    return _scanned(docs, benchmark, n, clean if remove == "documents" else cut, docs.schema)
