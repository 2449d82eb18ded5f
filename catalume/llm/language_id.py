"""Language ID: unigram piece models over a fixed public vocabulary, summed over all segmentations.

P(word | language) is the sum over every way to cut the word into vocabulary pieces (and
single bytes, as a fallback) of the product of the pieces' probabilities: one forward
pass. The probabilities are fitted by expectation maximisation, whose E-step is the same
forward pass with a backward one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm import kernels as K

#: Distinct labelled texts a language from which the model is fitted: the bound on what comes to the driver.
SAMPLE_DOCS = 150
ROUNDS = 3
#: Bytes up to which a word's scaled sums fit a double; longer words are summed in logarithms, and the fit cuts them here.
WORD_BYTES = 64
#: Words that are summed at once, which bounds a worker's memory.
STEP_WORDS = 5_000
#: Scaled sums below this are taken again in logarithms.
FLOOR = 1e-200
#: Every piece's probability is scaled by this to the power of its length, against underflow.
SCALE = 16.0
CACHE_WORDS = 400_000
#: Words of one block of the fit: what bounds the driver's memory.
LEARN_WORDS = 8_000
_BITS = 20

_SOLID = ~K.SPACE
_MARK = "▁".encode()


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model as bytes, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).encode() for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)})


@dataclass
class Model:
    """Piece probabilities, one row a piece and one column a language; pieces and words are told apart by the kernels' 61-bit hashes."""

    languages: list[str]
    prior: np.ndarray
    known: np.ndarray
    probability: np.ndarray
    lengths: list[int]
    hit: np.ndarray = field(init=False)
    cache: K.Memo = field(init=False, default_factory=K.Memo)
    scores: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.hit = np.zeros(1 << _BITS, bool)
        self.hit[self.known >> np.uint64(64 - _BITS)] = True
        self.scores = np.zeros((1024, len(self.languages)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": K.Memo(), "scores": np.zeros((1024, len(self.languages)))}

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(end positions, piece lengths, pieces) of all pieces in the words, by the place of the end in its word (from 1)."""
        prefix, n = K.prefix_hashes(data), len(data)
        size = np.diff(offsets)
        inside = np.arange(n) - np.repeat(offsets[:-1], size)
        ends, lengths, pieces = [], [], []
        for length in self.lengths:
            end = np.flatnonzero(inside >= length - 1) + 1
            h = K.span_hashes(prefix, end - length, end)
            maybe = self.hit[h >> np.uint64(64 - _BITS)]
            end, h = end[maybe], h[maybe]
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            same = self.known[at] == h
            ends.append(end[same])
            pieces.append(at[same])
            lengths.append(np.full(int(same.sum()), length))
        end, length, piece = (np.concatenate(x) for x in (ends, lengths, pieces))
        place = inside[end - 1] + 1
        order = np.argsort(place, kind="stable")
        end, length, piece = end[order], length[order], piece[order]
        bounds = np.searchsorted(place[order], np.arange(1, int(size.max(initial=0)) + 2))
        return [(end[a:b], length[a:b], piece[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]

    def forward(self, data: np.ndarray, offsets: np.ndarray, edges: list) -> np.ndarray:
        """Scaled forward sums at every position: row offsets[w] + w + i after i bytes of word w."""
        word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        alpha = np.zeros((len(data) + len(offsets) - 1, len(self.languages)))
        alpha[offsets[:-1] + np.arange(len(offsets) - 1)] = 1.0
        scale = SCALE ** np.arange(self.lengths[-1] + 1)
        for end, length, piece in edges:
            if len(end):
                row = end + word[end - 1]
                own = alpha[row - length] * (self.probability[piece] * scale[length][:, None])
                order = np.argsort(row, kind="stable")
                row, own = row[order], own[order]
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                alpha[row[first]] = np.add.reduceat(own, first)
        return alpha

    def forward_logs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each word from forward sums in logarithms, which no length of word can underflow."""
        word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        begin, logs = offsets[:-1] + np.arange(len(offsets) - 1), np.log(self.probability)
        alpha = np.full((len(data) + len(offsets) - 1, len(self.languages)), -np.inf)
        alpha[begin] = 0.0
        for end, length, piece in self.edges(data, offsets):
            if len(end):
                row = end + word[end - 1]
                own = alpha[row - length] + logs[piece]
                order = np.argsort(row, kind="stable")
                row, own = row[order], own[order]
                fresh = np.concatenate(([True], row[1:] != row[:-1]))
                first = np.flatnonzero(fresh)
                most = np.maximum.reduceat(own, first)
                alpha[row[first]] = most + np.log(np.add.reduceat(np.exp(own - most[np.cumsum(fresh) - 1]), first))
        return alpha[offsets[1:] + np.arange(len(offsets) - 1)]

    def log_probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each word in each language.

        Short words are summed with scaled probabilities, and again in logarithms where that comes
        near to what a double holds: over WORD_BYTES bytes the scaling gains at most a factor
        of 10^80, so a sum over FLOOR has lost nothing to underflow on its way.
        """
        out, size = np.empty((len(offsets) - 1, len(self.languages))), np.diff(offsets)
        short = size <= WORD_BYTES + len(_MARK)
        for rows, logs in ((np.flatnonzero(short), False), (np.flatnonzero(~short), True)):
            for lo in range(0, len(rows), STEP_WORDS):
                own = rows[lo : lo + STEP_WORDS]
                part, at = data[K.ranges(offsets[own], size[own])], np.concatenate(([0], np.cumsum(size[own])))
                if logs:
                    out[own] = self.forward_logs(part, at)
                else:
                    alpha = self.forward(part, at, self.edges(part, at))[at[1:] + np.arange(len(own))]
                    out[own] = np.log(np.maximum(alpha, FLOOR)) - (size[own] * np.log(SCALE))[:, None]
                    faint = own[(alpha < FLOOR).any(1)]
                    if len(faint):
                        out[faint] = self.forward_logs(data[K.ranges(offsets[faint], size[faint])], np.concatenate(([0], np.cumsum(size[faint]))))
        return out

    def learn(self, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> None:
        """Expectation maximisation from the words' counts in each language, by blocks of words of like length."""
        size = np.diff(offsets)
        order = np.argsort(size, kind="stable")
        data, counts = data[K.ranges(offsets[:-1][order], size[order])], counts[order]
        offsets = np.concatenate(([0], np.cumsum(size[order])))
        for _ in range(rounds):
            expected = np.full_like(self.probability, 1e-2)
            for lo in range(0, len(order), LEARN_WORDS):
                hi = min(len(order), lo + LEARN_WORDS)
                self.expect(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], counts[lo:hi], expected)
            self.probability = expected / expected.sum(0)

    def expect(self, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, expected: np.ndarray) -> None:
        """Adds the expected counts of all pieces in a block of words: a forward and a backward pass."""
        word, scale = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), SCALE ** np.arange(self.lengths[-1] + 1)
        edges = self.edges(data, offsets)
        total = offsets[1:] + np.arange(len(offsets) - 1)
        alpha = self.forward(data, offsets, edges)
        beta = np.zeros_like(alpha)
        beta[total] = counts / np.maximum(alpha[total], 1e-300)
        for end, length, piece in reversed(edges):
            if len(end):
                row = end + word[end - 1]
                back = beta[row] * (self.probability[piece] * scale[length][:, None])
                used, at = np.unique(piece, return_inverse=True)
                for k in range(len(self.languages)):
                    expected[used, k] += np.bincount(at, alpha[row - length, k] * back[:, k], len(used))
                    beta[:, k] += np.bincount(row - length, back[:, k], len(beta))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-probability of each whole text in each language; each distinct word is scored once for as long as it is remembered."""
        if len(self.cache) > CACHE_WORDS:
            self.cache = K.Memo()
        starts, ends, first = solid_words(data, offsets)
        if not len(starts):
            return np.zeros((len(offsets) - 1, len(self.languages)))
        unique, at, inverse = np.unique(K.span_hashes(K.prefix_hashes(data), starts, ends), return_index=True, return_inverse=True)
        slot = self.cache.get(unique)
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = np.arange(len(self.cache), len(self.cache) + len(new))
            self.cache.add(unique[new])
            while len(self.scores) < len(self.cache):
                self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.scores[slot[new]] = self.log_probability(*with_mark(data, starts[at[new]], ends[at[new]]))
        own = self.scores[slot[inverse]]
        total = np.concatenate((np.zeros((1, own.shape[1])), np.cumsum(own, 0)))
        return total[first[1:]] - total[first[:-1]]


def solid_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space."""
    return K.words(data, offsets, _SOLID)


def parts(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, those over WORD_BYTES in parts of that many bytes, and the number of each part's word."""
    count = np.maximum(1, -(-(ends - starts) // WORD_BYTES))
    word = np.repeat(np.arange(len(starts)), count)
    begin = starts[word] + (np.arange(len(word)) - (np.cumsum(count) - count)[word]) * WORD_BYTES
    return begin, np.minimum(begin + WORD_BYTES, ends[word]), word


def with_mark(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, each after the vocabulary's word mark, with offsets."""
    size = ends - starts + len(_MARK)
    offsets = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(offsets[-1], np.uint8)
    for k, b in enumerate(_MARK):
        out[offsets[:-1] + k] = b
    out[K.ranges(offsets[:-1] + len(_MARK), ends - starts)] = data[K.ranges(starts, ends - starts)]
    return out, offsets


def fit(labelled: DataFrame, vocabulary_file: str, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from rows with text and non-null lang; every other row is ignored.

    About `sample_docs` distinct texts a language are used, chosen by a hash of the text
    against the (approximate) number of its distinct texts, so what comes to the driver
    (their distinct words' counts) does not grow with the table, copies weigh no more than
    one text, and a language of few texts is used whole. Words over WORD_BYTES are learnt
    in parts. Without any labelled text the model knows no language.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    stats = {r.lang: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts")).collect()}
    sizes = {lang: r.n for lang, r in stats.items()}
    languages = sorted(sizes)
    known_bytes = vocabulary(vocabulary_file)
    flat_bytes, at = np.frombuffer(b"".join(known_bytes), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in known_bytes])))
    known = np.unique(K.span_hashes(K.prefix_hashes(flat_bytes), at[:-1], at[1:]))
    prior = np.log(np.array([sizes[x] for x in languages], float) / max(1, sum(sizes.values())))
    model = Model(languages, prior, known, np.full((len(known), len(languages)), 1 / len(known)), sorted({len(p) for p in known_bytes}))
    if not languages:
        return model
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_docs / max(1, stats[lang].texts)))])
    sample = rows.where((F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0) < share[F.col("lang")]).dropDuplicates(["lang", "text"])

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        codes = batch.column(1).to_pylist()
        for lo, hi, data, offsets in K.slices(batch.column(0)):
            starts, ends, first = solid_words(data, offsets)
            starts, ends, word = parts(starts, ends)
            text = np.repeat(np.arange(hi - lo), np.diff(first))[word].tolist()
            raw = data.tobytes()
            yield {"lang": [codes[lo + k] for k in text], "word": pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())}

    words = K.map_batches(sample, ["text", "lang"], count, "lang string, word binary").groupBy("lang", "word").count().toPandas()
    if not len(words):
        return model
    codes, unique = words["word"].map(bytes).factorize()
    counts = np.zeros((len(unique), len(languages)))
    np.add.at(counts, (codes, words["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy()), words["count"].to_numpy())
    joined, ends = np.frombuffer(b"".join(unique), np.uint8), np.cumsum([len(w) for w in unique])
    model.learn(*with_mark(joined, np.concatenate(([0], ends[:-1])), ends), counts)
    return model


def _decide(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The language's number (-1: undetermined) and its posterior probability for each text."""
    best, score = [], []
    for lo, hi, data, offsets in K.slices(column):
        total = model.score(data, offsets) + model.prior if model.languages else np.zeros((hi - lo, 1))
        total -= total.max(1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(1, keepdims=True)
        k = p.argmax(1)
        ascii_letter = np.zeros(256, bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        letters = K.sums(ascii_letter[data], offsets) > 0
        wide = K.sums(data >= 128, offsets) > 0
        for i in np.flatnonzero(~letters & wide).tolist():
            letters[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
        keep = letters & bool(model.languages)
        best.append(np.where(keep, k, -1))
        score.append(np.where(keep, p[np.arange(len(k)), k], 0.0))
    return (np.concatenate(best), np.concatenate(score)) if best else (np.zeros(0, int), np.zeros(0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the posterior probability) of every whole text.

    lang_pred is `und`, with score 0, for null texts, texts without a letter, and models
    that know no language. Ties go to the first language by name; repeated rows give
    repeated results; other columns are ignored.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        k, score = _decide(kept.value, batch.column(1))
        names = pa.array([*model.languages, "und"], pa.string())
        yield {"doc_id": batch.column(0), "lang_pred": names.take(pa.array(np.where(k < 0, len(names) - 1, k))), "score": score}

    return K.map_batches(docs, ["doc_id", "text"], run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs, with all their columns, whose language is determined with a posterior probability of at least `least`."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def keep(column: pa.Array) -> np.ndarray:
        k, score = _decide(kept.value, column)
        return (k >= 0) & (score >= least)

    return K.filter_rows(docs, "text", keep)
