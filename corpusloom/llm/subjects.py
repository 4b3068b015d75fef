"""Problem 9: the subject areas of each text.

Words are the mean of an embedding of their own and of embeddings of their subwords, hashed into a
fixed table; a passage is the mean of its words, weighted by how far the word's use differs between
subjects; each subject has an independent logistic output. The model is trained on texts reviewed by
hand, split over partitions: in each round every partition computes the gradient of its passages, the
gradients are summed and one step is taken for all. As all outputs are linear in the words, a word's
share in each output is computed once, and a sentence costs one look-up a word. Every
sentence of every text is given to each subject whose own output says so, to several, one or none, with some weight to
what that output says of the text as a whole; a text has each subject that is given at least ``SHARE`` of its sentences.

Bounds: at most ``MOST_SAMPLE`` reviewed texts are fitted; the table has 2 * BUCKETS rows.

Defined results: null and empty texts and texts without running sentences (no sentence of four words with
a known one among them) give no row; a repeated doc_id gives the rows of each of its texts, each once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import repaired
from .common import slices

BUCKETS = 1 << 13
WIDTH = 24
ROUNDS = 40
RATE = 0.05
DECAY = 1e-4
PARTS = 4
MOST_SAMPLE = 20_000
UNKNOWN = 0.1
SHARE = 0.2
LEAN = 0.5
YES = -1.4  # a logistic output of a fifth
LEAST_WORDS = 4
MOST_WORDS = 45
CACHED = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")
_MARKS = re.compile("[̀-ͯ]")


def fold(text: str) -> str:
    """Lower case, entities and mis-decoded letters put right, marks over letters off."""
    if "&" in text:
        text = html.unescape(text)
    return text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", repaired(text).lower()))


def sentences(text: str) -> list[list[str]]:
    """Words of each running sentence; one of unusual length, as in text that lost its full stops, is cut into equal parts."""
    out = []
    for s in _SENTENCE.split(fold(text)):
        w = _WORD.findall(s)
        if len(w) > MOST_WORDS:
            parts = -(-len(w) // 20)
            out += [w[len(w) * i // parts : len(w) * (i + 1) // parts] for i in range(parts)]
        elif len(w) >= LEAST_WORDS:
            out.append(w)
    return out


def features(word: str) -> list[int]:
    """Rows of the table: the word's own, then those of its subwords of five letters, ends marked."""
    out = [xxhash.xxh32_intdigest(word) % BUCKETS]
    if len(word) > 3:
        marked = f"<{word}>"
        out += [BUCKETS + xxhash.xxh32_intdigest(marked[i : i + 5], 1) % BUCKETS for i in range(len(marked) - 4)]
    return out


def word_weights(examples: list[tuple[str, list[int]]], subjects: int) -> dict[str, float]:
    """How far a word's use tells subjects apart: its divergence from the common use of subjects, shrunk where the word is rare."""
    use: dict[str, np.ndarray] = {}
    for text, own in examples:
        y = np.zeros(subjects)
        y[own] = 1 / max(1, len(own))
        for w in {w for s in sentences(text) for w in s}:
            use[w] = use.get(w, 0) + y
    if not use:
        return {}
    prior = sum(use.values())
    prior = (prior + 1e-6) / (prior + 1e-6).sum()
    out = {}
    for w, u in use.items():
        p = (u + prior) / (u.sum() + 1)
        out[w] = max(0.02, float((p * np.log(p / prior)).sum() / np.log(max(2, subjects))))
    return out


class Passages:
    """Passages of one partition as flat index arrays, for gradients."""

    _held: dict = {}

    def __init__(self, rows: list[tuple[str, list[int]]], weights: dict[str, float], subjects: int):
        passages: list[tuple[list[str], list[int]]] = []
        for text, own in rows:
            found = sentences(text)
            if len(own) == 1:
                passages += [(s, own) for s in found]
            if found:
                passages.append(([w for s in found for w in s], own))
        words: dict[str, int] = {}
        flat = [words.setdefault(w, len(words)) for p, _ in passages for w in p]
        self.n = len(passages)
        self.word = np.array(flat, np.int64)
        size = np.array([len(p) for p, _ in passages], np.int64)
        self.start, self.of = np.cumsum(size) - size, np.repeat(np.arange(self.n), size)
        rows_of = [features(w) for w in words]
        self.count = np.array([len(f) for f in rows_of], np.int64)
        self.feature = np.array([i for f in rows_of for i in f], np.int64)
        self.fstart, self.fof = np.cumsum(self.count) - self.count, np.repeat(np.arange(len(words)), self.count)
        weight = np.array([weights.get(w, UNKNOWN) for p, _ in passages for w in p], np.float32)
        if self.n:
            self.share = (weight / np.add.reduceat(weight, self.start)[self.of])[:, None]
        self.y = np.zeros((self.n, subjects), np.float32)
        for i, (_, own) in enumerate(passages):
            self.y[i, own] = 1

    @classmethod
    def of_rows(cls, rows: list[tuple[str, list[int]]], weights: dict[str, float], subjects: int) -> Passages:
        key = xxhash.xxh3_64_intdigest(repr(rows))
        if key not in cls._held:
            cls._held = {key: cls(rows, weights, subjects)} if len(cls._held) > 8 else cls._held | {key: cls(rows, weights, subjects)}
        return cls._held[key]

    def gradient(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = np.add.reduceat(table[self.feature], self.fstart, axis=0) / self.count[:, None]
        h = np.add.reduceat(u[self.word] * self.share, self.start, axis=0)
        g = 1 / (1 + np.exp(-(h @ out + bias))) - self.y
        back = (g @ out.T)[self.of] * self.share
        gu = _sum_rows(len(self.count), self.word, back) / self.count[:, None]
        return _sum_rows(len(table), self.feature, gu[self.fof]), h.T @ g, g.sum(0)


def _sum_rows(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(at, rows[:, k], n) for k in range(rows.shape[1])], 1).astype(np.float32)


def fit(sample: DataFrame, text: str = "text", subjects: str = "subjects") -> dict:
    """The model of (text, subjects) rows, by full gradients summed over the partitions of the sample."""
    spark = sample.sparkSession
    usable = sample.where(F.col(text).isNotNull() & (F.size(subjects) > 0)).select(F.col(text).alias("text"), F.col(subjects).alias("subjects"))
    rows = usable.orderBy(F.xxhash64("text"), "text").limit(MOST_SAMPLE).collect()
    names = sorted({s for r in rows for s in r.subjects if s})
    n = len(names)
    examples = [(r.text, sorted({names.index(s) for s in r.subjects if s})) for r in rows]
    if not n:
        return {"names": [], "weights": {}, "table": np.zeros((2 * BUCKETS, WIDTH), np.float32), "out": np.zeros((WIDTH, 0), np.float32), "bias": np.zeros(0, np.float32)}
    weights = word_weights(examples, n)
    shared = spark.sparkContext.broadcast(weights)  # words of at most MOST_SAMPLE texts
    parts = min(PARTS, max(1, len(examples) // 50))
    split = spark.createDataFrame([(k, [e for e in examples[k::parts]]) for k in range(parts)], "k int, rows array<struct<text: string, own: array<int>>>").repartitionByRange(parts, "k")
    rng = np.random.default_rng(9)
    params = [rng.normal(0, 0.1, (2 * BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.1, (WIDTH, n)).astype(np.float32), np.full(n, -2, np.float32)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, ROUNDS + 1):
        now = spark.sparkContext.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for held in b.column("rows").to_pylist():
                    p = Passages.of_rows([(r["text"], r["own"]) for r in held], shared.value, n)
                    if p.n:
                        table, out, bias = p.gradient(*now.value)
                        touched = np.flatnonzero(table.any(axis=1)).astype(np.int32)
                        yield pa.RecordBatch.from_pydict({"n": [p.n], "rows": [touched.tobytes()], "table": [table[touched].tobytes()], "out": [out.astype(np.float32).tobytes()], "bias": [bias.astype(np.float32).tobytes()]})

        sums, total = [np.zeros_like(p) for p in params], 0
        for r in split.mapInArrow(run, "n long, rows binary, table binary, out binary, bias binary").collect():  # one row a partition, of the table's size at most
            total += r.n
            sums[0][np.frombuffer(r.rows, np.int32)] += np.frombuffer(r.table, np.float32).reshape(-1, WIDTH)
            sums[1] += np.frombuffer(r.out, np.float32).reshape(WIDTH, n)
            sums[2] += np.frombuffer(r.bias, np.float32)
        now.unpersist()
        if not total:
            break
        for p, g, m, v, decay in zip(params, sums, mean, square, (DECAY / 100, DECAY, 0)):
            g = g / total + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return {"names": names, "weights": weights, "table": params[0], "out": params[1], "bias": params[2]}


class Scorer:
    """Outputs of sentences by each word's weighted share in every output."""

    def __init__(self, model: dict):
        self.m, self.n = model, len(model["names"])
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.share = np.zeros((4096, self.n + 1), np.float32)

    def learn(self, words: list[str]) -> None:
        while len(self.at) + len(words) > len(self.share):
            self.share = np.concatenate([self.share, np.zeros_like(self.share)])
        for w in words:
            weight = self.m["weights"].get(w, UNKNOWN)
            k = self.at[w] = len(self.at)
            self.share[k, : self.n] = weight * (self.m["table"][features(w)].mean(axis=0) @ self.m["out"])
            self.share[k, self.n] = weight

    def subjects(self, texts: list[str | None]) -> list[list[str]]:
        known = self.m["weights"]
        found = [[s for s in sentences(t) if any(w in known for w in s)] if t else [] for t in texts]
        words = {w for f in found for s in f for w in s}
        if len(self.at) + len(words) > CACHED:
            self.reset()
        self.learn([w for w in words if w not in self.at])
        size = np.fromiter((len(s) for f in found for s in f), np.int64)
        if not len(size):
            return [[] for _ in texts]
        index = np.fromiter(map(self.at.__getitem__, (w for f in found for s in f for w in s)), np.int64, int(size.sum()))
        sums = np.add.reduceat(self.share[index], np.cumsum(size) - size, axis=0)
        z = sums[:, :-1] / sums[:, -1:] + self.m["bias"]
        out, a = [], 0
        for f in found:
            b = a + len(f)
            out.append(self.assign(z[a:b]))
            a = b
        return out

    def assign(self, z: np.ndarray) -> list[str]:
        """Subjects that are given their share of the sentences. Each output decides for itself, leaning on what it says of the whole text."""
        if not len(z):
            return []
        given = (z + LEAN * z.mean(axis=0) >= YES).sum(axis=0)
        return [self.m["names"][k] for k in np.flatnonzero(given >= SHARE * len(z))]


def subjects(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, subject): one row for each subject of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the table and the words of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value["names"] else None
        for b in slices(batches):
            if scorer:
                got = scorer.subjects(b.column("text").to_pylist())
                n = np.fromiter(map(len, got), np.int64, len(got))
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(np.repeat(np.arange(len(got)), n))), pa.array([s for g in got for s in g], pa.string())], [key, "subject"])

    rows = docs.select(key, F.col(text).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, subject string")


def find_subjects(docs: DataFrame, sample: DataFrame) -> DataFrame:
    return subjects(docs, fit(sample))
