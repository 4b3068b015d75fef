"""Problem 7: the whole corpus as ids of a public byte-level BPE.

Frequent words are compiled into a minimal acyclic automaton whose suffixes are shared and
whose paths are numbered, so that the number of a word leads to its id list. Workers map
the automaton into memory and resolve each distinct word once, all words of a batch in step;
a word it does not hold is merged by rank. Which words are frequent changes the speed only.

Defined results: null text and empty text have the empty list; special-token strings are
ordinary text; every row comes out once, whatever its other columns hold.
"""

from __future__ import annotations

import atexit
import base64
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import lists, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEXICON_WORDS = 32_768
CACHED_WORDS = 400_000
_SENT: set[tuple[str, str]] = set()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank is joined until none is left.

    A heap of pairs over a linked list: n log n, so a word of a million letters ends too.
    """
    import heapq

    if word in ranks:
        return [ranks[word]]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if (a := parts[i]) is None or (j := after[i]) >= len(parts) or len(a) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = a + parts[j], None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (m := after[k]) < len(parts) and (r := ranks.get(parts[k] + parts[m])) is not None:
                heapq.heappush(heap, (r, k, len(parts[k]) + len(parts[m])))
    return [ranks[p] for p in parts if p is not None]


class Lexicon:
    """Minimal acyclic automaton over bytes with numbered paths.

    ``keys`` holds node * 256 + byte of each edge in order, ``to`` its target, ``skip`` the words
    numbered before those behind the edge; ``final`` marks nodes that end a word, ``starts`` and
    ``ids`` the id list of each number.
    """

    PARTS = ("keys", "to", "skip", "final", "starts", "ids")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.__dict__.update(parts)

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """Incremental minimisation over sorted words: the tail that no later word can change is shared."""
        nodes: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []
        last = b""

        def share(down_to: int) -> None:
            while len(path) > down_to:
                parent, byte, child = path.pop()
                shape = (final[child], tuple(nodes[child].items()))
                nodes[parent][byte] = known.setdefault(shape, child)

        order = sorted(words)
        for word in order:
            same = 0
            while same < len(word) and same < len(last) and word[same] == last[same]:
                same += 1
            share(same)
            at = path[-1][2] if path else 0
            for byte in word[same:]:
                nodes.append({})
                final.append(False)
                nodes[at][byte] = child = len(nodes) - 1
                path.append((at, byte, child))
                at = child
            final[at] = True
            last = word
        share(0)

        number = {0: 0}
        queue = [0]
        for old in queue:  # kept nodes, renumbered without gaps
            for child in nodes[old].values():
                if child not in number:
                    number[child] = len(number)
                    queue.append(child)
        below: dict[int, int] = {}
        stack = [0]
        while stack:
            at = stack[-1]
            wait = [c for c in nodes[at].values() if c not in below]
            if wait:
                stack.extend(wait)
            else:
                below[at] = final[at] + sum(below[c] for c in nodes[at].values())
                stack.pop()
        keys, to, skip = [], [], []
        for old in queue:
            before = int(final[old])
            for byte in sorted(nodes[old]):
                child = nodes[old][byte]
                keys.append(number[old] * 256 + byte)
                to.append(number[child])
                skip.append(before)
                before += below[child]
        lengths = [len(words[w]) for w in order]
        return cls(
            {
                "keys": np.array(keys, np.int64),
                "to": np.array(to, np.int32),
                "skip": np.array(skip, np.int32),
                "final": np.array([final[old] for old in queue], np.int8),
                "starts": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
                "ids": np.array([i for w in order for i in words[w]], np.int32),
            }
        )

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The id list of each word, None where the automaton does not hold it; all words walk in step."""
        n = len(words)
        if not n or not len(self.keys):
            return [None] * n
        length = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        node, num = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.flatnonzero(length > 0)
        lost = length == 0
        step = 0
        while len(alive):
            want = node[alive] * 256 + text[begin[alive] + step]
            edge = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[edge] == want
            lost[alive[~ok]] = True
            alive, edge = alive[ok], edge[ok]
            num[alive] += self.skip[edge]
            node[alive] = self.to[edge]
            step += 1
            alive = alive[length[alive] > step]
        lost |= self.final[node] == 0
        a, b = self.starts[num], self.starts[np.minimum(num + 1, len(self.starts) - 1)]
        return [None if lost[i] else self.ids[a[i] : b[i]].tolist() for i in range(n)]

    def pack(self) -> bytes:
        head = np.array([len(getattr(self, p)) for p in self.PARTS], np.int64)
        return head.tobytes() + b"".join(np.ascontiguousarray(getattr(self, p)).tobytes() + b"\0" * (-getattr(self, p).nbytes % 8) for p in self.PARTS)

    @classmethod
    def open(cls, source: str | bytes) -> Lexicon:
        """From packed bytes, or mapped from a file, which all workers of a machine then share."""
        raw = np.frombuffer(source, np.uint8) if isinstance(source, bytes) else np.memmap(source, np.uint8, "r")
        head = raw[: 8 * len(cls.PARTS)].view(np.int64)
        at, parts = 8 * len(cls.PARTS), {}
        for name, size, kind in zip(cls.PARTS, head, (np.int64, np.int32, np.int32, np.int8, np.int64, np.int32)):
            nbytes = int(size) * np.dtype(kind).itemsize
            parts[name] = raw[at : at + nbytes].view(kind)
            at += nbytes + -nbytes % 8
        return cls(parts)


def frequent_words(df: DataFrame, text: str, most: int) -> list[str]:
    """Words that are at least one in ``4 * most`` of all words of all texts, so at most ``4 * most`` of them; no task sends more than it counts.

    The count runs on the JVM and combines before it shuffles.
    """
    words = df.select(F.explode(F.regexp_extract_all(text, F.lit(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    counts = cut(words.where(F.length("w") <= 64).groupBy("w").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    return [r.w for r in counts.where(F.col("count") * (4 * most) >= total).select("w").collect()]


def build_lexicon(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, most: int = LEXICON_WORDS) -> Lexicon:
    ranks = read_ranks(vocabulary)
    words = {w.encode(): [] for w in frequent_words(df, text, most)}
    return Lexicon.compile({w: merge(w, ranks) for w in words})


def publish(spark: SparkSession, packed: bytes, vocabulary: str) -> tuple[str, str]:
    """Names under which every worker finds the automaton and the vocabulary: Spark brings each machine its copies."""
    folder = tempfile.mkdtemp(prefix="lexicon-")  # of the driver, which serves the files as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    lexicon = os.path.join(folder, f"lexicon-{uuid.uuid4().hex}.bin")
    with open(lexicon, "wb") as f:
        f.write(packed)
    spark.sparkContext.addFile(lexicon)
    with open(vocabulary, "rb") as f:
        ranks = os.path.join(folder, f"{xxhash.xxh3_64_hexdigest(f.read())}-{os.path.basename(vocabulary)}")
    sent = (spark.sparkContext.applicationId, os.path.basename(ranks))
    if sent not in _SENT:
        shutil.copyfile(vocabulary, ranks)
        spark.sparkContext.addFile(ranks)
        _SENT.add(sent)
    return os.path.basename(lexicon), os.path.basename(ranks)


class Encoder:
    """Texts to flat ids and a length each; one for each Python worker."""

    _open: dict = {}

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int]):
        self.lexicon, self.ranks = lexicon, ranks
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    @classmethod
    def of(cls, names: tuple[str, str]) -> Encoder:
        """From the names that ``publish`` gave; the automaton is mapped into memory."""
        if names not in cls._open:
            cls._open = {names: cls(Lexicon.open(SparkFiles.get(names[0])), read_ranks(SparkFiles.get(names[1])))}
        return cls._open[names]

    def learn(self, fresh: list[str]) -> None:
        if len(self.known) + len(fresh) > CACHED_WORDS:
            keep = set(fresh)
            self.known = {w: i for w, i in self.known.items() if w in keep}
        spelled = [w.encode("utf-8", "surrogatepass") for w in fresh]
        for w, b, ids in zip(fresh, spelled, self.lexicon.find(spelled)):
            self.known[w] = merge(b, self.ranks) if ids is None else ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words = [self.split(t) if t else [] for t in texts]
        seen = set().union(*words)
        fresh = [w for w in seen if w not in self.known]
        if fresh:
            kept = len(self.known) + len(fresh) <= CACHED_WORDS
            self.learn(fresh if kept else list(seen))
        get = self.known.__getitem__
        parts = [list(chain.from_iterable(map(get, w))) for w in words]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.fromiter(chain.from_iterable(parts), np.int32, int(lengths.sum())), lengths


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(key, ids array<int>) of every row of ``df``, one pass over the texts after the word count."""
    source = publish(df.sparkSession, build_lexicon(df, text, vocabulary, lexicon_words).pack(), vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(source)
        for b in slices(batches):
            ids, lengths = coder.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(key), lists(ids, lengths, pa.int32())], [key, "ids"])

    rows = df.select(key, F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(key, n_tokens bigint) of every row, by the same encoder."""
    source = publish(df.sparkSession, build_lexicon(df, text, vocabulary, lexicon_words).pack(), vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(source)
        for b in slices(batches):
            _, lengths = coder.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(lengths, pa.int64())], [key, "n_tokens"])

    rows = df.select(key, F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_tokens bigint")
