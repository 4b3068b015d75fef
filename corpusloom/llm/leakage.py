"""Problem 5: passages of held-out items inside the texts of the corpus.

Item passages and texts are read as words of letters and digits, in lower case. Every run of
four words of a passage is a pattern. Texts are searched for all patterns at once by the method of
Wu and Manber over words: a table over blocks of two words tells how far the window may jump, a block
that ends a pattern leads to the bucket of patterns with that end, and those are compared. Many
stretches of text are searched in step. A passage of fifteen words of which one in six is changed,
lost or added keeps at least one whole pattern and three near one diagonal; where a text has those
with a passage, the words around are aligned and the errors counted.

A text is the chunks of a document in order; each chunk is searched with the last words of the text before
it, over as many chunks as they come from, what both share counted once, so a passage across cuts is whole.
Documents are dealt to tasks by ranges of document and ordinal, however long they are; where a document goes
on in the next task, the words around that border are searched again as a text of their own. The title and
section heading a chunk begins with are left out there, and searched with the start of the rest apart. Items
are searched in blocks of bounded size, which are broadcast one at a time, so their number is free; a block
changes nothing in what an item matches.

Words that hold a digit (figures, codes) tell items apart: where over a third of a match's differ, only a set phrase is shared.

Defined results: of repeated rows of a chunk the latest by written_at counts; null texts and items without
words match nothing; passages under fifteen words match nothing; a document and an item come out once.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, slots, written
from .common import slices

PASSAGE = 15
ERRORS = 0.18
RUN = 4
TAIL = 60
SPAN = 48
BLOCK_WORDS = 2_000_000
LANES = 2048
#: The spellings of a PubMed id.
PUBMED = r"^\s*(?:(?:pmid|pubmed|medline)\s*(?:id)?\s*[:#=/]?\s*|https?://pubmed\.ncbi\.nlm\.nih\.gov/|https?://(?:www\.)?ncbi\.nlm\.nih\.gov/pubmed/)?0*([1-9][0-9]{0,8})(?:\.[0-9]{1,2})?(?:\.n?xml)?/?\s*$"
_INNER = re.compile(r"[\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,40}>")
_MARKS = re.compile("[\u0300-\u036f]")
_DIGIT = re.compile(r"\d")


def words(text: str) -> list[str]:
    """Words split at white space, lower-cased, letters and digits only, so that no layout matters: tags, entities, marks
    over letters and punctuation outside or within a word are gone; pure punctuation is no word."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return [w if w.isalnum() else x for w in text.split() if w.isalnum() or (x := _INNER.sub("", w))]


class Patterns:
    """Tables of one block of items for the search."""

    def __init__(self, passages: list[tuple[str, str]]):
        self.id: dict[str, int] = {}
        self.pmid, stream, self.at = [], [], []
        for pmid, text in passages:
            w = words(text)
            if len(w) >= PASSAGE:
                self.pmid.append(pmid)
                self.at.append(len(stream))
                stream += [self.id.setdefault(x, len(self.id) + 1) for x in w] + [0] * SPAN  # 0 is no word of any passage
        self.stream = np.array(stream, np.int64)
        self.at = np.array(self.at, np.int64)
        figure = np.zeros(len(self.id) + 1, np.int64)
        figure[[i for w, i in self.id.items() if _DIGIT.search(w)]] = 1
        self.figure = figure[self.stream]  # words that hold a digit
        n = len(self.stream) - RUN + 1
        runs = np.stack([self.stream[k : k + max(n, 0)] for k in range(RUN)]) if n > 0 else np.zeros((RUN, 0), np.int64)
        start = np.flatnonzero((runs > 0).all(axis=0))
        runs = runs[:, start]
        bits = max(12, int(len(start)).bit_length() + 3)
        self.mask = (1 << bits) - 1
        self.shift = np.full(1 << bits, RUN - 1, np.int8)
        for q in range(1, RUN):  # the block of words q - 1 and q of a pattern
            np.minimum.at(self.shift, self.block(runs[q - 1], runs[q]), RUN - 1 - q)
        end = self.block(runs[RUN - 2], runs[RUN - 1])
        order = np.lexsort((start, *runs[::-1], end))
        self.end, self.run, self.start = end[order], runs[:, order], start[order]
        change = np.ones(len(order), bool)
        if len(order):
            change[1:] = (np.diff(self.end) != 0) | (np.diff(self.run, axis=1) != 0).any(axis=0)
        self.first = np.flatnonzero(change)  # each distinct pattern, then its places in the passages
        self.last = np.append(self.first[1:], len(order))
        self.bucket = self.end[self.first]

    _held: tuple = (None, None)

    @classmethod
    def of(cls, shared) -> Patterns:
        """Tables of a broadcast (key, passages), made once by each worker process."""
        key, passages = shared.value
        if cls._held[0] != key:
            cls._held = (key, cls(passages))
        return cls._held[1]

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7_919) & self.mask

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, distinct pattern) of each occurrence; stretches of the text are searched in step."""
        n = len(text)
        if n < RUN or not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = max(RUN * 8, -(-n // LANES))
        at = np.arange(0, n, size) + RUN - 1  # end of each stretch's window
        stop = np.minimum(np.arange(0, n, size) + size + RUN - 1, n)
        found: list[np.ndarray] = []
        live = at < stop
        at, stop = at[live], stop[live]
        while len(at):
            jump = self.shift[self.block(text[at - 1], text[at])].astype(np.int64)
            hit = jump == 0
            found.append(at[hit])
            at = at + np.maximum(jump, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        end = np.concatenate(found)
        block = self.block(text[end - 1], text[end])
        low, high = np.searchsorted(self.bucket, block, "left"), np.searchsorted(self.bucket, block, "right")
        count = high - low  # the bucket of this suffix: each member is compared
        who = np.repeat(np.arange(len(end)), count)
        pattern = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        ok = np.ones(len(who), bool)
        for k in range(RUN):
            ok &= text[end[who] - RUN + 1 + k] == self.run[k, self.first[pattern]]
        return end[who[ok]] - RUN + 1, pattern[ok]

    def leaks(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(text, passage) pairs that hold a passage."""
        get = self.id.get
        size = np.fromiter((len(t) + SPAN for t in texts), np.int64, len(texts))
        begin = np.cumsum(size) - size
        stream = np.full(int(size.sum()), -1, np.int64)
        for a, t in zip(begin.tolist(), texts):
            stream[a : a + len(t)] = [get(w, -1) for w in t]
        pos, pattern = self.search(stream)
        count = self.last[pattern] - self.first[pattern]
        who = np.repeat(np.arange(len(pos)), count)
        place = self.start[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[pattern], count)]
        pos = pos[who]
        row = np.searchsorted(begin, pos, "right") - 1
        passage = np.searchsorted(self.at, place, "right") - 1
        diagonal = pos - place
        order = np.lexsort((pos, diagonal, passage, row))
        row, passage, diagonal, pos, place = row[order], passage[order], diagonal[order], pos[order], place[order]
        if len(row) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = row * len(self.at) + passage
        near = (pair[2:] == pair[:-2]) & (diagonal[2:] - diagonal[:-2] <= 5) & (np.abs(pos[2:] - pos[:-2]) <= SPAN)
        seed = np.flatnonzero(near) + 1
        # one alignment for each stretch of SPAN / 2 words of a pair
        _, one = np.unique(np.stack([pair[seed], pos[seed] // (SPAN // 2), diagonal[seed] // 6]), axis=1, return_index=True)
        seed = seed[one]
        keep = [self.likely(stream, pos[s], place[s]) for s in np.split(seed, range(8192, len(seed), 8192))]
        seed = seed[np.concatenate(keep)]
        good = np.zeros(len(seed), bool)
        for a in range(0, len(seed), 8192):
            s = seed[a : a + 8192]
            good[a : a + 8192] = self.aligned(stream, pos[s], place[s])
        got = np.unique(np.stack([row[seed[good]], passage[seed[good]]]), axis=1)
        return got[0], got[1]

    def likely(self, stream: np.ndarray, pos: np.ndarray, place: np.ndarray, reach: int = 6) -> np.ndarray:
        """What an alignment needs at least: PASSAGE words in a row of the passage of which all but three stand within
        ``reach`` words of their place on the diagonal."""
        half = SPAN // 2
        item = _window(self.stream, place - half, SPAN + RUN)
        text = _window(stream, pos - half - reach, SPAN + RUN + 2 * reach)
        there = np.zeros(item.shape, bool)
        for k in range(2 * reach + 1):
            there |= item == text[:, k : k + SPAN + RUN]
        total = np.cumsum(np.pad(there & (item > 0), ((0, 0), (1, 0))), axis=1)
        return (total[:, PASSAGE:] - total[:, :-PASSAGE] >= PASSAGE - 3).any(axis=1)

    def aligned(self, stream: np.ndarray, pos: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the words around a common pattern align over at least PASSAGE words of the passage with few errors.

        Local alignment, a row of the passage at a time for all cases together, that carries how much of the
        passage an alignment spans, its errors, and its figures, all and missed. Where over a third of the
        figures are missed, only a set phrase is shared, filled with others.
        """
        n, half = len(pos), SPAN // 2
        band = 2 * 8 + 1
        item, figure = _window(self.stream, place - half, SPAN + RUN), _window(self.figure, place - half, SPAN + RUN) == 1
        text = _window(stream, pos - half - 8, SPAN + RUN + band)
        zero = np.zeros((n, band + 2), np.int32)
        above = [zero] * 5  # score, words spanned, errors, figures, figures missed
        done = np.zeros(n, bool)
        for i in range(SPAN + RUN):
            row = [zero.copy() for _ in above]
            word, odd = item[:, i], figure[:, i].astype(np.int32)
            real = word > 0
            for j in range(1, band + 1):
                same = (word == text[:, i + j - 1]) & real
                miss = (~same).astype(np.int32)
                met = [x[:, j] for x in above]
                lost = [x[:, j + 1] for x in above]
                more = [x[:, j - 1] for x in row]
                met = [met[0] + np.where(same, 1, -2), met[1] + 1, met[2] + miss, met[3] + odd, met[4] + odd * miss]
                lost = [lost[0] - 2, lost[1] + 1, lost[2] + 1, lost[3] + odd, lost[4] + odd]
                more = [more[0] - 2, more[1], more[2] + 1, more[3], more[4]]
                up = lost[0] > met[0]
                left = more[0] > np.maximum(met[0], lost[0])
                best = [np.where(left, m, np.where(up, u, d)) for m, u, d in zip(more, lost, met)]
                keep = (best[0] > 0) & real
                for x, y in zip(row, best):
                    x[:, j] = np.where(keep, y, 0)
                _, span, bad, odds, missed = best
                done |= same & keep & (span >= PASSAGE) & (bad <= ERRORS * span) & (3 * missed <= odds)
            above = row
        return done


def _window(x: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    at = start[:, None] + np.arange(size)[None, :]
    inside = (at >= 0) & (at < len(x))
    return np.where(inside, x[np.where(inside, at, 0)], -2)


def joined(before: list[str], now: list[str]) -> list[str]:
    """The end of the chunk before and this chunk; words both share are kept once."""
    for k in range(min(len(before), len(now)), 3, -1):
        if before[-k:] == now[:k]:
            return before[:-k] + now
    return before + now


def passage_text(title: str, section: str) -> F.Column:
    """The chunk's text without the title and the section heading it begins with; the rest of the text is what it begins with."""
    body = F.col("text")
    for c in (title, section):
        lead = F.coalesce(F.col(c), F.lit(""))
        body = F.when((lead != "") & body.startswith(lead), F.ltrim(F.regexp_replace(F.substr(body, F.length(lead) + 1), r"^\s+", ""))).otherwise(body)
    return body


def in_order(chunks: DataFrame) -> DataFrame:
    """(document_id, ordinal, chunk_id, text, lead), sorted, in partitions of ranges of document and ordinal: chunks with their title and section heading apart."""
    rows = chunks.where(F.col("document_id").isNotNull() & F.col("text").isNotNull()).select("document_id", "chunk_id", "ordinal", "written_at", F.col("text").alias("whole"), passage_text("title", "section").alias("text"))
    rows = rows.withColumn("lead", F.substr("whole", F.lit(1), F.length("whole") - F.length("text"))).drop("whole")
    order = ["document_id", F.col("ordinal").asc_nulls_last()]
    return rows.repartitionByRange(slots(chunks.sparkSession), *order).sortWithinPartitions(*order, "chunk_id", F.col("written_at").desc_nulls_last()).drop("written_at")


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Passages of the items in blocks of bounded size, one at a time."""
    parts = F.flatten(F.array(F.array("question"), F.coalesce("contexts", F.array().cast("array<string>")), F.array("long_answer")))
    each = items.where(F.col("pmid").isNotNull()).select("pmid", F.explode(parts).alias("passage")).where(F.col("passage").isNotNull()).distinct().orderBy("pmid", "passage")
    block, room = [], BLOCK_WORDS
    for r in each.toLocalIterator():
        block.append((r.pmid, r.passage))
        room -= len(r.passage.split())
        if room <= 0:
            yield block
            block, room = [], BLOCK_WORDS
    if block:
        yield block


def _matches(tables: Patterns, whose: list[str], texts: list[list[str]]) -> tuple[list[str], list[str]]:
    row, passage = tables.leaks(texts)
    found = {(whose[r], tables.pmid[p]) for r, p in zip(row.tolist(), passage.tolist())}
    return [d for d, _ in found], [p for _, p in found]


_FOUND = "document_id string, pmid string, part int, head string, next_id string, tail string"


def _read(shared):
    """Sorted chunks of one task to its matches (document_id, pmid) and, last, its border: the first document with its first
    words, the last one with its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Patterns.of(shared)
        first = chunk = document = None
        head: list[str] = []
        tail: list[str] = []
        for b in slices(batches):
            whose, texts = [], []
            for d, c, text, lead in zip(*(b.column(x).to_pylist() for x in ("document_id", "chunk_id", "text", "lead"))):
                if d == document and c is not None and c == chunk:
                    continue  # an earlier row of the chunk
                if d != document:
                    tail = []
                document, chunk = d, c
                w = words(text)
                now = joined(tail, w)
                whose.append(d)
                texts.append(now)
                if first is None:
                    first = d
                if d == first and len(head) < TAIL:
                    head = (head + now[len(tail) :] if now[: len(tail)] == tail else joined(head, w))[:TAIL]
                tail = now[-TAIL:]
                if lead:
                    whose.append(d)
                    texts.append(words(lead + text[: TAIL * 12]))
            ids, pmids = _matches(tables, whose, texts)
            none = pa.nulls(len(ids), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pmids, pa.string()), pa.nulls(len(ids), pa.int32()), none, none, none], [f.split()[0] for f in _FOUND.split(", ")])
        if first is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"document_id": first, "pmid": None, "part": part, "head": " ".join(head), "next_id": document, "tail": " ".join(tail)}], pa.schema([(n, pa.int32() if k == "int" else pa.string()) for n, k in (f.split() for f in _FOUND.split(", "))]))

    return run


def _borders(shared):
    """Borders in order, a row a task of ``_read``, to the matches across them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Patterns.of(shared)
        document, tail = None, []
        whose, texts = [], []
        for b in batches:
            for r in b.to_pylist():
                head = r["head"].split()
                if r["document_id"] == document:
                    whose.append(document)
                    texts.append(joined(tail, head))
                    if r["next_id"] == document and len(head) < TAIL:  # the whole task holds less than a tail
                        tail = texts[-1][-TAIL:]
                        continue
                document, tail = r["next_id"], r["tail"].split()
        ids, pmids = _matches(tables, whose, texts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pmids, pa.string())], ["document_id", "pmid"])

    return run


def by_text(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """(document_id, pmid): documents whose chunks hold a passage of an item."""
    spark = chunks.sparkSession
    read = in_order(chunks)
    blocks = _blocks(items)
    block, following = next(blocks, None), next(blocks, None)
    if following is not None:
        read = cut(read)  # sorted once for all blocks
    out = spark.createDataFrame([], "document_id string, pmid string")
    while block is not None:
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))  # about BLOCK_WORDS words
        found = written(read.mapInArrow(_read(shared), _FOUND))
        between = found.where("part is not null").select("document_id", "head", "next_id", "tail", "part").repartition(1).sortWithinPartitions("part")  # a row a task
        across = written(between.mapInArrow(_borders(shared), "document_id string, pmid string"))
        out = out.unionByName(found.where("pmid is not null").select("document_id", "pmid")).unionByName(across)
        shared.destroy()
        block, following = following, next(blocks, None)
    return out


def by_external_id(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(document_id, pmid): documents whose external_id is an item's id, written as a PubMed id."""
    named = documents.where(F.col("document_id").isNotNull()).select("document_id", F.regexp_extract(F.lower("external_id"), PUBMED, 1).alias("pmid")).where(F.col("pmid") != "")
    return named.join(items.select("pmid").distinct(), "pmid").select("document_id", "pmid")


def leaked(chunks: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    return by_text(chunks, items).unionByName(by_external_id(documents, items)).distinct()
