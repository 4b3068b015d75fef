"""Problem 6: oversized texts into pieces under a limit, cut at natural boundaries, with overlap.

A token is a maximal run of A-Z, a-z, 0-9, or any other single code point except space, tab, CR
and LF. A boundary is the number of tokens before it. Where a piece ends at boundary e, the next
begins ``overlap`` tokens earlier, so the farthest legal end after e is the farthest boundary up to
e + limit - overlap. That successor is found for every boundary of every text by one window over the
boundaries; the successor tables are then squared (joined with themselves), and the set of
reached ends, which starts with the virtual end ``overlap``, doubles with each table, until it has
every greedy cut. The number of joins is the logarithm of the pieces of the longest text.

Natural boundaries are ends of paragraphs, lines and sentences. Where none lies in reach, the cut
falls after ``limit - overlap`` tokens; a token is never divided.

Defined results: null and empty texts and texts within the limit give no pieces; of a repeated
document_id the latest row by ingested_at counts; rows without document_id are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, written
from .common import latest, lists, slices

LIMIT = 510
OVERLAP = 64
#: Fixed value: a token, as the size limit counts it.
TOKEN = r"[A-Za-z0-9]+|[^ \t\r\n]"
_TOKENS = re.compile(TOKEN)
_BREAKS = re.compile(r"(?<=[.!?。！？])[\"')\]]*\s+|\s*\n\s*")


def token_starts(text: str) -> np.ndarray:
    return np.fromiter((m.start() for m in _TOKENS.finditer(text)), np.int64)


def boundaries(text: str, starts: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Every end a piece may have: natural ones, the end of the text, and forced ones where natural ones are too far apart."""
    n = len(starts)
    at = np.fromiter((m.end() for m in _BREAKS.finditer(text)), np.int64)
    natural = np.unique(np.concatenate([np.searchsorted(starts, at), [overlap, n]]))
    natural = natural[(natural >= overlap) & (natural <= n)]
    reach = limit - overlap
    wide = np.flatnonzero(np.diff(natural) > reach)
    forced = [np.arange(natural[i] + reach, natural[i + 1], reach) for i in wide]
    return np.unique(np.concatenate([natural, *forced]))


def _scan(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            totals, ends = [], []
            for text in b.column("text").to_pylist():
                over = text and len(text) > limit and len(_TOKENS.findall(text)) > limit
                starts = token_starts(text) if over else np.zeros(0, np.int64)
                totals.append(len(starts))
                ends.append(boundaries(text, starts, limit, overlap) if over else starts)
            flat = np.concatenate(ends)
            yield pa.RecordBatch.from_arrays(
                [b.column("document_id"), b.column("stamp"), pa.array(totals, pa.int32()), lists(flat, [len(e) for e in ends], pa.int32())],
                ["document_id", "stamp", "total", "ends"],
            )

    return run


def cuts(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, total, end) of ``docs(document_id, text, ingested_at)``: every end of a piece of every text over the limit, in tokens; found by pointer doubling."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    rows = docs.select("document_id", "text", F.col("ingested_at").alias("stamp"))
    kind = rows.schema["stamp"].dataType.simpleString()
    scanned = rows.mapInArrow(_scan(limit, overlap), f"document_id string, stamp {kind}, total int, ends array<int>")
    scanned = cut(latest(scanned, "document_id", "stamp").where(F.col("total") > 0).select("document_id", "total", "ends"))  # boundaries are shuffled, not texts
    each = scanned.select("document_id", "total", F.explode("ends").alias("at"))
    reach = Window.partitionBy("document_id").orderBy("at").rangeBetween(0, limit - overlap)
    step = written(each.withColumn("next", F.max("at").over(reach)))
    hop = step.where(F.col("next") > F.col("at")).select("document_id", "at", "next")
    reached = step.where(F.col("at") == overlap).select("document_id", F.lit(overlap).alias("at"))
    size = 0
    while True:
        ahead = reached.join(hop, ["document_id", "at"]).select("document_id", F.col("next").alias("at"))
        reached = cut(reached.unionByName(ahead).distinct())
        now = reached.count()
        if now == size:
            break
        size = now
        second = hop.select("document_id", F.col("at").alias("next"), F.col("next").alias("then"))
        hop = cut(hop.join(second, ["document_id", "next"]).select("document_id", "at", F.col("then").alias("next")))
    totals = scanned.select("document_id", "total")
    return reached.where(F.col("at") > overlap).join(totals, "document_id").select("document_id", "total", F.col("at").alias("end"))


def pieces(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, ordinal, token_start, token_count, text) of each piece of the texts over the limit; ordinal counts from 1."""
    docs = latest(docs.select("document_id", "text", "ingested_at"), "document_id", "ingested_at")
    ends = cuts(docs, limit, overlap).groupBy("document_id").agg(F.sort_array(F.collect_list("end")).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows: list[tuple] = []
            for key, text, stops in zip(*(b.column(c).to_pylist() for c in ("document_id", "text", "ends"))):
                found = [(m.start(), m.end()) for m in _TOKENS.finditer(text)]
                before = overlap
                for k, stop in enumerate(stops, 1):
                    begin = before - overlap
                    rows.append((key, k, begin, stop - begin, text[found[begin][0] : found[stop - 1][1]]))
                    before = stop
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))],
                ["document_id", "ordinal", "token_start", "token_count", "text"],
            )

    cutting = docs.select("document_id", "text").join(ends, "document_id")
    return cutting.mapInArrow(run, "document_id string, ordinal int, token_start int, token_count int, text string")
