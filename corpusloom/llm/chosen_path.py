"""Problem 2: records that share most of their content, by a chosen-path join.

Each record is the set of its distinct sequences of three consecutive words. Records with one and
the same set form a class, so copies cost nothing below. A class keeps minima of its set under 64
hash functions: its sampled tokens. A run splits all classes by the value of one or two positions
picked by the run, and splits each bucket that is still large by positions picked by the bucket's
own path, level by level, so that sets alike at the threshold keep together with fair chance.
Small buckets are compared by brute force, first on 128-bit sketches, and runs are repeated until
the target recall. The pairs left are decided on the exact sets. A bucket that a level hardly makes
smaller holds many different sets all alike and is compared whole, in blocks. Where others are still large
at the last level, the classes in them are joined once more by themselves, with twice the levels and the runs those need,
until none is: a bucket halves at each level or is compared, so log2(classes / bucket) levels are enough.

Defined results: null title and null text count as empty; records with fewer than ``least``
sequences take no part; of a repeated document_id the latest row counts; rows without document_id
are left out; an empty table gives no rows. Sets are held as 63-bit hashes of their sequences.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, written
from .common import WordIds, latest, mix, slices

THRESHOLD = 0.6
SHINGLE = 3
LEAST = 20
MINIMA = 64
BUCKET = 64
DEPTH = 5
STUCK = 0.5
RECALL = 0.999
BROADCAST_IDS = 200_000
_WORDS = re.compile("[a-z0-9]+")
_RNG = np.random.default_rng(20)
_MUL = (_RNG.integers(0, 2**63, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64)


def shingles(text: str, ids: WordIds, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the sequences of ``width`` words."""
    w = ids.of(_WORDS.findall(text.lower())).astype(np.uint64)
    if len(w) < width:
        return np.zeros(0, np.uint64)
    h = w[: len(w) - width + 1]
    for k in range(1, width):
        h = mix(h) + w[k : len(w) - width + 1 + k]
    return np.unique(mix(h) >> np.uint64(1))


def digest(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def minima(found: np.ndarray) -> np.ndarray:
    return ((found[None, :] * _MUL[:, None] + _ADD[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32)


def sketch(low: np.ndarray) -> tuple[int, int]:
    """Two bits of each minimum in two longs."""
    bits = (low & 3).astype(np.uint64).reshape(2, 32)
    packed = (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))[None, :]).sum(axis=1, dtype=np.uint64)
    a, b = packed.astype(np.int64).tolist()
    return a, b


def survival(similarity: float, threshold: float, depth: int) -> float:
    """Chance that a pair of this similarity shares a bucket after ``depth`` levels of one run."""
    whole, part = divmod(1 / threshold, 1)
    s = 1.0
    for _ in range(depth):
        lost = 1 - similarity * s
        s = 1 - lost**whole * (1 - part + part * lost)
    return s


def runs_needed(threshold: float, depth: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, threshold, depth)))


def agreeing(threshold: float) -> int:
    """Least number of equal two-bit values of a pair at the threshold, 3.5 deviations under the mean."""
    p = threshold + (1 - threshold) / 4
    return math.floor(MINIMA * p - 3.5 * math.sqrt(MINIMA * p * (1 - p)))


def _deeper(path: np.ndarray, low: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The paths one level below: (row, path) by one or more positions that the path itself picks."""
    whole, part = divmod(1 / threshold, 1)
    seed = mix(path)
    first = (seed % np.uint64(MINIMA)).astype(np.int64)
    more = (seed >> np.uint64(32)).astype(np.float64) / 2**32 < part
    rows, keys = [], []
    for k in range(int(whole) + 1):
        who = np.arange(len(path)) if k < whole else np.flatnonzero(more)
        at = (first[who] + k * 23) % MINIMA
        rows.append(who)
        keys.append(mix(path[who] * np.uint64(3) + mix(low[who, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(33)))))
    return np.concatenate(rows), np.concatenate(keys)


def signatures(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(document_id, stamp, id, n, low, s1, s2): what a record's set leaves; made before rows are chosen, so texts aren't shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in slices(batches):
            out: list[tuple] = []
            for key, text in zip(b.column("document_id").to_pylist(), b.column("text").to_pylist()):
                found = shingles(text, ids)
                if len(found) >= least:
                    low = minima(found)
                    out.append((key, digest(found), len(found), low.tobytes(), *sketch(low)))
                else:
                    out.append((key, 0, len(found), None, 0, 0))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*cols, b.column("stamp")], ["document_id", "id", "n", "low", "s1", "s2", "stamp"])

    rows = docs.select("document_id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"), F.col("ingested_at").alias("stamp"))
    kind = rows.schema["stamp"].dataType.simpleString()
    return rows.mapInArrow(run, f"document_id string, id long, n int, low binary, s1 long, s2 long, stamp {kind}")


def _split(threshold: float, runs: range | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            low = np.frombuffer(b"".join(b.column("low").to_pylist()), np.uint32).reshape(-1, MINIMA)
            if runs is None:
                row, key = _deeper(b.column("key").to_numpy().astype(np.uint64), low, threshold)
                up = b.column("size").take(pa.array(row))
            else:
                parts = [_deeper(np.full(len(low), mix(np.array([r + 1], np.uint64))[0]), low, threshold) for r in runs]
                row, key = (np.concatenate(x) for x in zip(*parts))
                up = pa.nulls(len(row), pa.int64())
            took = b.select(["id", "s1", "s2"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(key.astype(np.int64)), up], ["id", "s1", "s2", "key", "up"])

    return run


def _near(a: str, b: str, least: int) -> F.Column:
    """Enough of the two-bit values of both sketches are equal."""
    diff = [F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")) for s in ("s1", "s2")]
    odd = [x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)) for x in diff]
    return F.bit_count(odd[0]) + F.bit_count(odd[1]) <= MINIMA - least


def candidates(classes: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET, depth: int = DEPTH, recall: float = RECALL, done: int = 0) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of ``classes(id, low, s1, s2)`` that share a bucket and whose sketches agree. ``done`` runs were made before."""
    schema = "id long, s1 long, s2 long, key long, up long"
    runs = runs_needed(threshold, depth, recall)
    least = agreeing(threshold)
    live = classes.mapInArrow(_split(threshold, range(done, done + runs)), schema)
    small, whole = [], []
    for level in range(1, depth + 1):
        counts = live.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        counted = written(live.join(counts, "key"))
        small.append(counted.where(F.col("size") <= bucket).select("key", "id", "s1", "s2"))
        # a bucket that its level hardly made smaller holds sets all alike: further levels would only multiply it
        stuck = F.coalesce(F.col("size") >= STUCK * F.col("up"), F.lit(False))
        large = counted.where(F.col("size") > bucket)
        whole.append(large.where(stuck).select("key", "id", "s1", "s2", "size"))
        large = large.where(~stuck)
        empty = large.isEmpty()
        if level == depth or empty:
            deep = None if empty else large
            break
        live = large.select("key", "id", "size").join(classes, "id").mapInArrow(_split(threshold, None), schema)
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    met = (F.col("a.id") < F.col("b.id")) & _near("a", "b", least)
    pick = [F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")]
    found = rows.alias("a").join(rows.alias("b"), (F.col("a.key") == F.col("b.key")) & met).select(*pick)
    large = whole[0]
    for more in whole[1:]:
        large = large.unionByName(more)
    if not large.isEmpty():  # whole large buckets in blocks: block i meets block j once, for each i <= j
        n = F.ceil(F.col("size") / bucket).cast("long")
        mine = F.pmod(F.xxhash64("id"), n)
        spread = large.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        spread = spread.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
        same = (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
        apart = (F.col("a.mine") != F.col("b.mine")) | (F.col("a.i") == F.col("a.j"))
        found = found.unionByName(spread.alias("a").join(spread.alias("b"), same & apart & met).select(*pick))
    if deep is not None:
        again = cut(classes.join(deep.select("id").distinct(), "id", "left_semi"))
        found = found.unionByName(candidates(again, threshold, bucket, 2 * depth, recall, done + runs))
    return found.distinct()


def _agreeing(threshold: float):
    """Pairs whose minima agree often enough, 3.5 deviations under what a pair at the threshold agrees in."""
    least = MINIMA * threshold - 3.5 * math.sqrt(MINIMA * threshold * (1 - threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint32).reshape(-1, MINIMA) for x in ("low_a", "low_b"))
                yield b.select(["id_a", "id_b"]).filter(pa.array((a == c).sum(axis=1) >= least))

    return run


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, value = [], []
            for i, (x, y) in enumerate(zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist())):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if (s := both / (len(p) + len(q) - both)) >= threshold:
                    keep.append(i)
                    value.append(s)
            took = b.select(["id_a", "id_b"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(value, pa.float64())], ["id_a", "id_b", "similarity"])

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, bucket: int = BUCKET, depth: int = DEPTH, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Members (document_id, id) and links between classes (id_a, id_b, similarity) at or over the threshold."""
    chosen = cut(latest(signatures(docs, least), "document_id", "stamp").where(F.col("n") >= least))
    members = chosen.select("document_id", "id")
    first = F.first(F.struct("low", "s1", "s2")).alias("r")  # alike in all members
    classes = cut(chosen.groupBy("id").agg(first, F.min("document_id").alias("document_id")).select("id", "document_id", "r.*"))
    pairs = candidates(classes.select("id", "low", "s1", "s2"), threshold, bucket, depth, recall)
    for side in ("a", "b"):  # the whole minima decide which sets are worth fetching
        pairs = pairs.join(classes.select(F.col("id").alias(f"id_{side}"), F.col("low").alias(f"low_{side}")), f"id_{side}")
    pairs = cut(pairs.mapInArrow(_agreeing(threshold), "id_a long, id_b long"))
    wanted = cut(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().join(classes.select("id", "document_id"), "id"))
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in slices(batches):
            found = [shingles(t, ids) for t in b.column("text").to_pylist()]
            keep = [i for i, (f, want) in enumerate(zip(found, b.column("id").to_pylist())) if digest(f) == want]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep, pa.int64())), pa.array([found[i].tobytes() for i in keep], pa.binary())], ["id", "set"])

    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text")
    held = docs.select("document_id", text).join(wanted, "document_id").select("id", "text").mapInArrow(sets, "id long, set binary")
    held = cut(held.groupBy("id").agg(F.first("set").alias("set")))
    both = pairs.join(held.select(F.col("id").alias("id_a"), F.col("set").alias("set_a")), "id_a").join(held.select(F.col("id").alias("id_b"), F.col("set").alias("set_b")), "id_b")
    return members, cut(both.mapInArrow(_exact(threshold), "id_a long, id_b long, similarity double"))


def direct_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(document_id_a, document_id_b), a < b: the links between classes for all their members, and the pairs within a class."""
    a = members.select(F.col("id").alias("id_a"), F.col("document_id").alias("x"))
    b = members.select(F.col("id").alias("id_b"), F.col("document_id").alias("y"))
    between = links.join(a, "id_a").join(b, "id_b").select("x", "y")
    within = a.join(b, (F.col("id_a") == F.col("id_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("document_id_a"), F.greatest("x", "y").alias("document_id_b"))


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(document_id, class_id, links): one row a record; links counts the other records at or over the threshold."""
    sizes = members.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.min("document_id").alias("class_id"))
    ends = links.select(F.col("id_a").alias("id"), F.col("id_b").alias("other")).unionByName(links.select(F.col("id_b").alias("id"), F.col("id_a").alias("other")))
    reach = ends.join(sizes.select(F.col("id").alias("other"), F.col("size").alias("n")), "other").groupBy("id").agg(F.sum("n").alias("n"))
    each = sizes.join(reach, "id", "left").select("id", "class_id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    return members.join(each, "id").select("document_id", "class_id", "links")
