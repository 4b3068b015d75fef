"""Problem 3: the level a text is written for.

Texts graded by hand give each word a distribution over the levels, kept by clause so that clauses
borrowed from another level can be set right by the words around them, and from it a grade, the
expected level, and how sharply it points there. A text's level is read from a quantile of the grades
of its sharp words, the words of a clause sharing its length; which quantile, and where the levels part,
is calibrated on held-out folds of the graded texts.

One pass reads the texts: it gives each a first level by the words of the graded texts, and leaves the grades
it met and the words it didn't know, by clause. From those, counted by the first levels over all texts, unknown
words get grades of their own, in a table that is joined with the places they stand in; the level comes
from all grades of a text.

Bounds: the graded texts are fitted on the driver, at most ``MOST_GRADED`` of them. The table of learnt
words is as long as the vocabulary and goes nowhere whole. A word is learnt from ``LEAST_TEXTS`` texts on, at any size.

Defined results: of a repeated record_id the latest row counts; a null text or one under
``min_chars`` characters gives no row; a text without a known word gets the middle level.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import latest, lists, slices

#: The levels in order of difficulty.
LEVELS = ["elementary", "high_school", "undergraduate", "graduate", "professional"]
MIN_CHARS = 200
SHARP = 0.6
MOST_GRADED = 20_000
LEAST_TEXTS = 5
QUANTILES = (0.5, 0.4, 0.6)
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"(?<=[.!?;:])\s+|\n+|,\s+(?=(?:but|and|so|whereas|although|yet|or)\s)")


def clauses(text: str) -> list[list[str]]:
    return [w for c in _CLAUSE.split(text) if (w := _WORD.findall(c.lower()))]


def word_counts(graded: list[tuple[list[list[str]], int]], turns: int = 3) -> dict[str, np.ndarray]:
    """word -> clauses at each level. At first a clause has its text's level; then, turn by turn, the likeliest by its words."""
    n = len(LEVELS)
    level_of = [[level] * len(found) for found, level in graded]
    for turn in range(turns + 1):
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        for (found, _), levels in zip(graded, level_of):
            for clause, level in zip(found, levels):
                for w in set(clause):
                    counts[w][level] += 1
        if turn == turns:
            break
        total = sum(counts.values()) + 1
        odds = {w: np.log((p := (c + 0.2) / total) / p.mean()) for w, c in counts.items()}
        level_of = []
        for found, level in graded:
            prior = np.zeros(n)
            prior[level] = 2.0
            level_of.append([int((prior + sum((odds[w] for w in set(c)), np.zeros(n))).argmax()) for c in found])
    return dict(counts)


def grades(counts: dict[str, np.ndarray], least: int = 2) -> dict[str, tuple[float, float]]:
    """word -> (grade, sharpness) for words of at least ``least`` clauses, levels weighing the same."""
    if not counts:
        return {}
    total = np.maximum(sum(counts.values()), 1)
    out = {}
    for w, c in counts.items():
        if c.sum() >= least:
            p = c / total + 1e-5
            p /= p.sum()
            out[w] = (float(p @ np.arange(len(LEVELS))), float(p.max()))
    return out


def shares(found: list[list[str]], known: dict[str, tuple[float, float]]) -> tuple[list[float], list[float]]:
    """Grades of the sharp words and their weights: each clause has its length to share among its sharp words."""
    value: list[float] = []
    weight: list[float] = []
    for clause in found:
        sharp = [known[w][0] for w in clause if w in known and known[w][1] >= SHARP]
        if sharp:
            value += sharp
            weight += [sum(map(len, clause)) / len(sharp)] * len(sharp)
    return value, weight


def grade_quantile(found: list[list[str]], known: dict[str, tuple[float, float]], q: float) -> float | None:
    """Quantile of the grades of the sharp words."""
    value, weight = shares(found, known)
    if not value:
        return None
    order = np.argsort(value, kind="stable")
    mass = np.cumsum(np.array(weight, float)[order])
    return value[order[int(np.searchsorted(mass, q * mass[-1] - 1e-9))]]


def calibrate(graded: list[tuple[list[list[str]], int]], folds: int = 5) -> tuple[float, list[float], float]:
    """The quantile and the cuts between the levels that err least on held-out folds, and the share they get right."""
    best: tuple[float, list[float], float] = (QUANTILES[0], [k + 0.5 for k in range(len(LEVELS) - 1)], 0.0)
    held: list[tuple[list[list[str]], int, dict]] = []
    for f in range(folds):
        known = grades(word_counts([g for i, g in enumerate(graded) if i % folds != f]))
        held += [(found, level, known) for i, (found, level) in enumerate(graded) if i % folds == f]
    for q in QUANTILES:
        seen = [(v, level) for found, level, known in held if (v := grade_quantile(found, known, q)) is not None]
        if not seen:
            continue
        v, level = np.array([s[0] for s in seen]), np.array([s[1] for s in seen])
        cuts = []
        for k in range(len(LEVELS) - 1):
            tries = np.arange(k + 0.2, k + 0.81, 0.05)
            wrong = [int(((v > t) != (level > k)).sum()) for t in tries]
            fine = tries[np.array(wrong) == min(wrong)]
            cuts.append(float(fine[np.argmin(abs(fine - k - 0.5))]))
        right = float((np.searchsorted(cuts, v) == level).mean())
        if right > best[2] + 1e-9:
            best = (q, cuts, right)
    return best


def _level(known: dict, q: float, cuts: list[float], found: list[list[str]]) -> int | None:
    v = grade_quantile(found, known, q)
    return None if v is None else int(np.searchsorted(cuts, v))


def fit(sample: DataFrame, text: str = "text", level: str = "academic_level") -> dict:
    """The model of (text, level) rows; rows with a null text or an unknown level are left out."""
    rows = sample.where(F.col(text).isNotNull() & F.col(level).isin(LEVELS)).select(text, level).orderBy(F.xxhash64(text), text).limit(MOST_GRADED).collect()
    graded = [(clauses(r[0]), LEVELS.index(r[1])) for r in rows]
    q, cuts, right = calibrate(graded)
    return {"known": grades(word_counts(graded)), "q": q, "cuts": cuts, "held_out": right}


def read(texts: DataFrame, model: dict, key: str, min_chars: int) -> DataFrame:
    """(key, wanted, level, seen): whether a text is long enough to be asked for, its first level, and of each clause its
    number, its length, the grades of its known sharp words (word null) and its unknown words (grade null)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # at most the words of MOST_GRADED texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = m["known"]
        for b in slices(batches):
            levels, counts, clause, size, grade, words = [], [], [], [], [], []
            for text in b.column("text").to_pylist():
                found = clauses(text)
                levels.append(_level(known, m["q"], m["cuts"], found))
                n = len(words)
                for c, each in enumerate(found):
                    length = sum(map(len, each))
                    for w in each:
                        g = known.get(w)
                        if g is None or g[1] >= SHARP:
                            clause.append(c)
                            size.append(length)
                            grade.append(g[0] if g else None)
                            words.append(None if g else w)
                counts.append(len(words) - n)
            flat = pa.StructArray.from_arrays([pa.array(clause, pa.int32()), pa.array(size, pa.int32()), pa.array(grade, pa.float64()), pa.array(words, pa.string())], ["clause", "size", "grade", "word"])
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("wanted"), pa.array(levels, pa.int32()), lists(flat, counts, flat.type)], [key, "wanted", "level", "seen"])

    rows = texts.select(key, (F.length("text") >= min_chars).alias("wanted"), "text")
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, wanted boolean, level int, seen array<struct<clause: int, size: int, grade: double, word: string>>")


def learnt(seen: DataFrame, key: str) -> DataFrame:
    """(word, grade) of the sharp words among the unknown, by the first levels of all texts that hold them."""
    levelled = seen.where(F.col("level").isNotNull())
    n = len(LEVELS)
    texts_at = {r.level: r.n for r in levelled.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a level
    each = levelled.select("level", F.explode(F.array_distinct(F.filter("seen.word", lambda w: w.isNotNull()))).alias("word"))
    at = [F.sum(F.when(F.col("level") == k, 1).otherwise(0)).alias(f"n{k}") for k in range(n)]
    counts = each.groupBy("word").agg(*at, F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= LEAST_TEXTS)
    share = [F.col(f"n{k}") / F.lit(float(max(1, texts_at.get(k, 1)))) for k in range(n)]
    total = sum(share[1:], share[0])
    grade = sum((k * share[k] for k in range(1, n)), F.lit(0.0)) / total
    return counts.where(F.greatest(*share) / total >= SHARP).select("word", grade.alias("grade"))


def levels(seen: DataFrame, more: DataFrame, model: dict, key: str) -> DataFrame:
    """(key, academic_level) of the wanted texts from the grades of all sharp words, known and learnt."""
    seen = seen.where("wanted")
    own = seen.where(F.exists("seen", lambda s: s["word"].isNotNull())).select(key, F.explode(F.filter("seen", lambda s: s["word"].isNotNull())).alias("s")).select(key, "s.word", "s.clause", "s.size")
    added = own.join(more, "word").groupBy(key).agg(F.collect_list(F.struct("clause", "size", "grade")).alias("added"))  # the words of one text
    met = F.transform(F.filter("seen", lambda s: s["grade"].isNotNull()), lambda s: F.struct(s["clause"].alias("clause"), s["size"].alias("size"), s["grade"].alias("grade")))
    rows = seen.select(key, met.alias("met")).join(added, key, "left")
    rows = rows.select(key, F.concat("met", F.coalesce("added", F.array().cast("array<struct<clause: int, size: int, grade: double>>"))).alias("sharp"))
    q, cuts = model["q"], model["cuts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = pa.compute.list_value_length(b.column("sharp")).to_numpy(zero_copy_only=False)
            flat = b.column("sharp").flatten()
            clause, size, grade = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            level = np.full(len(counts), len(LEVELS) // 2)
            some = counts > 0
            if len(grade):
                text = np.repeat(np.arange(len(counts)), counts)
                _, at, words = np.unique(text * (int(clause.max()) + 1) + clause, return_inverse=True, return_counts=True)
                weight = size / words[at]
                order = np.lexsort((grade, text))
                mass = np.cumsum(weight[order])
                ends = mass[np.cumsum(counts[some]) - 1]
                begins = np.append(0, ends[:-1])
                level[some] = np.searchsorted(cuts, grade[order][np.searchsorted(mass, begins + q * (ends - begins) - 1e-9)])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([LEVELS[k] for k in level.tolist()], pa.string())], [key, "academic_level"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, academic_level string")


def read_levels(records: DataFrame, sample: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(record_id, academic_level) for ``records(record_id, text, judged_at)`` by what ``sample`` shows."""
    last = latest(records.select("record_id", "text", "judged_at"), "record_id", "judged_at").where(F.col("text").isNotNull())
    model = fit(sample)
    seen = written(read(last, model, "record_id", min_chars))
    return levels(seen, learnt(seen, "record_id"), model, "record_id")
