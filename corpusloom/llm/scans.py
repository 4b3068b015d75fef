"""Problem 4: defects of texts that come line by line from scanned pages, and their repair.

Words whose glyphs are easily taken for one another share a skeleton. The words of the whole collection
are grouped by it; a rare word with a frequent form of the same skeleton is suspect, and read as the form
that its neighbours support, or the far more frequent one. Lines that are alike when digits are masked and
recur in their text or in many texts, and lines that repeat the title, are running heads; lines of a
number alone that fit the count of pages are page numbers. Windows over the lines left find the line
that a hyphen at the end goes on in, past heads and page numbers; the counts of the joined and of
the hyphenated word tell a cut word from one that owns its hyphen. ``reflow`` joins what is left to paragraphs.

Defined results: null and empty texts have no lines with a defect; the opening "## Pages" line is none;
of a repeated document_id the latest row by ingested_at counts; rows without document_id are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, written
from .common import latest, slices

LEAST_FORM = 5
RATIO = 12
FAR_RATIO = 50
HEAD_TEXTS = 3
SMALL_ROWS = 100_000
#: Hyphens, soft ones and the sign scanners put for them.
HYPHENS = "-‐‑­¬"
#: Glyphs taken for one another, several letters first.
PAIRS = (("rn", "m"), ("ii", "u"), ("vv", "w"), ("cl", "d"))
SINGLES = ("c5$@0f!1|lqb69", "essaotiiiighho")
#: Roman digits.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def skeleton(word: Column) -> Column:
    out = F.lower(word)
    for a, b in PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, *SINGLES)


def bare(token: Column) -> Column:
    """Lower-cased token without outer punctuation, glyph substitutes kept."""
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}@!|$]+|[^\p{L}\p{N}@!|$]+$", ""))


#: A token that may be a misread word: letters and the odd substitute, no capital but the first.
_WORDLIKE = re.compile(r"[^\W_][a-zß-öø-ÿ@!|$0-9'\-‐‑]*$|[@!|$][a-zß-öø-ÿ@!|$0-9'\-‐‑]*$")
_OUTER = re.compile(r"^(?:[^\w@!|$]|_)+|(?:[^\w@!|$]|_)+$")


def _core(token: str) -> str:
    """``bare`` in Python, before lower-casing."""
    return token if token.isalnum() else _OUTER.sub("", token)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, n_clean, skel) over every text of ``docs(text, scanned)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = {True: Counter(), False: Counter()}
            for text, scanned in zip(b.column("text").to_pylist(), b.column("scanned").to_pylist()):
                raw[scanned].update(text.split())
            n: Counter = Counter()
            clean: Counter = Counter()
            for scanned, counts in raw.items():
                for token, k in counts.items():
                    if len(token) >= 2:
                        word = _core(token).lower()
                        if any(map(str.isalpha, word)):
                            n[word] += k
                            if not scanned:
                                clean[word] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([clean[w] for w in n], pa.int64())], ["word", "n", "n_clean"])

    each = docs.select("text", "scanned").mapInArrow(run, "word string, n long, n_clean long")
    total = each.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_clean").alias("n_clean"))
    return total.withColumn("skel", skeleton(F.col("word")))


def suspects(counts: DataFrame) -> DataFrame:
    """(word, forms): rare words and the frequent forms they may be misread from, most frequent first.

    A form is at least RATIO times as frequent; a word that clean texts use at the same rate as scanned ones is no suspect.
    """
    total = counts.agg(F.sum("n").alias("all"), F.sum("n_clean").alias("clean")).first()
    share = (total["clean"] or 0) / max(1, total["all"] or 1)
    letters = F.length(F.regexp_replace("word", r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace("word", r"[^0-9]", ""))
    wordlike = (letters >= 3) & (digits <= 2) & (digits * 2 < letters)
    forms = counts.where((F.col("n") >= LEAST_FORM) & ~F.col("word").rlike(r"[^\p{L}\-]")).select("skel", F.col("word").alias("form"), F.col("n").alias("n_form"))
    rare = counts.where(wordlike & (F.col("n_clean") <= F.lit(0.25 * share) * F.col("n"))).select("skel", "word", "n")
    pairs = rare.join(forms, "skel").where((F.col("word") != F.col("form")) & (F.col("n_form") >= RATIO * F.col("n")))
    listed = F.sort_array(F.collect_list(F.struct("n_form", "form")), asc=False)  # forms of one skeleton are a handful
    return pairs.groupBy("word").agg(F.first("n").alias("n"), listed.alias("forms"))


def lines(docs: DataFrame) -> DataFrame:
    """(document_id, titled, line_no, line): lines counted from 1, outer white space off; titled is the title's head shape."""
    shaped = docs.select("document_id", _head_shape(F.regexp_replace("title", r"[0-9]+", " ")).alias("titled"), "text")  # before lines are made, so once a text
    each = shaped.select("document_id", "titled", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return each.select("document_id", "titled", (F.col("at") + 1).cast("long").alias("line_no"), F.regexp_replace("raw", r"^[\s ]+|[\s ]+$", "").alias("line"))


def _roman(text: Column) -> Column:
    for a, b in (("iv", "iiii"), ("ix", "viiii"), ("xl", "xxxx"), ("xc", "lxxxx"), ("cd", "cccc"), ("cm", "dcccc")):
        text = F.replace(text, F.lit(a), F.lit(b))
    parts = [(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) * v for c, v in ROMAN.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _head_shape(line: Column) -> Column:
    """The line without numbers, case, punctuation and glyph detail; heads are compared by it."""
    plain = F.regexp_replace(F.translate(F.lower(line), "|", " "), r"(?<![\p{L}\p{N}])[0-9]+(?![\p{L}\p{N}])", "#")
    return F.trim(F.translate(F.regexp_replace(skeleton(plain), r"[^\p{L}#]+", " "), "t", "e"))


def kinds(every: DataFrame) -> DataFrame:
    """``lines`` with kind: open, blank, page_number, running_head or body."""
    text = Window.partitionBy("document_id")
    line = F.col("line")
    number = F.regexp_extract(line, r"^[^\p{L}\p{N}]*(?i:(?:page|pages|p|pp|pg|seite|s)\.?\s*)?([0-9]{1,5}|[ivxlcdm]+)[^\p{L}\p{N}]*$", 1)
    rows = every.withColumn("number", number)  # a column of its own, so that it is sought once a line
    number = F.col("number")
    rows = rows.withColumn("num", F.when(number != "", F.when(number.rlike("^[0-9]"), number.cast("long")).otherwise(_roman(number))))
    rows = rows.withColumn("width", F.max(F.length(line)).over(text)).withColumn("nums", F.collect_set("num").over(text))
    steps = F.exists("nums", lambda x: F.abs(x - F.col("num")).between(1, 12))
    lone = (F.size("nums") == 1) & line.rlike(r"[0-9]|^[ivxlc]+$")
    paged = F.coalesce(F.col("num").isNotNull() & (steps | lone), F.lit(False))
    opening = (F.col("line_no") == 1) & line.startswith("## Pages")

    words = F.size(F.split(line, r"\s+"))
    upper = (F.length(F.regexp_replace(line, r"[^\p{Ll}]", "")) <= 1) & line.rlike(r"\p{Lu}.*\p{Lu}.*\p{Lu}")
    fit = (
        line.rlike(r"^[^\p{L}\p{N}#]*(\p{Lu}|[0-9]+[^0-9.,]|[0-9]\p{L}|[@!])")
        & ~line.rlike(r"[.,;:)]$|[" + HYPHENS + r"]$")
        & line.rlike(r"\p{L}{2}")
        & ~line.rlike(r"[0-9]\.[0-9]")
        & (words <= 10)
    )
    rows = rows.withColumn("looks", fit)
    fit = F.col("looks")
    part = F.trim(F.regexp_replace(_head_shape(F.regexp_replace(F.regexp_replace(line, r"\s+[—–|]\s.*$", ""), r"(?i),?\s*v[o0]l\W*\s*[0-9ivxlc]+\W*$", "")), r"^# | #$", ""))
    titled = F.col("titled")
    is_title = F.when(fit, (F.length(titled) >= 4) & (F.levenshtein(part, titled) <= F.greatest(F.lit(1), F.floor(F.length(titled) * 0.12))))
    short = F.length(line) <= 0.75 * F.col("width")
    rows = written(rows.select("document_id", "line_no", "line", short.alias("short"), paged.alias("paged"), opening.alias("opening"), (fit & ~paged & ~opening).alias("fit"), is_title.alias("is_title")))

    # few lines have the look of a head; only they are compared
    some = rows.where("fit").withColumn("shape", _head_shape(line))
    some = some.withColumn("within", F.count(F.lit(1)).over(Window.partitionBy("document_id", "shape")))
    marked = F.col("shape").contains("#") | upper | line.rlike(r"^\[.*\]$")
    some = some.withColumn("maybe", F.col("short") & (words <= 8) & (marked | (F.col("within") >= 2)))
    some = cut(some.select("document_id", "line_no", "within", "maybe", "is_title", F.regexp_replace("shape", "^(?:ehap # )|^# | #$", "").alias("core")))  # core: the section's name, however it is set
    shared = some.where("maybe").groupBy("core").agg(F.count_distinct("document_id").alias("texts")).where(F.col("texts") >= HEAD_TEXTS).select("core", F.lit(True).alias("known"))
    head = F.col("is_title") | (F.col("maybe") & (F.coalesce("known", F.lit(False)) | (F.col("within") >= 2)))
    heads = some.join(shared, "core", "left").where(head).select("document_id", "line_no", F.lit(True).alias("head"))
    rows = rows.join(heads, ["document_id", "line_no"], "left")
    kind = F.when(F.col("opening"), "open").when(line == "", "blank").when(F.col("paged"), "page_number").when(F.col("head"), "running_head").otherwise("body")
    return written(rows.select("document_id", "line_no", "line", kind.alias("kind")))


def hyphened(body: DataFrame, counts: DataFrame) -> DataFrame:
    """(document_id, line_no, next_no, a, b, split): lines that end in a hyphen, the halves, and whether a word was cut there."""
    order = Window.partitionBy("document_id").orderBy("line_no")
    ahead = body.select("document_id", "line_no", "line", F.lead("line").over(order).alias("next"), F.lead("line_no").over(order).alias("next_no"))
    cutting = ahead.where(F.col("line").rlike(r"[\p{L}\p{N}@!|$][" + HYPHENS + r"]$") & F.col("next").isNotNull())
    a = F.regexp_extract("line", r"([^\s(\[/—]+)[" + HYPHENS + r"]$", 1)
    b = F.regexp_extract("next", r"^([\p{L}\p{N}@!|$'\-]+)", 1)
    halves = cutting.select("document_id", "line_no", "next_no", a.alias("a"), b.alias("b")).where((F.col("a") != "") & (F.col("b") != ""))
    halves = halves.withColumn("sj", skeleton(bare(F.concat("a", "b")))).withColumn("sh", skeleton(bare(F.concat_ws("-", "a", "b"))))
    halves = halves.withColumn("sa", skeleton(bare(F.col("a")))).withColumn("sb", skeleton(bare(F.col("b"))))
    by = counts.groupBy("skel").agg(F.max("n").alias("n"))
    for name in ("sj", "sh", "sa", "sb"):
        halves = halves.join(by.select(F.col("skel").alias(name), F.col("n").alias(f"n_{name}")), name, "left").fillna(0, [f"n_{name}"])
    owns = F.col("b").rlike(r"^[0-9]") | (F.col("b").rlike(r"^\p{Lu}") & ~F.col("a").rlike(r"^[^\p{Ll}]+$"))
    words = (F.col("n_sa") >= LEAST_FORM) & (F.col("n_sb") >= LEAST_FORM) & (F.length("a") >= 3) & (F.length("b") >= 3)
    split = F.when(owns, False).when(F.col("n_sj") != F.col("n_sh"), F.col("n_sj") > F.col("n_sh")).otherwise(~words)
    return cut(halves.select("document_id", "line_no", "next_no", "a", "b", split.alias("split")))


def _few(df: DataFrame) -> set | None:
    """The rows as a set to be sent to every task, None where there are more than SMALL_ROWS."""
    rows = df.limit(SMALL_ROWS + 1).collect()
    return {tuple(r) if len(r) > 1 else r[0] for r in rows} if len(rows) <= SMALL_ROWS else None


def _occurrences(rows: DataFrame, doubtful: DataFrame) -> DataFrame:
    """(document_id, line_no, word, left, right): whole tokens of the lines that are in ``doubtful(word)``, with their neighbours.

    Few words go to every task; for more, the tokens are joined with them.
    """
    few = _few(doubtful)
    shared = rows.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for b in batches:
            at, found = [], []
            for i, (line, end, begin) in enumerate(zip(b.column("line").to_pylist(), b.column("cut_end").to_pylist(), b.column("cut_begin").to_pylist())):
                tokens = line.split()
                for k in range(1 if begin else 0, len(tokens) - (1 if end else 0)):
                    core = _core(tokens[k])
                    if (wanted is None or core.lower() in wanted) and _WORDLIKE.match(core):
                        at.append(i)
                        found.append((core.lower(), _core(tokens[k - 1]).lower() if k else "", _core(tokens[k + 1]).lower() if k + 1 < len(tokens) else ""))
            cols = [pa.array([f[j] for f in found], pa.string()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*b.select(["document_id", "line_no"]).take(pa.array(at, pa.int64())).columns, *cols], ["document_id", "line_no", "word", "left", "right"])

    out = rows.mapInArrow(run, "document_id string, line_no long, word string, left string, right string")
    return out if few is not None else out.join(doubtful, "word", "left_semi")


def _beside(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(form, by, times): how often each form stands beside each neighbour of ``asked(form, by)`` in the lines; few or many as above."""
    few = _few(asked)
    shared = rows.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for b in batches:
            n: Counter = Counter()
            for line in b.column("line").to_pylist():
                t = [_core(x).lower() for x in line.split()]
                n.update((y, "<" + x) for x, y in zip(t, t[1:]))
                n.update((x, ">" + y) for x, y in zip(t, t[1:]))
            kept = [(k, v) for k, v in n.items() if wanted is None or k in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in kept], pa.string()), pa.array([k[1] for k, _ in kept], pa.string()), pa.array([v for _, v in kept], pa.int64())], ["form", "by", "times"])

    each = rows.select("line").mapInArrow(run, "form string, by string, times long")
    each = each if few is not None else each.join(asked, ["form", "by"], "left_semi")
    return each.groupBy("form", "by").agg(F.sum("times").alias("times"))


def misread(body: DataFrame, halves: DataFrame, counts: DataFrame) -> DataFrame:
    """(document_id, line_no, word, form): misread words, each with the form it is read as."""
    doubtful = cut(suspects(counts))
    ends = halves.select("document_id", "line_no", F.lit(True).alias("cut_end"))
    begins = halves.select("document_id", F.col("next_no").alias("line_no"), F.lit(True).alias("cut_begin"))
    rows = written(body.join(ends, ["document_id", "line_no"], "left").join(begins, ["document_id", "line_no"], "left"))
    single = _occurrences(rows, doubtful.select("word"))
    single = single.withColumns({"next_no": F.lit(None).cast("long"), "first": F.lit(None).cast("int")})
    glued = halves.where("split").select(
        "document_id", "line_no", bare(F.concat("a", "b")).alias("word"), F.lit("").alias("left"), F.lit("").alias("right"), "next_no", F.length("a").alias("first")
    )
    found = cut(single.unionByName(glued).join(doubtful, "word"))
    each = found.withColumn("f", F.explode("forms")).select("*", F.col("f.form").alias("form"), F.col("f.n_form").alias("n_form"), F.explode(F.array(F.concat(F.lit("<"), "left"), F.concat(F.lit(">"), "right"))).alias("by"))
    # how often each neighbour stands beside each form in the scanned texts
    asked = cut(each.where(F.length("by") > 1).select("form", "by").distinct())
    beside = _beside(rows, asked)
    scored = each.join(beside, ["form", "by"], "left").groupBy("document_id", "line_no", "word", "next_no", "first", "n", "form", "n_form").agg(F.sum(F.coalesce("times", F.lit(0))).alias("support"))
    best = scored.groupBy("document_id", "line_no", "word", "next_no", "first", "n").agg(F.max(F.struct("support", "n_form", "form")).alias("b"))
    sure = (F.col("b.support") >= 2) | (F.col("b.n_form") >= FAR_RATIO * F.col("n"))
    form = F.col("b.form")
    at = F.when(F.col("next_no").isNotNull() & form.startswith(F.expr("substring(word, 1, first)")), F.col("next_no")).otherwise(F.col("line_no"))
    return best.where(sure).select("document_id", at.alias("line_no"), "word", form.alias("form"))


def _parts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines with their kinds, body lines, halves at hyphens and misread words of ``docs(document_id, title, text, parser, ingested_at)``."""
    counts = cut(word_counts(docs.where(F.col("text").isNotNull()).select("text", F.coalesce(F.col("parser") == "pdf", F.lit(False)).alias("scanned"))))
    scanned = latest(docs.where(F.col("parser") == "pdf").select("document_id", "title", "text", "ingested_at"), "document_id", "ingested_at")
    sorted_lines = kinds(lines(scanned.withColumn("title", F.coalesce("title", F.lit("")))))
    body = sorted_lines.where(F.col("kind") == "body").select("document_id", "line_no", "line")
    halves = hyphened(body, counts)
    return sorted_lines, body, halves, misread(body, halves, counts)


def defects(docs: DataFrame) -> DataFrame:
    """(document_id, line_no, defect) of the scanned texts."""
    every, _, halves, wrong = _parts(docs)
    alone = every.where(F.col("kind").isin("running_head", "page_number")).select("document_id", "line_no", F.col("kind").alias("defect"))
    cutting = halves.where("split").select("document_id", "line_no", F.lit("split_word").alias("defect"))
    return alone.unionByName(cutting).unionByName(wrong.select("document_id", "line_no", F.lit("misread").alias("defect")).distinct())


def reflow(docs: DataFrame) -> DataFrame:
    """(document_id, paragraph_no, text): continuous paragraphs without heads and page numbers, cut words joined and misread ones put right."""
    every, body, halves, wrong = _parts(docs)
    fixes = wrong.groupBy("document_id", "line_no").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "form")))).alias("fix"))
    order = Window.partitionBy("document_id").orderBy("line_no")
    kept = every.where(F.col("kind").isin("body", "blank"))
    # a blank line ends a paragraph unless a page ended there in mid-sentence
    previous = F.last(F.when(F.col("kind") == "body", F.col("line")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    page = F.max(F.when(F.col("kind").isin("page_number", "running_head"), F.col("line_no"))).over(order.rowsBetween(-3, 0))
    marked = every.withColumn("previous", previous).withColumn("page", page).where(F.col("kind").isin("body", "blank"))
    gap = F.lag("kind").over(order) == "blank"
    ended = F.col("previous").rlike(r"[.!?:][)\]\"']*$") | F.col("page").isNull()
    numbered = marked.withColumn("new", F.when((F.col("kind") == "body") & gap & ended, 1).otherwise(0)).withColumn("paragraph_no", F.sum("new").over(order) + 1)
    flow = numbered.where(F.col("kind") == "body").join(halves.where("split").select("document_id", "line_no", F.lit(True).alias("cut")), ["document_id", "line_no"], "left")
    flow = flow.join(fixes, ["document_id", "line_no"], "left")
    outer = r"[^\p{L}\p{N}@!|$]*"
    right = lambda w: F.try_element_at(F.col("fix"), bare(w))
    cased = lambda w: F.when(w.rlike("^" + outer + r"\p{Lu}"), F.initcap(right(w))).otherwise(right(w))
    whole = lambda w: F.concat(F.regexp_extract(w, "^" + outer, 0), cased(w), F.regexp_extract(w, outer + "$", 0))
    mended = F.array_join(F.transform(F.split("line", " "), lambda w: F.coalesce(whole(w), w)), " ")
    text = F.when(F.col("fix").isNotNull(), mended).otherwise(F.col("line"))
    joined = F.when(F.coalesce("cut", F.lit(False)), F.regexp_replace(text, "[" + HYPHENS + "]$", "")).when(text.rlike("-$"), text).otherwise(F.concat(text, F.lit(" ")))
    parts = flow.select("document_id", "paragraph_no", F.struct("line_no", joined.alias("s")).alias("p"))
    grouped = parts.groupBy("document_id", "paragraph_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "").alias("text"))
    return grouped.select("document_id", F.col("paragraph_no").cast("int").alias("paragraph_no"), F.trim("text").alias("text"))
