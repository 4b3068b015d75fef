"""Sections and overlapping token windows, in closed form, without a UDF."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import strip, unix_lines, words

MINIMUM, TARGET, MAXIMUM, OVERLAP = 320, 450, 510, 64
_MARK, _END = "\u0001", "\u0002"
SLICE_ROWS = 256


def sections(df: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """df's rows for each section: section_no, section (null before the first heading) and body, empty bodies dropped.

    Without any heading the whole text is one section, even an empty one.
    """
    marked = F.regexp_replace(unix_lines(F.col(text)), r"(?dm)^##\s+(.+?)\s*$", f"{_MARK}$1{_END}")
    parts = df.withColumn("_parts", F.split(marked, _MARK)).select("*", F.posexplode("_parts").alias("section_no", "_part"))
    headed = F.col("section_no") > 0
    body = F.when(headed, strip(F.substring_index("_part", _END, -1))).otherwise(strip(F.col("_part")))
    section = F.when(headed, F.substring_index("_part", _END, 1))
    only = F.size("_parts") == 1
    return parts.withColumn("section", section).withColumn("body", body).where(only | (F.col("body") != "")).drop("_parts", "_part")


def windows(n: Column, budget: Column, minimum: int, overlap: int) -> Column:
    """Array of (start, end) token windows over n tokens.

    Windows start a step apart while at least ``minimum`` tokens would be left; one last window that ends with the
    text covers what remains.
    """
    step = F.greatest(F.lit(1), budget - overlap)
    last = F.greatest(F.lit(0), F.least(F.floor((n - minimum) / step), F.ceil((n - budget) / step))).cast("int")
    pair = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    regular = F.transform(F.sequence(F.lit(0), last), lambda k: pair(k * step, F.least(k * step + budget, n)))
    tail = F.when(last * step + budget < n, F.array(pair(n - budget, n))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return F.when(n <= budget, F.array(pair(F.lit(0), n))).otherwise(F.concat(regular, tail))


@dataclass(frozen=True)
class Tokenizer:
    """What counts and cuts texts in place of runs without white space.

    ``spans`` gives (begin, end) of each token of a text; a tokenizer that can't tell gives ``encode``, the ids of a text, and
    ``decode``, the text of some ids. All three are plain functions of one text, run in Arrow batches.
    """

    spans: Callable[[str], list[tuple[int, int]]] | None = None
    encode: Callable[[str], list[int]] | None = None
    decode: Callable[[list[int]], str] | None = None

    def _mapped(self, made: Callable[[list[str]], pa.Array], kind: T.DataType) -> Callable[[Column], Column]:
        """``made`` gives, as one array, what all texts of a slice of rows become; tokens are held as numbers of Arrow, not as objects."""

        def run(lists: pa.Array) -> pa.Array:
            parts = []
            for some in (lists.slice(a, SLICE_ROWS) for a in range(0, len(lists), SLICE_ROWS)):
                each = made(some.flatten())
                n = pc.fill_null(pc.list_value_length(some), 0).to_numpy()
                offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                parts.append(pa.ListArray.from_arrays(offsets, each, mask=some.is_null() if some.null_count else None))
            return pa.concat_arrays(parts) if parts else pa.array([], to_arrow_type(T.ArrayType(kind)))

        return F.arrow_udf(run, T.ArrayType(kind)).asNondeterministic()  # so that it is called once, not wherever its column is used

    def _numbers(self, one: Callable[[str], list], width: int) -> Callable[[pa.Array], pa.Array]:
        """The tokens of each text as a list of int32, or of pairs of them."""

        def made(texts: pa.Array) -> pa.Array:
            each = [np.array(one(x), np.int32).reshape(-1, width) for x in texts.to_pylist()]
            flat = np.concatenate([*each, np.zeros((0, width), np.int32)])
            offsets = pa.array(np.append(0, np.cumsum([len(x) for x in each])).astype(np.int32))
            value = pa.array(flat[:, 0]) if width == 1 else pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["begin", "end"])
            return pa.ListArray.from_arrays(offsets, value)

        return made

    def counts(self, texts: Column) -> Column:
        one = self.spans or self.encode
        return self._mapped(lambda some: pa.array([len(one(x)) for x in some.to_pylist()], pa.int32()), T.IntegerType())(texts)

    def offsets(self, texts: Column) -> Column:
        pair = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
        return self._mapped(self._numbers(self.spans, 2), T.ArrayType(pair))(texts)

    def ids(self, texts: Column) -> Column:
        return self._mapped(self._numbers(self.encode, 1), T.ArrayType(T.IntegerType()))(texts)

    def texts(self, ids: Column) -> Column:
        def made(some: pa.Array) -> pa.Array:
            flat, ends = some.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(some).to_numpy())).tolist()
            return pa.array([self.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())

        return self._mapped(made, T.StringType())(ids)


def _sectioned(df: DataFrame, title: str, text: str) -> Column:
    """Array of (section, body, prefix) of a row."""
    marked = F.regexp_replace(unix_lines(F.col(text)), r"(?dm)^##\s+(.+?)\s*$", f"{_MARK}$1{_END}")
    headed = lambda p: F.struct(F.substring_index(p, _END, 1).alias("section"), strip(F.substring_index(p, _END, -1)).alias("body"))
    plain = lambda p: F.struct(F.lit(None).cast("string").alias("section"), strip(p).alias("body"))
    each = F.transform(F.split(marked, _MARK), lambda p, i: F.when(i > 0, headed(p)).otherwise(plain(p)))
    kept = F.when(F.size(each) == 1, each).otherwise(F.filter(each, lambda s: s["body"] != ""))
    own = lambda s: F.when(s["section"].isNotNull() & (F.lower(s["section"]) != F.lower(title)), F.concat(F.lit("\n\n"), s["section"])).otherwise("")
    return F.transform(kept, lambda s: F.struct(s["section"].alias("section"), s["body"].alias("body"), F.concat(F.col(title), own(s), F.lit("\n\n")).alias("prefix")))


def chunk(df: DataFrame, minimum: int = MINIMUM, target: int = TARGET, maximum: int = MAXIMUM, overlap: int = OVERLAP, key: str = "document_id", title: str = "title", text: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """df's rows as chunks, with their other columns: chunk_id, ordinal, section, token_count and text; a chunk carries title and heading.

    A section that fits under ``maximum`` with its prefix stays whole; others are cut by ``windows``. All of it happens
    within the row, so nothing is shuffled and rows that share an id are numbered apart.
    """
    if not 0 <= overlap < target <= maximum:
        raise ValueError("chunk sizes must satisfy 0 <= overlap < target <= maximum")
    rows = df.withColumn("_s", _sectioned(df, title, text))

    def cuts(used: Column, n: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("end")))
        return F.when(used + n <= maximum, whole).otherwise(windows(n, F.greatest(F.lit(1), F.lit(target) - used), minimum, overlap))

    def made(s: Column, passage: Column) -> Column:
        return F.struct(s["section"].alias("section"), strip(F.concat(s["prefix"], passage)).alias("text"))

    if tokenizer is None:

        def of(s: Column) -> Column:
            taken = F.array(F.struct(F.regexp_extract_all(s["body"], F.lit(r"\S+\s*"), F.lit(0)).alias("t"), F.size(words(s["prefix"])).alias("used")))  # an array of one, so that it is made once
            return F.flatten(F.transform(taken, lambda x: F.transform(cuts(x["used"], F.size(x["t"])), lambda w: made(s, strip(F.array_join(F.slice(x["t"], w["start"] + 1, w["end"] - w["start"]), ""))))))

        rows = rows.withColumn("_c", F.flatten(F.transform("_s", of)))
    else:
        rows = rows.withColumn("_used", tokenizer.counts(F.col("_s.prefix"))).withColumn("_t", (tokenizer.offsets if tokenizer.spans else tokenizer.ids)(F.col("_s.body")))
        rows = rows.withColumn("_w", F.transform("_s", lambda s, i: cuts(F.get("_used", i), F.size(F.get("_t", i)))))
        if tokenizer.spans:

            def passage(s: Column, t: Column, w: Column, used: Column) -> Column:
                begin, end = F.get(t, w["start"])["begin"], F.get(t, w["end"] - 1)["end"]
                back = F.length(F.regexp_extract(F.reverse(F.substr(s["body"], F.lit(1), begin)), r"^\S*", 0))  # to the begin of the word, from behind, as a search for \S*\z tries every place
                return F.when(used + F.size(t) <= maximum, s["body"]).otherwise(F.substr(s["body"], begin - back + 1, end - begin + back))

            pieces = F.transform("_s", lambda s, i: F.transform(F.get("_w", i), lambda w: made(s, passage(s, F.get("_t", i), w, F.get("_used", i)))))
            rows = rows.withColumn("_c", F.flatten(pieces))
        else:
            def piece(s: Column, t: Column, w: Column, used: Column) -> Column:
                whole = used + F.size(t) <= maximum
                ids = F.when(~whole, F.slice(t, w["start"] + 1, w["end"] - w["start"]))
                return F.struct(s["section"].alias("section"), s["prefix"].alias("prefix"), F.when(whole, s["body"]).alias("body"), ids.alias("ids"))

            rows = rows.withColumn("_c", F.flatten(F.transform("_s", lambda s, i: F.transform(F.get("_w", i), lambda w: piece(s, F.get("_t", i), w, F.get("_used", i))))))
    kept = [c for c in df.columns if c not in (text, "section")]
    fallback = [F.col("section").alias("_section")] if "section" in df.columns else []
    out = rows.select(*kept, *fallback, F.posexplode("_c").alias("_at", "_c")).withColumn("ordinal", F.col("_at") + 1)
    if tokenizer and not tokenizer.spans:  # a window's ids become its text once each window is a row
        ids = F.coalesce("_c.ids", F.array().cast("array<int>"))
        out = out.withColumn("_p", F.get(tokenizer.texts(F.array(ids)), F.lit(0))).withColumn("_c", made(F.col("_c"), F.coalesce("_c.body", "_p")))
    count = F.size(words(F.col("_c.text"))) if tokenizer is None else F.get(tokenizer.counts(F.array("_c.text")), F.lit(0))
    name = F.concat(F.lit("chunk:"), F.substring(F.sha2(F.concat(F.col(key), F.char(F.lit(0)), F.col("ordinal").cast("string"), F.char(F.lit(0)), F.col("_c.text")), 256), 1, 24))
    section = F.coalesce("_c.section", "_section") if fallback else F.col("_c.section")
    return out.select(*kept, name.alias("chunk_id"), "ordinal", section.alias("section"), count.alias("token_count"), F.col("_c.text").alias("text"))


def keep_sized(chunks: DataFrame, least: int = 32) -> DataFrame:
    """Without tiny chunks, but for the category whose entries are short by nature."""
    return chunks.where(~((F.col("token_count") < least) & (F.col("category") != "knowledge_base")))
