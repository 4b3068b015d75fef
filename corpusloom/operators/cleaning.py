"""Line-wise cleaning as windows and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BOILERPLATE_HEADINGS, nfkc, repair, squeeze, strip, unix_lines


def lines(df: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """(key, line_no, line): stripped lines, counted from 1."""
    each = df.select(key, F.posexplode(F.split(unix_lines(F.col(text)), "\n")).alias("at", "raw"))
    return each.select(key, (F.col("at") + 1).alias("line_no"), strip(F.col("raw")).alias("line"))


def tail_marked(every: DataFrame, key: str = "document_id") -> DataFrame:
    """``lines`` with in_tail: from a boilerplate heading to the next second-level heading that is none.

    Each line is an event (starts a tail, ends one) or none; the last event so far decides.
    """
    heading = F.lower(F.regexp_replace("line", "^[# ]+", ""))
    event = F.when(heading.isin(BOILERPLATE_HEADINGS), 1).when(F.col("line").startswith("## "), 0)
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("in_tail", F.coalesce(F.last(event, ignorenulls=True).over(so_far), F.lit(0)) == 1)


def is_address(line=None):
    return F.col("line").rlike(r"(?i)^https?://\S+$")


def is_contents():
    return F.lower("line").isin("contents", "table of contents")


def without_boilerplate(text: Column) -> Column:
    """Squeezed text without tails, address-only lines and contents lines, within the row: a tail goes from its heading's line to the
    next second-level heading that opens none."""
    heading = "[# ]*(?:" + "|".join(BOILERPLATE_HEADINGS) + ")$"
    out = F.regexp_replace(text, rf"(?dims)^{heading}.*?(?=^## (?!{heading})|\z)", "")
    out = F.regexp_replace(out, r"(?dmi)^(?:https?://\S+|(?:table of )?contents)(?:\n|\z)", "")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """df with text repaired and without boilerplate; rows are cleaned apart, whatever ids they share."""
    return df.withColumn(text, without_boilerplate(squeeze(repair(F.col(text)))))


def clean_structured(df: DataFrame, text: str = "text") -> DataFrame:
    """For sources that are structured already: characters and white space only."""
    return df.withColumn(text, squeeze(nfkc(F.col(text))))
