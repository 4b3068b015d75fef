"""First-wins deduplication and the fingerprints that carry it over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest, paragraphs


def first_wins(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row for each key, the first by ``order``. Rows are limited in each task before the shuffle, so a hot key moves one row a task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def length_gate(df: DataFrame, text: str = "text", least: int = 200) -> DataFrame:
    return df.withColumn("rejected", F.when(F.coalesce(F.length(text), F.lit(0)) < least, "too_short"))


def paragraph_dedup(df: DataFrame, order: list[str], key: str = "document_id", scope: str = "source_id", text: str = "text", least: int = 180, seen: DataFrame | None = None) -> DataFrame:
    """(key, text, removed): long paragraphs kept where they come first in their scope, short ones always, joined again in order.

    The first place of each paragraph is a combinable minimum joined back, not a window over all its places. Paragraphs that
    ``seen(kind, digest, owner)`` has of other inputs are dropped too; the row's own input is its source_path.
    """
    own = ["source_path"] if seen is not None else []
    parts = df.select(key, scope, *dict.fromkeys(c for c in [*order, *own] if c not in (key, scope)), F.posexplode(paragraphs(F.col(text))).alias("at", "p"))
    parts = parts.withColumn("long", F.length("p") >= least).withColumn("d", digest(F.col("p"))).withColumn("place", F.struct(*order, key, "at"))
    first = parts.where("long").groupBy(scope, "d").agg(F.min("place").alias("first"))
    marked = parts.join(first, [scope, "d"], "left").withColumn("keep", ~F.col("long") | (F.col("place") == F.col("first")))
    if seen is not None:
        new = unseen(marked.where("long and keep"), seen, F.concat(F.lit("paragraph:"), scope), F.col("d"), "source_path").select(key, "at", F.lit(True).alias("new"))
        marked = marked.join(new, [key, "at"], "left").withColumn("keep", F.col("keep") & (~F.col("long") | F.coalesce("new", F.lit(False))))
    kept = F.sort_array(F.collect_list(F.when(F.col("keep"), F.struct("at", "p"))))
    return marked.groupBy(key).agg(kept.alias("k"), F.count_if(~F.col("keep")).alias("removed")).select(key, F.array_join("k.p", "\n\n").alias("text"), "removed")


def paragraph_marks(df: DataFrame, least: int, scope: str = "source_id", text: str = "text") -> DataFrame:
    """(kind, digest, owner) of the long paragraphs of df, once an input."""
    each = df.select(scope, "source_path", F.explode(paragraphs(F.col(text))).alias("p")).where(F.length("p") >= least)
    return each.select(F.concat(F.lit("paragraph:"), scope).alias("kind"), digest(F.col("p")).alias("digest"), F.col("source_path").alias("owner")).distinct()


def unseen(df: DataFrame, fingerprints: DataFrame, kind: Column, fingerprint: Column, owner: str) -> DataFrame:
    """Rows whose (kind, digest) no other input has left in ``fingerprints(kind, digest, owner)``; an input's own rows don't count."""
    seen = fingerprints.select(F.col("kind").alias("_k"), F.col("digest").alias("_d"), F.col("owner").alias("_o"))
    return df.join(seen, (kind == F.col("_k")) & (fingerprint == F.col("_d")) & (F.col(owner) != F.col("_o")), "left_anti")


def remembered(fingerprints: DataFrame, df: DataFrame, kind: Column, fingerprint: Column, owner: str) -> DataFrame:
    """The fingerprint table after ``df``: the first owner of each digest stays."""
    fresh = df.select(kind.alias("kind"), fingerprint.alias("digest"), F.col(owner).alias("owner"), F.lit(1).alias("age"))
    both = fingerprints.select("kind", "digest", "owner", F.lit(0).alias("age")).unionByName(fresh)
    return first_wins(both, ["kind", "digest"], "age", "owner").drop("age")
