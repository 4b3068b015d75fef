"""Manifest upserts, resume ledger, running budgets and range checks: loops with state as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import micros
from .dedup import first_wins
from .planning import placed


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key, the last by ``order``, nulls first. Rows are limited in each task before the shuffle, so a hot
    key moves one row a task, and only columns that are used later are read."""
    return first_wins(df, keys, *[F.col(c).desc_nulls_last() for c in order])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], refresh: list[str], fill: list[str], keep: list[str]) -> DataFrame:
    """``old`` after ``new`` is merged in: ``refresh`` columns take the new value, ``fill`` columns where it isn't null,
    ``keep`` columns stay as they were; rows on one side only come through."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = on[0]
    for c in on[1:]:
        met = met & c
    there = F.col(f"b._there").isNotNull()
    both = a.withColumn("_was", F.lit(True)).alias("a").join(b.withColumn("_there", F.lit(True)).alias("b"), met, "full")
    out = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
    out += [F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in refresh]
    out += [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in fill]
    out += [F.when(F.col("a._was").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in keep]
    return both.select(*out)


def merged_snapshot(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Prior and new rows by key, the new one where both have it."""
    return new.unionByName(prior.join(new.select(key), key, "left_anti"))


def resume(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """``inputs`` with action: process where the ledger lacks the key, skip where the signature is the same, else changed."""
    known = done.select(*keys, F.col("signature").alias("_done"))
    state = F.when(F.col("_done").isNull(), "process").when(F.col("_done") == F.col("signature"), "skip").otherwise("changed")
    return inputs.join(known, keys, "left").withColumn("action", state).drop("_done")


def running_budget(df: DataFrame, scope: list[str], order: list[str], size: str, cap: int) -> DataFrame:
    """df with used, the running sum within the scope, and fits: whether it is still under the cap."""
    return placed(df, scope, order, size).withColumnRenamed("_sum", "used").drop("_at").withColumn("fits", F.col("used") <= cap)


def gaps(segments: DataFrame, key: str, start: str, count: str) -> DataFrame:
    """Segments that do not begin where the ones before end."""
    before = Window.partitionBy(key).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("expected", F.coalesce(F.sum(count).over(before), F.lit(0))).where(F.col("expected") != F.col(start))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of the left side that the right side lacks; empty where a reference holds."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def unequal_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_rows, right_rows) where the sides have different numbers of rows."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_rows"))
    both = a.join(b, key, "full").fillna(0, ["left_rows", "right_rows"])
    return both.where(F.col("left_rows") != F.col("right_rows"))


def stage_signature(size: Column, changed: Column, revision: str, **settings: object) -> Column:
    """Change token of a stage's input: the file's own token and the settings that shape its output."""
    extra = "".join(f":{k}{v}" for k, v in settings.items())
    return F.concat(size.cast("string"), F.lit(":"), micros(changed).cast("string"), F.lit(f":{revision}{extra}"))


def enrich(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents with what the manifest knows of their file: license and address where it has them, and acquisition,
    the rest as JSON without nulls. A file is known by its path, or by the path its error text says it was normalized to."""
    moved = F.nullif(F.regexp_extract("error", r"normalized to (\S+)", 1), F.lit(""))
    keyed = manifest.withColumn("path_key", F.explode(F.array_compact(F.array("local_path", moved))))
    last = keyed.groupBy("path_key").agg(F.max_by(F.struct("url", "metadata", "status", "sha256", "actual_bytes", "updated_at"), "updated_at").alias("m"))
    own = F.get_json_object("m.metadata", "$.license_id")
    acquired = F.to_json(F.struct(F.col("m.status").alias("status"), F.col("m.sha256").alias("sha256"), F.col("m.actual_bytes").alias("bytes"), F.get_json_object("m.metadata", "$.license_state").alias("license_state")))
    rows = documents.withColumn("_url", F.col("url")).withColumn("_license", F.col("license_id")).drop("url", "license_id").join(last, F.col("source_path") == F.col("path_key"), "left")
    return rows.withColumn("url", F.coalesce("_url", "m.url")).withColumn("license_id", F.coalesce(own, "_license")).withColumn("acquisition", F.when(F.col("m").isNotNull(), acquired)).drop("_url", "_license", "path_key", "m")


def first_reason(reasons: dict[str, Column], otherwise: str = "accepted") -> Column:
    """The name of the first condition that holds, in the order given; null conditions don't hold."""
    out = None
    for name, met in reasons.items():
        out = F.when(met, name) if out is None else out.when(met, name)
    return out.otherwise(otherwise)


def changed_fields(rows: DataFrame, changes: DataFrame, keys: list[str], allowed: list[str], by: str) -> DataFrame:
    """``rows`` after ``changes(keys, field, value, by)``: the last value of each field of each row; fields outside ``allowed`` are an error."""
    other = changes.where(~F.col("field").isin(allowed)).select("field").limit(1).collect()
    if other:
        raise ValueError(f"not a field that may change: {other[0].field}")
    last = [F.max_by(F.struct("value"), F.when(F.col("field") == c, F.col(by))).alias(f"_{c}") for c in allowed]
    new = changes.groupBy(*keys).agg(*last)
    pick = [F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value").cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in allowed else F.col(c) for c in rows.columns]
    return rows.join(new, keys, "left").select(*pick)


def compared(rows: DataFrame, sums: DataFrame, name: str, checksum: str) -> DataFrame:
    """``rows`` with verdict: same, other, unknown (no checksum of their own) or unlisted, by the lines ``sums(name, digest)`` of checksum files."""
    listed = sums.groupBy(F.col("name").alias(name)).agg(F.min(F.lower("digest")).alias("_listed"))
    own = F.lower(checksum)
    verdict = first_reason({"unlisted": F.col("_listed").isNull(), "unknown": own.isNull(), "same": own == F.col("_listed")}, "other")
    return rows.join(listed, name, "left").withColumn("verdict", verdict).drop("_listed")
