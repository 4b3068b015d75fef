"""Batches, windows of dates, samples and packing of work."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

DIMENSIONS = 768


def placed(df: DataFrame, scope: list[str], order: list[str], size: str | None = None) -> DataFrame:
    """df with _at, the row's number in its scope from 1, and, where a size is named, _sum, the sizes up to it added.

    Rows are dealt by ranges of scope and order, so a scope that holds most rows is spread over tasks; each range counts its
    own, and what those before it hold (a row a range and scope) is added.
    """
    keyed = df.withColumn("_scope", F.to_json(F.struct(*scope)))
    ranged = cut(keyed.repartitionByRange(*scope, *order).withColumn("_part", F.spark_partition_id()))  # partitions must not change between the uses
    n = F.coalesce(F.col(size), F.lit(0)).cast("long") if size else F.lit(0).cast("long")
    before = Window.partitionBy("_scope").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy("_part", "_scope").agg(F.count(F.lit(1)).alias("_c"), F.sum(n).alias("_s"))
    offsets = held.select("_part", "_scope", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"))
    local = Window.partitionBy("_part", "_scope").orderBy(*order)
    own = ranged.withColumn("_at", F.row_number().over(local)).withColumn("_sum", F.sum(n).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    out = own.join(offsets, ["_part", "_scope"]).withColumn("_at", F.col("_at") + F.col("_c")).withColumn("_sum", F.col("_sum") + F.col("_s"))
    return out.drop("_part", "_scope", "_c", "_s", *([] if size else ["_sum"]))


def batches(df: DataFrame, scope: list[str], order: list[str], size: int, item: str) -> DataFrame:
    """(scope, batch, items): fixed-size batches in order."""
    at = placed(df.select(*dict.fromkeys([*scope, *order, item])), scope, order).withColumn("batch", F.floor((F.col("_at") - 1) / size))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_at", item))), lambda s: s[item])
    return at.groupBy(*scope, "batch").agg(ordered.alias("items"))


def segments(df: DataFrame, scope: list[str], order: list[str], most: int) -> DataFrame:
    """(scope, segment, original_start, rows): row-capped splits and where each begins."""
    at = placed(df.select(*scope, *order), scope, order).withColumn("segment", F.floor((F.col("_at") - 1) / most))
    return at.groupBy(*scope, "segment").agg((F.min("_at") - 1).cast("long").alias("original_start"), F.count(F.lit(1)).alias("rows"))


def next_fit(df: DataFrame, scope: list[str], order: list[str], size: str, most: int, name: str = "job") -> DataFrame:
    """df with job: a new job begins where the running one isn't empty and would exceed ``most``.

    Where a job begins depends on all before it, so the rows of a scope are read in order by one task, which holds one batch of
    them at a time. They are tasks or files of capped size, few beside the rows they stand for.
    """
    rows = df.repartition(*scope).sortWithinPartitions(*scope, *order)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, job, used = None, 0, 0
        for b in found:
            jobs = []
            for k, n in zip(zip(*(b.column(c).to_pylist() for c in scope)), b.column(size).to_pylist()):
                n = n or 0
                if k != key:
                    key, job, used = k, 0, 0
                elif used > 0 and used + n > most:
                    job, used = job + 1, 0
                used += n
                jobs.append(job)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(jobs, pa.int32())], [*b.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.IntegerType())]))


def job_records(packed: DataFrame, scope: str, size: str) -> DataFrame:
    """(job, tasks, chunks, per_source) of ``next_fit`` over all: what each job holds, and of which sources."""
    each = packed.groupBy("job", scope).agg(F.count(F.lit(1)).alias("t"), F.sum(size).alias("c"))
    per = F.map_from_entries(F.sort_array(F.collect_list(F.struct(scope, "c"))))
    return each.groupBy("job").agg(F.sum("t").alias("tasks"), F.sum("c").alias("chunks"), per.alias("per_source"))


def date_windows(spark: SparkSession, first: date, last: date, days: int = 7) -> DataFrame:
    """(start, end): windows of ``days`` from the first day on, the last one clipped."""
    if last < first:
        raise ValueError("the window must not end before it starts")
    base = spark.range(1).select(F.lit(first).cast("date").alias("a"), F.lit(last).cast("date").alias("b"))
    each = base.select("b", F.explode(F.sequence("a", "b", F.expr(f"interval {days} days"))).alias("start"))
    return each.select("start", F.least(F.date_add("start", days - 1), F.col("b")).alias("end"))


def even_sample(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``size`` rows spread evenly over the order, the first and the last among them; all rows where there are no more."""
    placed = numbered(df, order, "_at").withColumn("_at", F.col("_at") - 1)
    n = df.count()
    if n <= size:
        return placed.drop("_at")
    wanted = df.sparkSession.range(size).select((F.col("id") * (n - 1) / max(1, size - 1)).cast("long").alias("_at")).distinct()
    return placed.join(F.broadcast(wanted), "_at").drop("_at")  # as many rows as the sample


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a global row number from 1, without one task that holds all rows.

    Rows are sorted over partitions; each counts its own, and the sums of those before (a row a partition) are added.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # partitions must not change between the two uses
    counts = ranged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_local", local).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def profile_plan(by_source: DataFrame, profiles: DataFrame, rate: float = 100.0, gpus: int = 1) -> DataFrame:
    """(profile, sources, chunks, fp16_gib, sq8_gib, eta_hours); ``profiles(profile, source_id)`` may overlap."""
    total = profiles.join(by_source, "source_id").groupBy("profile").agg(F.count(F.lit(1)).alias("sources"), F.sum("chunks").alias("chunks"))
    return total.select(
        "profile",
        "sources",
        "chunks",
        F.round(F.col("chunks") * (2 * DIMENSIONS) / 1024.0**3, 6).alias("fp16_gib"),
        F.round(F.col("chunks") * DIMENSIONS / 1024.0**3, 6).alias("sq8_gib"),
        F.round(F.col("chunks") / (rate * gpus) / 3600, 6).alias("eta_hours"),
    )


def reachable(links: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(url, depth): pages reached from the seeds, each once and at its least number of steps; one join a step. With ``most``, a crawl's
    limit of pages, those of a step in order of their address as far as they fit."""
    step = links.select(F.col("source").alias("url"), F.col("target").alias("next"))
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    edge = seen
    room = None if most is None else most - seen.count()
    for k in range(1, depth + 1):
        if room is not None and room <= 0:
            break
        ahead = edge.select("url").join(step, "url").select(F.col("next").alias("url")).distinct()
        fresh = ahead.join(seen.select("url"), "url", "left_anti")
        edge = cut((fresh if room is None else fresh.orderBy("url").limit(room)).withColumn("depth", F.lit(k)))
        room = None if room is None else room - edge.count()
        seen = seen.unionByName(edge)
    return seen
