"""Writers. Each output is published by Spark's commit protocol, whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ledger import first_reason
from ..operators.planning import next_fit


def jsonl(df: DataFrame, path: str, rows_a_file: int = 0) -> None:
    """Gzipped JSON lines, null fields left out; at most ``rows_a_file`` rows in a file where given."""
    out = df.write.mode("overwrite").option("compression", "gzip")
    (out.option("maxRecordsPerFile", rows_a_file) if rows_a_file else out).json(path)


def documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by source, so that a run over some sources reads only theirs."""
    df.write.mode(mode).partitionBy("source_id").parquet(path)


def rejections(df: DataFrame, path: str, stage: str, mode: str = "overwrite") -> None:
    """Why each rejected row was, from the same plan that decides it."""
    kept = df.select(F.lit(stage).alias("stage"), "reason", "document_id", "source_id", "source_path", "original_chars", "detail")
    kept.write.mode(mode).partitionBy("reason").parquet(path)


def report(df: DataFrame, path: str) -> None:
    """A stage's counts as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def size_capped(df: DataFrame, size: str, order: str, cap: int) -> DataFrame:
    """df with bundle: a new one begins before a row that would take the running one over ``cap``, so only a row larger than
    that is in one that exceeds it. Bundles are filled within each range of the order."""
    ranged = df.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    return next_fit(ranged, ["_p"], [order], size, cap, "_b").withColumn("bundle", F.concat_ws("-", "_p", "_b")).drop("_p", "_b")


def vectors(df: DataFrame, path: str, signature: str, model: str) -> None:
    """(chunk_id, embedding) with a marker beside it, written last: rows, dimensions, an order-free digest of the rows, model and signature of the input."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    one = F.xxhash64("chunk_id", F.transform("embedding", lambda x: x.cast("float")))
    back.agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).alias("dimensions"), F.bit_xor(one).alias("digest"), F.lit(model).alias("model"), F.lit(signature).alias("signature")).write.mode("overwrite").parquet(f"{path}.complete")


def imported(segments: DataFrame, vectors_: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard, position, embedding): vectors of jobs put back to the shards they came from.

    ``segments(job, shard, original_start, count, output_offset, signature)`` tell which rows of a job's ``vectors_(job, at, embedding)``
    belong where; ``shards(shard, signature, records)`` is what is there now. Segments that don't tile a shard, of a shard that
    changed or is missing, or that don't add up to its records, are an error.
    """
    held = segments.join(shards.select("shard", F.col("signature").alias("_now"), "records"), "shard", "left")
    before = Window.partitionBy("shard").orderBy("original_start")
    due = F.coalesce(F.sum("count").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("count").over(Window.partitionBy("shard"))
    reason = first_reason({"missing": F.col("_now").isNull(), "changed": F.col("_now") != F.col("signature"), "gap": F.col("original_start") != due, "count": total != F.col("records")}, "")
    if bad := held.select("shard", reason.alias("reason")).where("reason <> ''").orderBy("shard").first():
        raise ValueError(f"segments of {bad.shard} can't be imported: {bad.reason}")
    s, v = segments.alias("s"), vectors_.alias("v")
    inside = (F.col("v.at") >= F.col("s.output_offset")) & (F.col("v.at") < F.col("s.output_offset") + F.col("s.count"))
    return v.join(s, (F.col("v.job") == F.col("s.job")) & inside).select("s.shard", (F.col("s.original_start") + F.col("v.at") - F.col("s.output_offset")).alias("position"), "v.embedding")


def safe_members(df: DataFrame, name: str = "name") -> DataFrame:
    """Archive members that are texts and stay inside the folder they are unpacked to."""
    n = F.col(name)
    text = F.lower(n).rlike(r"\.(txt|xml|nxml|json|jsonl|csv|tsv|md|html?)$")
    return df.where(text & ~n.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(F.split(n, r"[/\\]"), ".."))
