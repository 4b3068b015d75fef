"""Streams: the state of runs from their events, and ingestion that takes up new inputs only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import digest
from ..operators.dedup import first_wins, remembered, unseen
from ..sources.files import exists

EVENT = "run_id string, seq long, kind string, event_id string, payload string"
STATE = "seqs array<long>, kinds array<string>, ids array<string>, payloads array<string>"
RUN = "run_id string, trace_ids array<string>, trace array<string>, markdown string, status string, error string, seq long"


def fold(events: dict[int, tuple]) -> tuple:
    """The state after events (kind, id, payload) by seq: a trace event replaces its id's and moves to the end, text is
    appended, completion replaces the text, failure sets the error."""
    trace: dict = {}
    markdown, status, error = "", "running", None
    for seq in sorted(events):
        kind, event_id, payload = events[seq]
        if kind == "trace":
            trace.pop(event_id, None)
            trace[event_id] = payload
        elif kind == "delta":
            markdown += payload or ""
        elif kind == "completed":
            markdown, status = payload or markdown, "completed"
        elif kind == "failed":
            status, error = "failed", payload
    return list(trace), list(trace.values()), markdown, status, error, max(events, default=-1)


def needed(events: dict[int, tuple]) -> dict[int, tuple]:
    """The events a later fold still needs: no text before a completion that replaces it."""
    done = max((s for s, e in events.items() if e[0] == "completed" and e[2]), default=-1)
    return {s: e for s, e in events.items() if s >= done or e[0] != "delta"}


def run_states(events: DataFrame) -> DataFrame:
    """The state of each run after each micro-batch of ``events``.

    The events of a run are kept and folded in order of seq, so one that comes late, in whatever batch, takes its place, and
    a delivery that comes again changes nothing.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {s: (k, i, p) for s, k, i, p in zip(*state.get)} if state.exists else {}
        for f in frames:
            for r in f.itertuples(index=False):
                held.setdefault(int(r.seq), (r.kind, r.event_id, r.payload))
        held = needed(held)
        state.update(([*held], *([e[k] for e in held.values()] for k in range(3))))
        yield pd.DataFrame([(key[0], *fold(held))], columns=["run_id", "trace_ids", "trace", "markdown", "status", "error", "seq"])

    return events.groupBy("run_id").applyInPandasWithState(update, RUN, STATE, "update", GroupStateTimeout.NoTimeout)


def run_states_batch(events: DataFrame) -> DataFrame:
    """The same over all events at once, by windows and aggregates."""
    last = F.row_number().over(Window.partitionBy("run_id", "event_id").orderBy(F.desc("seq")))
    trace = events.where("kind = 'trace'").withColumn("k", last).where("k = 1").groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("seq", "event_id", "payload"))).alias("t"))
    done = F.max(F.when(F.col("kind") == "completed", F.struct("seq", "payload"))).alias("done")
    parts = F.sort_array(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "payload")))).alias("parts")
    failed = F.max(F.when(F.col("kind") == "failed", F.struct("seq", "payload"))).alias("failed")
    rest = events.groupBy("run_id").agg(done, parts, failed, F.max("seq").alias("seq"))
    from_seq = F.coalesce("done.seq", F.lit(-1))
    tail = lambda after: F.array_join(F.transform(F.filter("parts", lambda p: p["seq"] > after), lambda p: F.coalesce(p["payload"], F.lit(""))), "")
    before = F.array_join(F.transform(F.filter("parts", lambda p: p["seq"] < from_seq), lambda p: F.coalesce(p["payload"], F.lit(""))), "")
    base = F.when(F.col("done").isNotNull(), F.coalesce(F.nullif(F.col("done.payload"), F.lit("")), before)).otherwise("")
    status = F.when(F.coalesce("failed.seq", F.lit(-1)) > from_seq, "failed").when(F.col("done").isNotNull(), "completed").otherwise("running")
    return rest.join(trace, "run_id", "left").select(
        "run_id", F.coalesce("t.event_id", F.array().cast("array<string>")).alias("trace_ids"), F.coalesce("t.payload", F.array().cast("array<string>")).alias("trace"), F.concat(base, tail(from_seq)).alias("markdown"), status.alias("status"), F.col("failed.payload").alias("error"), "seq"
    )


def ingest_increments(stream: DataFrame, out: str, fingerprints: str, checkpoint: str, kind: str = "document"):
    """Documents of a file stream that no earlier batch had, appended to ``out``; every batch works against the fingerprints of
    those before, which live in a table and survive a restart. Takes what is there and stops.

    A batch that is run again after a failure finds its own fingerprints under its number and takes its rows again.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        owner = F.lit(f"batch-{number}")
        rows = first_wins(df.withColumn("digest", digest(F.col("text"))), ["source_id", "digest"], "document_id").withColumn("owner", owner)
        known = "kind string, digest string, owner string"
        seen = spark.read.schema(known).parquet(fingerprints) if exists(spark, fingerprints) else spark.createDataFrame([], known)
        scope = F.concat(F.lit(f"{kind}:"), "source_id")
        fresh = unseen(rows, seen, scope, F.col("digest"), "owner")
        added = remembered(seen.limit(0), fresh, scope, F.col("digest"), "owner")
        fresh.drop("digest", "owner").write.mode("overwrite").parquet(f"{out}/batch={number}")
        added.write.mode("overwrite").parquet(f"{fingerprints}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
