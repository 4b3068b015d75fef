"""Commands: ``python -m corpusloom STAGE --root RAW --tables OUT --registry sources.toml [...]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.pipeline import Pipeline

STAGES = ("inventory", "probe", "ingest", "chunk", "embed", "index", "search", "status", "artifacts", "compact-state", "reset", "run")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--root", required=True, help="folder of raw files")
    p.add_argument("--tables", required=True, help="folder of the tables made")
    p.add_argument("--registry", required=True, help="TOML file of sources")
    p.add_argument("--source", action="append", help="only this source; may be given again")
    p.add_argument("--query", action="append", default=[], help="a query of search; may be given again")
    p.add_argument("--mode", choices=("bm25", "dense", "hybrid"), default="hybrid")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--candidates", type=int, default=50)
    p.add_argument("--held-out", action="append", help="a source kept out of the index; may be given again")
    p.add_argument("--resume", action="store_true", help="ingest only inputs that the ledger lacks")
    p.add_argument("--delete-documents", action="store_true", help="drop the documents once their chunks are written")
    p.add_argument("--yes", action="store_true", help="agree to reset")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    p = Pipeline(spark, args.root, args.tables, args.registry)
    if args.stage == "inventory":
        p.inventory().show(1000, False)
    if args.stage in ("ingest", "run"):
        p.ingest(args.source, args.resume)
    if args.stage in ("chunk", "run"):
        p.chunk(args.delete_documents)
    if args.stage in ("embed", "run"):
        p.embed()
    if args.stage in ("index", "run"):
        p.index(args.held_out)
    if args.stage == "search":
        found = p.search(args.query, args.top_k, args.candidates, args.mode, sources=args.source)
        found.select("query_id", "rank", "rrf_score", "chunk_id", "title", "text").orderBy("query_id", "rank").show(args.top_k * max(1, len(args.query)), 120)
    if args.stage in ("probe", "artifacts"):
        getattr(p, args.stage)().show(1000, False)
    if args.stage == "compact-state":
        p.compact()
    if args.stage == "reset":
        p.reset(args.yes)
    if args.stage in ("status", "run"):
        p.status().show(1000, False)


if __name__ == "__main__":
    main()
