"""Input discovery: files of each source, their size and change token."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import signature

SOURCE_SCHEMA = "source_id string, category string, parser string, license_id string, priority int, trusted_unique boolean, paragraph_dedup boolean, structured_cleaning boolean, compression_level int, patterns array<string>, extra string"
DEFAULTS = {"category": "uncategorised", "priority": 100, "trusted_unique": False, "paragraph_dedup": True, "structured_cleaning": False, "compression_level": 6, "patterns": []}


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """The ``[[sources]]`` of a TOML file as rows, defaults filled in, other keys as JSON in extra; a missing id is an error."""
    names = [c.split()[0] for c in SOURCE_SCHEMA.split(", ")]
    rows = []
    for s in _toml(path).get("sources", []):
        if not s.get("id"):
            raise ValueError("a source needs an id")
        own = DEFAULTS | {"source_id": s["id"], "extra": json.dumps({k: v for k, v in s.items() if k not in names and k != "id"}, sort_keys=True, default=str)} | {k: v for k, v in s.items() if k in names}
        rows.append(tuple(own.get(n) for n in names))
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def load_settings(path: str) -> dict:
    """The ``[pipeline]`` table of a TOML file: sizes of the stages and names of folders and models; empty where it has none."""
    return dict(_toml(path).get("pipeline", {}))


def _toml(path: str) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def load_env(text: str) -> dict[str, str]:
    """``KEY=VALUE`` lines; comments, blank lines and lines without a name left out, quotes around a value taken off."""
    pairs = (line.removeprefix("export ").partition("=") for raw in text.splitlines() if (line := raw.strip()) and not line.startswith("#"))
    return {k.strip(): v.strip()[1:-1] if v.strip()[:1] in "\"'" and v.strip()[-1:] == v.strip()[:1] and len(v.strip()) > 1 else v.strip() for k, eq, v in pairs if eq and k.strip()}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark reports of files under it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def select_sources(sources: DataFrame, wanted: list[str] | None) -> DataFrame:
    """The wanted sources; an id that isn't there is an error."""
    if not wanted:
        return sources
    found = sources.where(F.col("source_id").isin(wanted))
    if missing := set(wanted) - {r.source_id for r in found.select("source_id").collect()}:
        raise ValueError(f"unknown sources: {sorted(missing)}")
    return found


def discover(spark: SparkSession, root: str, sources: DataFrame) -> DataFrame:
    """(source_id, category, parser, path, bytes, signature): files under ``root`` that match a source's patterns.

    A file that several sources match goes to the first by priority, id and order of the pattern; partial downloads
    (``.part``) are left out. Only the file listing is read, no content.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"), "modificationTime")
    base = len(qualified(spark, root).rstrip("/")) + 1
    rel = listed.withColumn("relative", F.substr("path", F.lit(base + 1))).where(~F.col("path").endswith(".part"))
    wants = sources.select("source_id", "category", "parser", "priority", F.posexplode("patterns").alias("pattern_no", "pattern"))
    # a glob as a regular expression: ** over folders, * and ? within one
    glob = F.regexp_replace("pattern", r"([.+^$()\[\]{}|\\])", r"\\$1")
    glob = F.regexp_replace(F.regexp_replace(F.regexp_replace(glob, r"\*\*/", "\u0001"), r"\*", "[^/]*"), r"\?", "[^/]")
    wants = wants.withColumn("form", F.concat(F.lit("^"), F.replace(glob, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("$")))
    met = rel.join(F.broadcast(wants), F.expr("relative rlike form"))  # one row a pattern of the registry
    first = F.row_number().over(Window.partitionBy("path").orderBy("priority", "source_id", "pattern_no"))
    one = met.withColumn("_k", first).where("_k = 1")
    return one.select("source_id", "category", "parser", "path", "relative", "bytes", signature(F.col("bytes"), F.col("modificationTime")).alias("signature"))


def inventory(found: DataFrame) -> DataFrame:
    """(source_id, files, bytes), with the total in the row of null source_id."""
    return found.rollup("source_id").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def magic(content):
    """What the first bytes of a file say it is."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head.startswith("1F8B"), "gzip").when(head.startswith("504B"), "zip").when(head.startswith("425A68"), "bzip2").when(head == "255044462D", "pdf").when(F.length(content) == 0, "empty").otherwise("other")


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(stage, files, bytes) of each folder right under ``root``; markers and checksums of the writer don't count."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = len(qualified(spark, root).rstrip("/")) + 1
    rel = F.substr("path", F.lit(base + 1))
    rows = listed.select(F.substring_index(rel, "/", 1).alias("stage"), "length").where(rel.contains("/"))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
