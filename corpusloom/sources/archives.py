"""Files that hold files or vectors: archives, their members and integrity, and vector shards. Each file is read by one task, piece by piece."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import safe_members

PIECE = 1 << 20


def _open(raw: bytes):
    """The content as a stream, unpacked where its first bytes say it is packed, whatever its name."""
    return gzip.open(io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else bz2.open(io.BytesIO(raw)) if raw[:3] == b"BZh" else io.BytesIO(raw)


def _members(raw: bytes) -> Iterator[tuple[str, bytes]]:
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
    else:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()


def members(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, name, content) of each file in tar and zip archives, packed or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                for name, content in _members(raw):
                    yield pa.RecordBatch.from_pydict({"path": [path], "name": [name], "content": pa.array([content], pa.binary())})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, name string, content binary")


def text_members(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, name, text): the safe text members, unpacked once more where they are packed themselves."""
    plain = F.pandas_udf(lambda s: s.map(lambda raw: _open(bytes(raw)).read().decode("utf-8", "replace")), "string")
    inner = F.regexp_replace("name", r"(?i)\.(gz|bz2)$", "")
    return safe_members(members(spark, paths).withColumn("_inner", inner), "_inner").select("path", "name", plain("content").alias("text"))


def json_rows(spark: SparkSession, paths: list[str], member: str) -> DataFrame:
    """(path, name, line_no, value): lines of the one member of each archive that is ``member`` or its unpacked form; none or several is an error."""
    stem = member.removesuffix(".gz")
    found = text_members(spark, paths).where(F.regexp_replace(F.element_at(F.split("name", "/"), -1), r"\.gz$", "") == stem)
    counts = found.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    if (bad := counts.where("n <> 1").first()) or counts.count() != len(set(paths)):
        raise ValueError(f"not exactly one {member} in {bad.path if bad else 'an archive'}")
    lines = found.select("path", "name", F.posexplode(F.split("text", "\n")).alias("at", "value"))
    return lines.where(F.trim("value") != "").select("path", "name", (F.col("at") + 1).alias("line_no"), "value")


def _verdict(name: str, raw: bytes) -> str:
    """ok, or what is wrong with a file, by its suffix."""
    low = name.lower()
    if not raw:
        return "empty file"
    try:
        if low.endswith((".tar.gz", ".tgz", ".tar", ".zip")):
            names = [n for n, _ in _members(raw)]  # reading a member checks it
            unsafe = [n for n in names if n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/")]
            return "empty archive" if not names else f"unsafe member: {unsafe[0]}" if unsafe else "ok"
        if low.endswith((".gz", ".bz2")):
            packed = (gzip if low.endswith(".gz") else bz2).open(io.BytesIO(raw))
            while packed.read(PIECE):
                pass
        elif low.endswith((".xml", ".nxml")) and b"<" not in raw[:4096]:
            return "no XML tag"
        elif low.endswith(".json"):
            json.loads(raw.decode("utf-8"))
        elif low.endswith(".pdf") and raw[:5] != b"%PDF-":
            return "no PDF signature"
    except (OSError, EOFError, ValueError, tarfile.TarError, zipfile.BadZipFile, zlib.error) as e:
        return f"integrity: {type(e).__name__}"
    return "ok"


def checked(files: DataFrame) -> DataFrame:
    """``files(path, content)`` as (path, bytes, sha256, verdict)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            verdict = [_verdict(p, c or b"") for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.select(["path", "bytes", "sha256"]).columns, pa.array(verdict, pa.string())], ["path", "bytes", "sha256", "verdict"])

    rows = files.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")
    return rows.mapInArrow(run, "path string, bytes long, sha256 string, verdict string")


def vector_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, at, embedding): rows of ``.npy`` shards, counted from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows = np.load(io.BytesIO(raw)).astype(np.float32)
                for a in range(0, len(rows), 10_000):
                    some = rows[a : a + 10_000]
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * some.shape[1]), pa.array(some.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(np.arange(a, a + len(some))), flat], ["path", "at", "embedding"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, at long, embedding array<float>")
