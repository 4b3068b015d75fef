"""The stages end to end: discover, ingest, chunk, embed, index, search, status, each a DataFrame or a written table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import digest
from ..operators import chunking, cleaning, dedup, ledger, planning, retrieval
from ..session import written
from ..sources import files, parsers, sinks


@dataclass(frozen=True)
class Settings:
    """Sizes of the stages."""

    min_document_chars: int = 200
    min_paragraph_chars: int = 180
    minimum: int = chunking.MINIMUM
    target: int = chunking.TARGET
    maximum: int = chunking.MAXIMUM
    overlap: int = chunking.OVERLAP
    min_chunk_tokens: int = 32
    dimensions: int = 64

    @classmethod
    def of(cls, named: dict) -> Settings:
        """From the names a configuration file gives them."""
        names = {"min_document_chars": "min_document_chars", "paragraph_dedup_min_chars": "min_paragraph_chars", "chunk_min_tokens": "minimum", "chunk_target_tokens": "target", "chunk_max_tokens": "maximum", "chunk_overlap_tokens": "overlap", "min_chunk_output_tokens": "min_chunk_tokens"}
        return cls(**{own: int(named[k]) for k, own in names.items() if k in named})


def hash_encoder(dimensions: int) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of hashed words: the encoder where no model is at hand."""

    def encode(texts: list[str]) -> np.ndarray:
        words = [(t or "").lower().split() for t in texts]
        names, at = np.unique(np.array([w for ws in words for w in ws], object), return_inverse=True) if any(words) else (np.zeros(0, object), np.zeros(0, np.int64))
        h = np.fromiter((xxhash.xxh32_intdigest(w) for w in names), np.int64, len(names))[at]
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        flat = np.bincount(row * dimensions + h % dimensions, np.where(h & 0x10000, 1.0, -1.0), len(texts) * dimensions)
        out = flat.reshape(len(texts), dimensions).astype(np.float32)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)

    return encode


FINGERPRINTS = "kind string, digest string, owner string"
LEDGER = "stage string, input_key string, signature string, records long, completed_at timestamp"
REJECTION = "stage string, document_id string, source_id string, source_path string, original_chars int, detail string, reason string"
CHUNK = "document_id string, category string, title string, source_path string, external_id string, url string, license_id string, authors array<string>, published string, metadata string, chunk_id string, ordinal int, section string, token_count int, text string, source_id string"


class Pipeline:
    """Stages over a folder of raw files and a folder of tables."""

    def __init__(self, spark: SparkSession, root: str, tables: str, registry: str, settings: Settings | None = None, tokenizer: chunking.Tokenizer | None = None):
        self.spark, self.root, self.tables, self.tokenizer = spark, root, tables, tokenizer
        self.sources = files.load_sources(spark, registry)
        self.settings = settings or Settings.of(files.load_settings(registry))

    def _path(self, name: str) -> str:
        return f"{self.tables}/{name}"

    def _table(self, name: str, schema: str | None = None) -> DataFrame:
        """A table; one whose schema is given may have no rows, or not be there yet."""
        if schema is None:
            return self.spark.read.parquet(self._path(name))
        if not files.exists(self.spark, self._path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name))

    def discover(self, wanted: list[str] | None = None) -> DataFrame:
        return files.discover(self.spark, self.root, files.select_sources(self.sources, wanted))

    def inventory(self) -> DataFrame:
        return files.inventory(self.discover())

    def parse(self, found: DataFrame) -> DataFrame:
        """Documents of the files in ``found``, and records that can't be parsed; a registry has few sources, each of which is one plan in a union."""
        listed = found.groupBy("source_id").agg(F.sort_array(F.collect_list("path")).alias("paths"))
        paths = {r.source_id: r.paths for r in listed.collect()}
        each = [parsers.parse(self.spark, paths[s.source_id], s.asDict()) for s in self.sources.collect() if s.source_id in paths]
        return reduce(DataFrame.unionByName, each, self.spark.createDataFrame([], parsers.PARSED))

    def probe(self) -> DataFrame:
        """(source_id, path, document_id, status, detail): the first document of the first file of each source; ok, short, empty or error."""
        first = dedup.first_wins(self.discover(), ["source_id"], "path")
        rows = dedup.first_wins(self.parse(first), ["source_id"], "source_path", "document_id")
        n = F.coalesce(F.length("text"), F.lit(0))
        status = ledger.first_reason({"error": F.col("error").isNotNull(), "empty": n == 0, "short": n < self.settings.min_document_chars}, "ok")
        out = first.select("source_id", "path").join(rows.select("source_id", "document_id", status.alias("status"), F.col("error").alias("detail")), "source_id", "left")
        return out.withColumn("status", F.coalesce("status", F.lit("empty")))

    def _pending(self, found: DataFrame, stage: str, key: str) -> DataFrame:
        """Inputs the ledger lacks; one that it has with another signature is an error."""
        state = ledger.resume(found, self._table("ledger", LEDGER).where(F.col("stage") == stage).select(F.col("input_key").alias(key), "signature"), [key])
        if changed := state.where("action = 'changed'").select(key).first():
            raise ValueError(f"an input changed since {stage}: {changed[0]}")
        return state.where("action = 'process'").drop("action")

    def _done(self, rows: DataFrame, stage: str, key: str, mode: str) -> None:
        """Inputs with their signature and records into the ledger, other stages' kept."""
        new = rows.select(F.lit(stage).alias("stage"), F.col(key).alias("input_key"), "signature", "records", F.current_timestamp().alias("completed_at"))
        if mode == "overwrite":
            new = written(new.unionByName(self._table("ledger", LEDGER).where(F.col("stage") != stage)))
        new.write.mode(mode).parquet(self._path("ledger"))

    def ingest(self, wanted: list[str] | None = None, resume: bool = False) -> tuple[DataFrame, DataFrame]:
        """Clean, gate and deduplicate; writes and returns accepted and rejected documents.

        Documents of trusted sources are deduplicated by id within a file, others by digest and, where the source says so, by
        paragraph within the source. With ``resume``, inputs the ledger has are left as they are, new ones are added, and what
        earlier ones hold counts as seen. Parsing and cleaning happen once: their rows are written before they are sorted out.
        """
        s = self.settings
        found = self.discover(wanted).withColumn("signature", F.concat("signature", F.lit(f":r1:min{s.min_document_chars}:p{s.min_paragraph_chars}")))
        if resume:
            found = written(self._pending(found, "ingest", "path"))
        kinds = self.sources.select("source_id", "trusted_unique", "structured_cleaning", "paragraph_dedup")
        raw = self.parse(found).join(F.broadcast(kinds), "source_id")  # one row a source
        cleaned = cleaning.clean_structured(raw.where("structured_cleaning")).unionByName(cleaning.clean(raw.where("not structured_cleaning")))
        rows = dedup.length_gate(cleaned, least=s.min_document_chars).withColumn("original_chars", F.length("text"))
        rows = rows.withColumn("rejected", F.when(F.col("error").isNotNull(), "parse_error").otherwise(F.col("rejected")))
        rows = written(rows.withColumn("digest", F.when(F.col("rejected").isNull() & ~F.col("trusted_unique"), digest(F.col("text")))).withColumn("row_id", F.monotonically_increasing_id()))
        passed = rows.where(F.col("rejected").isNull())
        trusted = dedup.first_wins(passed.where("trusted_unique"), ["source_path", "document_id"], "row_id")
        other = passed.where("not trusted_unique")
        seen = self._table("fingerprints", FINGERPRINTS)
        fresh = dedup.unseen(other, seen, F.concat(F.lit("document:"), "source_id"), F.col("digest"), "source_path") if resume else other
        first = written(dedup.first_wins(fresh, ["source_id", "digest"], "source_path", "document_id", "row_id"))
        long = first.where("paragraph_dedup")
        short = dedup.paragraph_dedup(long, ["source_path", "document_id"], key="row_id", least=s.min_paragraph_chars, seen=seen if resume else None)
        thinned = long.drop("text").join(short.select("row_id", "text"), "row_id")  # a document of only seen paragraphs is left with no text
        gated = dedup.length_gate(thinned.unionByName(first.where("not paragraph_dedup")).drop("rejected"), least=s.min_document_chars)
        late = gated.where(F.col("rejected").isNotNull()).withColumn("rejected", F.lit("too_short_after_deduplication"))
        twice = other.join(first.select("row_id"), "row_id", "left_anti").withColumn("rejected", F.lit("duplicate_document"))
        cols = ["document_id", "source_id", "source_path", "original_chars", F.col("error").alias("detail"), F.col("rejected").alias("reason")]
        rejected = reduce(DataFrame.unionByName, [x.select(*cols) for x in (rows.where(F.col("rejected").isNotNull()), twice, late)])
        accepted = trusted.unionByName(gated.where(F.col("rejected").isNull()), allowMissingColumns=True).select(*parsers.COLUMNS)
        mode = "append" if resume else "overwrite"
        sinks.documents(accepted, self._path("documents"), mode)
        sinks.rejections(rejected, self._path("rejections"), "ingest", mode)
        marks = first.select(F.concat(F.lit("document:"), "source_id").alias("kind"), "digest", F.col("source_path").alias("owner"))
        marks.unionByName(dedup.paragraph_marks(long, s.min_paragraph_chars)).write.mode(mode).parquet(self._path("fingerprints"))
        counts = rows.groupBy(F.col("source_path").alias("path")).agg(F.count(F.lit(1)).alias("records"))
        self._done(found.select("path", "signature").join(counts, "path", "left").fillna(0, ["records"]), "ingest", "path", mode)
        return self._table("documents", parsers.DOCUMENT), self._table("rejections", REJECTION)

    def compact(self) -> int:
        """Fingerprints are dropped, the ledger is kept, checked and written anew: one row an input and stage. Returns its rows."""
        kept = written(dedup.first_wins(self._table("ledger", LEDGER), ["stage", "input_key"], F.desc("completed_at")))
        if kept.where("stage is null or input_key is null or signature is null").count():
            raise ValueError("the ledger has rows without stage, input or signature")
        self.spark.createDataFrame([], FINGERPRINTS).write.mode("overwrite").parquet(self._path("fingerprints"))
        kept.write.mode("overwrite").parquet(self._path("ledger"))
        return kept.count()

    def reset(self, yes: bool = False) -> None:
        """Deletes the tables made here, and nothing else."""
        if not yes:
            raise ValueError("reset deletes all tables; say yes to do so")
        for name in ("documents", "rejections", "fingerprints", "ledger", "chunks", "embeddings", "embeddings.complete", "postings", "lengths", "store", "dense_map", "codes", "ranges"):
            files.delete(self.spark, self._path(name))

    def chunk(self, delete_documents: bool = False) -> DataFrame:
        s, docs = self.settings, self._table("documents", parsers.DOCUMENT)
        rows = chunking.chunk(docs.drop("schema_version"), s.minimum, s.target, s.maximum, s.overlap, tokenizer=self.tokenizer)
        rows = chunking.keep_sized(rows, s.min_chunk_tokens).withColumn("digest", digest(F.col("text")))
        sinks.documents(dedup.first_wins(rows, ["source_id", "digest"], "document_id", "ordinal", "chunk_id").drop("digest"), self._path("chunks"))
        if delete_documents:  # only after the chunks are written whole
            files.delete(self.spark, self._path("documents"))
        return self._table("chunks", CHUNK)

    def embed(self, encode: Callable[[list[str]], np.ndarray] | None = None, model: str = "hashed-words") -> DataFrame:
        """Vectors of all chunks; they are made again only where the chunks or the model changed."""
        make = encode or hash_encoder(self.settings.dimensions)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"chunk_id": f["chunk_id"], "embedding": list(make(f["text"].tolist()).astype(np.float32))})

        chunks = self._table("chunks", CHUNK)
        found = self._table("embeddings.complete").first() if files.exists(self.spark, self._path("embeddings.complete")) else None
        one = F.bit_xor(F.xxhash64("chunk_id"))
        signature = str(chunks.agg(F.concat_ws(":", F.count(F.lit(1)), one).alias("s")).first().s)
        if found is None or (found.signature, found.model) != (signature, model):  # else they are there, and no encoder is loaded
            rows = chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, embedding array<float>")
            sinks.vectors(rows, self._path("embeddings"), signature, model)
        return self._table("embeddings", "chunk_id string, embedding array<float>")

    def index(self, held_out: list[str] | None = None) -> DataFrame:
        """The index of the chunks, without held-out sources: postings by term, lengths, the numbered chunk store, the map
        from vectors to its rows, and 8-bit codes of the vectors with their ranges."""
        chunks = self._table("chunks", CHUNK)
        if held_out:
            chunks = chunks.where(~F.col("source_id").isin(held_out))
        by_term = retrieval.postings(chunks).repartitionByRange("term").sortWithinPartitions("term")  # files with few terms each, which a search prunes by
        by_term.write.mode("overwrite").parquet(self._path("postings"))
        retrieval.lengths(chunks).write.mode("overwrite").parquet(self._path("lengths"))
        store = planning.numbered(chunks.select("chunk_id", "source_id", "document_id", "ordinal", "metadata"), ["source_id", "document_id", "ordinal", "chunk_id"], "row_id")
        store.write.mode("overwrite").parquet(self._path("store"))
        store = self._table("store")
        if twice := store.groupBy("chunk_id").count().where("count > 1").first():
            raise ValueError(f"a chunk stands twice in the store: {twice.chunk_id}")
        embedded = self._table("embeddings", "chunk_id string, embedding array<float>")
        held = store.select("chunk_id", F.col("row_id").alias("chunk_row_id")).join(embedded.select("chunk_id"), "chunk_id", "left_semi")
        numbered = planning.numbered(held, ["chunk_row_id"], "dense_id").select((F.col("dense_id") - 1).alias("dense_id"), "chunk_row_id", "chunk_id")
        numbered.write.mode("overwrite").parquet(self._path("dense_map"))
        kept = embedded.join(held.select("chunk_id"), "chunk_id", "left_semi")
        ranges = retrieval.quantizer(kept)
        ranges.write.mode("overwrite").parquet(self._path("ranges"))
        retrieval.encode_sq8(kept, self._table("ranges")).write.mode("overwrite").parquet(self._path("codes"))
        return self._table("postings")

    def artifacts(self) -> DataFrame:
        """(stage, files, bytes) of the tables."""
        return files.artifacts(self.spark, self.tables)

    def search(self, queries: list[str], top_k: int = 10, candidates: int = 50, mode: str = "hybrid", encode: Callable | None = None, sources: list[str] | None = None) -> DataFrame:
        """(query_id, rank, chunk and scores) for each query by ``bm25``, ``dense`` or ``hybrid``, of indexed chunks; only chunks of ``sources`` where given."""
        if mode not in ("bm25", "dense", "hybrid"):
            raise ValueError(f"unknown mode: {mode}")
        make = encode or hash_encoder(self.settings.dimensions)
        ids = [f"q{k}" for k in range(len(queries))]
        asked = self.spark.createDataFrame(list(zip(ids, queries)), "query_id string, query string")
        chunks = self._table("chunks", CHUNK)
        only = chunks.where(F.col("source_id").isin(sources)).select("chunk_id") if sources else None  # before any cut to the best
        terms = sorted({t for r in retrieval.asked_terms(asked).select("sub").collect() for t in r.sub})  # of the given queries
        sparse = retrieval.bm25(asked, self._table("postings").where(F.col("term").isin(terms)), self._table("lengths"), candidates, only=only)
        vectors = make([retrieval.QUERY_PREFIX + q for q in queries])
        with_vectors = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors)], "query_id string, embedding array<float>")
        indexed = self._table("lengths").select("chunk_id")  # no held-out chunk is among them
        embedded = self._table("embeddings").where(F.exists("embedding", lambda x: x != 0)).join(indexed, "chunk_id", "left_semi")
        near = retrieval.dense(with_vectors, embedded if only is None else embedded.join(only, "chunk_id", "left_semi"), candidates)
        none = lambda df, c: df.limit(0).select("query_id", "chunk_id", c)
        fused = retrieval.fuse(none(near, "dense_rank") if mode == "bm25" else near, none(sparse, "sparse_rank") if mode == "dense" else sparse, top_k)
        return fused.join(chunks, "chunk_id")

    def status(self) -> DataFrame:
        """(source_id, documents, chunks, embedded)."""
        docs = self._table("documents", parsers.DOCUMENT).groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"))
        has = self._table("embeddings").select("chunk_id", F.lit(1).alias("has"))
        chunks = self._table("chunks", CHUNK).join(has, "chunk_id", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("has").alias("embedded"))
        return docs.join(chunks, "source_id", "full").fillna(0)
