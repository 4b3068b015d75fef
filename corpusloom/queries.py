"""The queries over the reference's own operators, by name, and the SQL that says the same.

Each runs over whole tables. ``REPEATED`` rows of a document or chunk are kept out where the operator works on
documents or chunks rather than on deliveries.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import chunking, cleaning, dedup, ledger, planning, retrieval
from .session import cut, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# CTEs that several oracles begin with
DOC = """doc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC) AS _k FROM corpus_document) WHERE _k = 1)"""
CHUNK = """chunk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY written_at DESC) AS _k FROM chunks) WHERE _k = 1)"""
VEC = """vec AS (SELECT chunk_id, e FROM (SELECT chunk_id, arg_max(struct_pack(e := embedding), embedded_at).e AS e FROM chunk_vector GROUP BY 1)
 WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0)"""
FILES = """file AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, filename ORDER BY updated_at DESC, status DESC, actual_bytes DESC NULLS LAST, sha256 DESC NULLS LAST) AS _k FROM manifest_file) WHERE _k = 1)"""
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
LINES = r"regexp_replace({0}, '\r\n?', chr(10), 'g')"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str, **made: Column) -> DataFrame:
    """The last delivery of each document. What is ``made`` of a row, say the length of its text, is made before rows are chosen, so
    that texts which nothing else needs are not shuffled."""
    return ledger.last_wins(table(spark, d, "corpus_document").where(F.col("document_id").isNotNull()).withColumns(made), ["document_id"], "ingested_at")


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return ledger.last_wins(table(spark, d, "chunks"), ["chunk_id"], "written_at")


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    last = ledger.last_wins(table(spark, d, "chunk_vector").select("chunk_id", "embedding", "embedded_at"), ["chunk_id"], "embedded_at")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return last.where((F.size("embedding") == 64) & fine & F.exists("embedding", lambda x: x != 0)).select("chunk_id", "embedding")


def files(spark: SparkSession, d: str) -> DataFrame:
    rank = Window.partitionBy("source_id", "filename").orderBy(F.desc("updated_at"), F.desc("status"), F.desc_nulls_last("actual_bytes"), F.desc_nulls_last("sha256"))
    return table(spark, d, "manifest_file").withColumn("_k", F.row_number().over(rank)).where("_k = 1").drop("_k")


# ---------------------------------------------------------------- scans and reports


@query(f"WITH {FILES} SELECT source_id, count(*) AS files, sum(actual_bytes)::BIGINT AS bytes FROM file GROUP BY ROLLUP (source_id)")
def src_inventory(spark, d):
    return files(spark, d).rollup("source_id").agg(F.count(F.lit(1)).alias("files"), F.sum("actual_bytes").alias("bytes"))


@query(f"""WITH {DOC}, first AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY source_path, document_id) AS r FROM doc)
SELECT source_id, document_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(text) < 200 THEN 'short' ELSE 'ok' END AS status FROM first WHERE r = 1""")
def src_probe(spark, d):
    first = dedup.first_wins(docs(spark, d, n=F.coalesce(F.length("text"), F.lit(0))), ["source_id"], "source_path", "document_id")
    status = F.when(F.col("n") == 0, "empty").when(F.col("n") < 200, "short").otherwise("ok")
    return first.select("source_id", "document_id", status.alias("status"))


@query(f"WITH {FILES} SELECT source_id, filename, coalesce(actual_bytes, expected_bytes)::VARCHAR || ':' || epoch_us(updated_at)::VARCHAR || ':r3:min200' AS signature FROM file WHERE coalesce(actual_bytes, expected_bytes) IS NOT NULL")
def src_signature(spark, d):
    f = files(spark, d).withColumn("size", F.coalesce("actual_bytes", "expected_bytes")).where(F.col("size").isNotNull())
    return f.select("source_id", "filename", ledger.stage_signature(F.col("size"), F.col("updated_at"), "r3", min=200).alias("signature"))


@query("SELECT local_path, arg_max(status, updated_at) AS status, max(updated_at) AS updated_at FROM manifest_file WHERE local_path IS NOT NULL AND updated_at IS NOT NULL GROUP BY 1")
def win_manifest_last(spark, d):
    rows = table(spark, d, "manifest_file").where("local_path is not null and updated_at is not null and status is not null")
    last = rows.groupBy("local_path").agg(F.max_by("status", "updated_at").alias("status"))
    when = table(spark, d, "manifest_file").where("local_path is not null").groupBy("local_path").agg(F.max("updated_at").alias("updated_at"))
    return last.join(when, "local_path").select("local_path", "status", "updated_at")


# ---------------------------------------------------------------- projections


@query(f"WITH {DOC} SELECT document_id, source_id || ':' || substr(sha256(source_id || chr(0) || coalesce(external_id, document_id)), 1, 24) AS stable_id FROM doc")
def prj_stable_id(spark, d):
    return docs(spark, d).select("document_id", tx.stable_id(F.col("source_id"), F.coalesce("external_id", "document_id")).alias("stable_id"))


@query(f"WITH {DOC} SELECT document_id, CASE WHEN trim(coalesce(title, '')) = '' THEN regexp_replace(regexp_replace(source_path, '^.*/', ''), '\\.[^.]*$', '') ELSE trim(title) END AS title FROM doc")
def prj_document(spark, d):
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"\.[^.]*$", "")
    return docs(spark, d).select("document_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), stem).alias("title"))


@query("SELECT pmid, 'Represent this sentence for searching relevant passages: ' || question AS query FROM pubmedqa_item")
def prj_query_text(spark, d):
    return table(spark, d, "pubmedqa_item").select("pmid", F.concat(F.lit(retrieval.QUERY_PREFIX), "question").alias("query"))


@query("SELECT source_id, filename, substr(sha256(url), 1, 20) AS candidate_id FROM manifest_file WHERE url IS NOT NULL")
def prj_catalog_record(spark, d):
    return table(spark, d, "manifest_file").where("url is not null").select("source_id", "filename", F.substring(F.sha2("url", 256), 1, 20).alias("candidate_id"))


@query("""SELECT pmid, '## Question' || chr(10) || chr(10) || coalesce(question, '') || chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10) || array_to_string(coalesce(contexts, []), chr(10) || chr(10))
 || CASE WHEN coalesce(long_answer, '') = '' THEN '' ELSE chr(10) || chr(10) || '## Answer' || chr(10) || chr(10) || long_answer END AS text, final_decision FROM pubmedqa_item LEFT JOIN pubmedqa_decision USING (pmid)""")
def src_pubmedqa(spark, d):
    from .sources.records import qa_text

    items = table(spark, d, "pubmedqa_item").join(table(spark, d, "pubmedqa_decision"), "pmid", "left")
    return items.select("pmid", qa_text("question", "contexts", "long_answer").alias("text"), "final_decision")


@query("""SELECT record_id, judged_at, greatest(0, least(1, coalesce(curation.confidence, 0))) AS confidence, len(list_slice(coalesce(curation.subdomains, []), 1, 8)) AS subdomains,
 len(list_slice(coalesce(curation.quality_flags, []), 1, 12)) AS flags, substr(curation.reason, 1, 1000) AS reason FROM curation_smoke""")
def prj_curation_norm(spark, d):
    c = table(spark, d, "curation_smoke")
    size = lambda x, n: F.size(F.slice(F.coalesce(x, F.array().cast("array<string>")), 1, n)).cast("long")
    return c.select(
        "record_id",
        "judged_at",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("curation.confidence", F.lit(0.0)))).alias("confidence"),
        size(F.col("curation.subdomains"), 8).alias("subdomains"),
        size(F.col("curation.quality_flags"), 12).alias("flags"),
        F.substring("curation.reason", 1, 1000).alias("reason"),
    )


@query("""SELECT record_id, judged_at, i AS step, curation.review_chain[i].judge AS judge, curation.review_chain[i].confidence AS confidence
FROM (SELECT *, unnest(range(1, len(curation.review_chain) + 1)) AS i FROM curation_smoke WHERE curation IS NOT NULL)""")
def prj_review_chain(spark, d):
    each = table(spark, d, "curation_smoke").select("record_id", "judged_at", F.posexplode("curation.review_chain").alias("at", "r"))
    return each.select("record_id", "judged_at", (F.col("at") + 1).cast("long").alias("step"), "r.judge", "r.confidence")


# ---------------------------------------------------------------- filters


@query(f"WITH {DOC} SELECT document_id, source_id, 'too_short' AS reason, coalesce(length(text), 0) AS original_chars FROM doc WHERE coalesce(length(text), 0) < 200")
def flt_min_doc(spark, d):
    gated = docs(spark, d, n=F.coalesce(F.length("text"), F.lit(0)).cast("long")).where("n < 200")
    return gated.select("document_id", "source_id", F.lit("too_short").alias("reason"), F.col("n").alias("original_chars"))


@query(f"WITH {CHUNK} SELECT source_id, count(*) AS chunks FROM chunk WHERE NOT (token_count < 32 AND category <> 'knowledge_base') GROUP BY 1")
def flt_min_chunk(spark, d):
    return chunking.keep_sized(chunk_rows(spark, d)).groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"))



@query(r"SELECT DISTINCT source_id, filename FROM manifest_file WHERE regexp_matches(filename, '(?i)p0[0-9]_') AND NOT regexp_matches(filename, '(?i)\.(tmp|part)$')")
def flt_index_name(spark, d):
    keep = F.col("filename").rlike("(?i)p0[0-9]_") & ~F.col("filename").rlike(r"(?i)\.(tmp|part)$")
    return table(spark, d, "manifest_file").where(keep).select("source_id", "filename").distinct()



@query("SELECT pmid FROM pubmedqa_item WHERE long_answer IS NOT NULL AND long_answer <> '' AND len(contexts) > 0")
def flt_abstract(spark, d):
    return table(spark, d, "pubmedqa_item").where((F.coalesce("long_answer", F.lit("")) != "") & (F.size("contexts") > 0)).select("pmid")


# ---------------------------------------------------------------- joins


@query(f"""WITH {DOC}, m AS (SELECT local_path, arg_max(struct_pack(u := url, s := status), updated_at) AS r FROM manifest_file WHERE local_path IS NOT NULL AND updated_at IS NOT NULL GROUP BY 1)
SELECT document_id, coalesce(doc.url, m.r.u) AS url, m.r.s AS status FROM doc LEFT JOIN m ON source_path = local_path""")
def jn_manifest(spark, d):
    m = table(spark, d, "manifest_file").where("local_path is not null and updated_at is not null")
    last = m.groupBy("local_path").agg(F.max_by(F.struct("url", "status"), "updated_at").alias("r"))
    rows = docs(spark, d).join(last, F.col("source_path") == F.col("local_path"), "left")  # the planner broadcasts it where its size allows
    return rows.select("document_id", F.coalesce("url", "r.url").alias("url"), F.col("r.status").alias("status"))


@query("SELECT DISTINCT chunk_id FROM chunk_vector WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)")
def jn_fk_embedded(spark, d):
    return ledger.missing_keys(table(spark, d, "chunk_vector"), table(spark, d, "chunks"), "chunk_id")


@query("""WITH a AS (SELECT chunk_id, count(*) AS left_rows FROM chunk_vector GROUP BY 1), b AS (SELECT chunk_id, count(*) AS right_rows FROM chunks GROUP BY 1)
SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(left_rows, 0) AS left_rows, coalesce(right_rows, 0) AS right_rows FROM a FULL JOIN b USING (chunk_id) WHERE coalesce(left_rows, 0) <> coalesce(right_rows, 0)""")
def jn_count_match(spark, d):
    return ledger.unequal_counts(table(spark, d, "chunk_vector"), table(spark, d, "chunks"), "chunk_id")


@query("SELECT dense_id, chunk_id FROM dense_map JOIN (SELECT DISTINCT row_id, chunk_id FROM chunks) ON row_id = chunk_row_id")
def jn_dense_map(spark, d):
    chunks = table(spark, d, "chunks").select(F.col("row_id").alias("chunk_row_id"), "chunk_id").distinct()
    return table(spark, d, "dense_map").join(chunks, "chunk_row_id").select("dense_id", "chunk_id")




@query(f"""WITH {CHUNK}, c AS (SELECT source_id, count(*) AS chunks FROM chunk GROUP BY 1),
e AS (SELECT source_id, count(DISTINCT chunk_id) AS embedded FROM chunk JOIN chunk_vector USING (chunk_id) GROUP BY 1)
SELECT source_id, chunks, coalesce(embedded, 0) AS embedded, floor(100.0 * coalesce(embedded, 0) / chunks + 0.5)::BIGINT AS percent FROM c LEFT JOIN e USING (source_id)""")
def jn_coverage(spark, d):
    chunks = chunk_rows(spark, d).select("chunk_id", "source_id")
    has = table(spark, d, "chunk_vector").select("chunk_id", F.lit(1).alias("has")).distinct()
    both = chunks.join(has, "chunk_id", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("has").alias("embedded"))
    return both.withColumn("percent", F.floor(100 * F.col("embedded") / F.col("chunks") + 0.5).cast("long"))


@query(f"""WITH a AS (SELECT source_id, max(filename) AS filename, 'prior' AS version FROM manifest_file WHERE status = 'planned' GROUP BY 1), b AS (SELECT source_id, max(filename) AS filename, 'new' AS version FROM manifest_file WHERE status = 'complete' GROUP BY 1)
SELECT coalesce(b.source_id, a.source_id) AS source_id, coalesce(b.filename, a.filename) AS filename, coalesce(b.version, a.version) AS version FROM a FULL JOIN b USING (source_id)""")
def jn_snapshot(spark, d):
    m = table(spark, d, "manifest_file")
    side = lambda status, name: m.where(F.col("status") == status).groupBy("source_id").agg(F.max("filename").alias("filename"), F.lit(name).alias("version"))
    return ledger.merged_snapshot(side("planned", "prior"), side("complete", "new"), "source_id")


@query(f"""WITH {CHUNK}, {DOC} SELECT source_id, count(*) AS documents, count(chunks) AS chunked FROM doc LEFT JOIN (SELECT document_id, count(*) AS chunks FROM chunk GROUP BY 1) USING (document_id) GROUP BY 1""")
def jn_records(spark, d):
    per = chunk_rows(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return docs(spark, d).join(per, "document_id", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"), F.count("chunks").alias("chunked"))


@query(f"""WITH {DOC}, k AS (SELECT unnest(list_distinct(list_filter([local_path, nullif(regexp_extract(error, 'normalized to (\\S+)', 1), '')], lambda x: x IS NOT NULL))) AS path_key, * FROM manifest_file WHERE updated_at IS NOT NULL),
m AS (SELECT path_key, arg_max(struct_pack(u := url, md := metadata, s := status), updated_at) AS r FROM k GROUP BY 1)
SELECT document_id, coalesce(doc.url, m.r.u) AS url, coalesce(json_extract_string(m.r.md, '$.license_id'), doc.license_id) AS license_id, m.r.s AS status FROM doc LEFT JOIN m ON source_path = path_key""")
def prj_enrich(spark, d):
    out = ledger.enrich(docs(spark, d), table(spark, d, "manifest_file").where("updated_at is not null"))
    return out.select("document_id", "url", "license_id", F.get_json_object("acquisition", "$.status").alias("status"))


# ---------------------------------------------------------------- aggregates


@query(f"WITH {DOC} SELECT source_id, count(*) AS documents, count(*) FILTER (coalesce(length(text), 0) < 200) AS rejected, sum(length(text))::BIGINT AS chars FROM doc GROUP BY 1")
def agg_ingest(spark, d):
    return docs(spark, d, n=F.length("text")).groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce("n", F.lit(0)) < 200).alias("rejected"), F.sum("n").alias("chars"))


@query(f"""WITH {DOC} SELECT count(*) FILTER (text IS NULL OR text = '') AS empty, count(*) FILTER (text <> '' AND length(text) < 200) AS short, count(*) FILTER (length(text) >= 200) AS ok FROM doc""")
def agg_probe(spark, d):
    n = F.col("n")
    return docs(spark, d, n=F.coalesce(F.length("text"), F.lit(0))).agg(F.count_if(n == 0).alias("empty"), F.count_if((n > 0) & (n < 200)).alias("short"), F.count_if(n >= 200).alias("ok"))


@query(f"""WITH {DOC}, r AS (SELECT source_id, CASE WHEN coalesce(length(text), 0) < 200 THEN 'too_short' WHEN row_number() OVER (PARTITION BY source_id, content_sha256, coalesce(length(text), 0) < 200 ORDER BY ingested_at, document_id) > 1 THEN 'duplicate_document' END AS reason FROM doc)
SELECT source_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2""")
def agg_reject_reason(spark, d):
    gated = docs(spark, d, rejected=F.when(F.coalesce(F.length("text"), F.lit(0)) < 200, "too_short"))
    passed = gated.where(F.col("rejected").isNull())
    first = dedup.first_wins(passed, ["source_id", "content_sha256"], "ingested_at", "document_id").select("document_id")
    twice = passed.join(first, "document_id", "left_anti").withColumn("rejected", F.lit("duplicate_document"))
    return gated.where(F.col("rejected").isNotNull()).unionByName(twice).groupBy("source_id", F.col("rejected").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHUNK} SELECT source_id, count(*) AS chunks, count(*) FILTER (token_count < 32) AS short_chunks, count(DISTINCT document_id) AS documents, max(ordinal) AS longest FROM chunk GROUP BY 1")
def agg_chunk(spark, d):
    return chunk_rows(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("token_count") < 32).alias("short_chunks"), F.count_distinct("document_id").alias("documents"), F.max("ordinal").alias("longest"))


@query(f"WITH {FILES} SELECT status, count(*) AS files, coalesce(sum(actual_bytes) FILTER (status = 'complete'), 0)::BIGINT AS complete_bytes FROM file GROUP BY 1")
def agg_status(spark, d):
    return files(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.when(F.col("status") == "complete", F.col("actual_bytes"))), F.lit(0)).alias("complete_bytes"))


@query(f"WITH {CHUNK} SELECT source_id, count(*) AS chunks FROM chunk GROUP BY 1")
def agg_source_chunks(spark, d):
    return chunk_rows(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"))


@query(f"""WITH {CHUNK}, by_source AS (SELECT source_id, any_value(category) AS category, count(*) AS chunks FROM chunk GROUP BY 1),
p AS (SELECT 'full' AS profile, source_id FROM by_source UNION ALL SELECT 'open' , source_id FROM by_source WHERE category = 'knowledge_base' UNION ALL SELECT 'core', source_id FROM by_source WHERE category <> 'literature')
SELECT profile, count(*) AS sources, sum(chunks)::BIGINT AS chunks, round(sum(chunks) * 1536 / 1024.0^3, 6) AS fp16_gib, round(sum(chunks) * 768 / 1024.0^3, 6) AS sq8_gib, round(sum(chunks) / 100.0 / 3600, 6) AS eta_hours
FROM p JOIN by_source USING (source_id) GROUP BY 1""")
def agg_profile_plan(spark, d):
    by = chunk_rows(spark, d).groupBy("source_id").agg(F.any_value("category").alias("category"), F.count(F.lit(1)).alias("chunks"))
    part = lambda name, where: by.where(where).select(F.lit(name).alias("profile"), "source_id")
    profiles = part("full", F.lit(True)).unionByName(part("open", F.col("category") == "knowledge_base")).unionByName(part("core", F.col("category") != "literature"))
    return planning.profile_plan(by.select("source_id", "chunks"), profiles)


@query(f"WITH {CHUNK}, {VEC} SELECT (SELECT count(*) FROM vec) AS dense_vectors, (SELECT count(*) FROM chunk) AS sparse_chunks, 64::BIGINT AS dimensions")
def agg_index_report(spark, d):
    v = unit_vectors(spark, d).agg(F.count(F.lit(1)).alias("dense_vectors"), F.max(F.size("embedding")).cast("long").alias("dimensions"))
    c = chunk_rows(spark, d).agg(F.count(F.lit(1)).alias("sparse_chunks"))
    return v.join(F.broadcast(c)).select("dense_vectors", "sparse_chunks", "dimensions")  # one row each


@query("""SELECT decision, count(*) AS n FROM (SELECT record_id, arg_max(struct_pack(x := curation.decision), judged_at).x AS decision FROM curation_smoke WHERE judged_at IS NOT NULL GROUP BY 1) GROUP BY 1""")
def agg_audit(spark, d):
    c = table(spark, d, "curation_smoke").where("judged_at is not null").select("record_id", "judged_at", F.col("curation.decision").alias("decision"))
    return ledger.last_wins(c, ["record_id"], "judged_at").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT record_id, judged_at, list_min(list_transform(curation.review_chain, lambda r: r.confidence)) AS confidence, len(curation.review_chain) AS judges FROM curation_smoke WHERE curation IS NOT NULL")
def agg_minconf(spark, d):
    c = table(spark, d, "curation_smoke").where("curation is not null")
    return c.select("record_id", "judged_at", F.array_min("curation.review_chain.confidence").alias("confidence"), F.when(F.col("curation.review_chain").isNotNull(), F.size("curation.review_chain")).cast("long").alias("judges"))


@query("SELECT split_part(local_path, '/', 1) AS root, sum(actual_bytes)::BIGINT AS bytes, count(*) AS rows FROM manifest_file WHERE local_path LIKE '%/raw/%' GROUP BY 1")
def agg_existing_bytes(spark, d):
    m = table(spark, d, "manifest_file").where(F.col("local_path").contains("/raw/"))
    return m.groupBy(F.split("local_path", "/")[0].alias("root")).agg(F.sum("actual_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))



@query(f"WITH {DOC} SELECT source_path, bit_xor(('0x' || substr(sha256(document_id || chr(0) || coalesce(text, '')), 1, 15))::BIGINT) AS digest, count(*) AS documents FROM doc GROUP BY 1")
def agg_digest(spark, d):
    """An order-free digest of each input file: the exclusive or of its rows' digests."""
    one = F.conv(F.substring(F.sha2(F.concat("document_id", F.char(F.lit(0)), F.coalesce("text", F.lit(""))), 256), 1, 15), 16, 10).cast("long")
    return docs(spark, d, one=one).groupBy("source_path").agg(F.bit_xor("one").alias("digest"), F.count(F.lit(1)).alias("documents"))


# ---------------------------------------------------------------- windows


@query("""SELECT document_id, source_path, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY source_path, document_id ORDER BY ingested_at) AS r FROM corpus_document WHERE length(text) >= 200) WHERE r = 1""")
def win_id_dedup(spark, d):
    rows = table(spark, d, "corpus_document").where(F.length("text") >= 200)
    return dedup.first_wins(rows, ["source_path", "document_id"], "ingested_at").select("document_id", "source_path", "ingested_at")


_FP = r"sha256(trim(regexp_replace(replace(replace(lower(regexp_replace(text, '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g')), 'ß', 'ss'), 'µ', 'μ'), '\s+', ' ', 'g')))"


@query(f"WITH {DOC} SELECT document_id, {_FP} AS digest FROM doc WHERE text IS NOT NULL")
def txt_digest(spark, d):
    return docs(spark, d, digest=tx.digest(F.col("text"))).where("digest is not null").select("document_id", "digest")


@query(f"WITH {DOC} SELECT document_id FROM (SELECT document_id, row_number() OVER (PARTITION BY source_id, {_FP} ORDER BY ingested_at, document_id) AS r FROM doc WHERE length(text) >= 200) WHERE r = 1")
def win_doc_dedup(spark, d):
    rows = docs(spark, d, digest=F.when(F.length("text") >= 200, tx.digest(F.col("text")))).where("digest is not null")
    return dedup.first_wins(rows, ["source_id", "digest"], "ingested_at", "document_id").select("document_id")


_PARA = rf"list_filter(list_transform(regexp_split_to_array({LINES.format('text')}, '\n\s*\n'), lambda p: {STRIP.format('p')}), lambda p: p <> '')"


@query(f"WITH {DOC} SELECT document_id, len({_PARA}) AS paragraphs FROM doc WHERE text IS NOT NULL")
def txt_paragraphs(spark, d):
    return docs(spark, d, paragraphs=F.when(F.col("text").isNotNull(), F.size(tx.paragraphs(F.col("text"))).cast("long"))).where("paragraphs is not null").select("document_id", "paragraphs")


@query(f"""WITH {DOC}, p AS (SELECT document_id, source_id, ingested_at, ps[i] AS text, i FROM (SELECT *, {_PARA} AS ps, unnest(range(1, len({_PARA}) + 1)) AS i FROM doc WHERE text IS NOT NULL)),
r AS (SELECT *, length(text) < 180 OR row_number() OVER (PARTITION BY source_id, {_FP}, length(text) >= 180 ORDER BY ingested_at, document_id, i) = 1 AS keep FROM p)
SELECT document_id, coalesce(md5(string_agg(text, chr(10) || chr(10) ORDER BY i) FILTER (keep)), md5('')) AS text_md5, count(*) FILTER (NOT keep) AS removed FROM r GROUP BY 1""")
def win_para_dedup(spark, d):
    out = dedup.paragraph_dedup(docs(spark, d).where("text is not null"), ["ingested_at", "document_id"])
    return out.select("document_id", F.md5("text").alias("text_md5"), "removed")


@query(f"WITH {CHUNK} SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (PARTITION BY source_id, {_FP} ORDER BY document_id, ordinal, chunk_id) AS r FROM chunk WHERE NOT (token_count < 32 AND category <> 'knowledge_base')) WHERE r = 1")
def win_chunk_dedup(spark, d):
    rows = chunking.keep_sized(chunk_rows(spark, d)).withColumn("digest", tx.digest(F.col("text")))
    return dedup.first_wins(rows, ["source_id", "digest"], "document_id", "ordinal", "chunk_id").select("chunk_id")


@query(f"""WITH {DOC}, raw AS (SELECT document_id, string_split({LINES.format('text')}, chr(10)) AS ls FROM doc WHERE text IS NOT NULL),
line AS (SELECT document_id, i, {STRIP.format('ls[i]')} AS l FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
ev AS (SELECT *, CASE WHEN lower(regexp_replace(l, '^[# ]+', '')) IN ('references', 'external links', 'see also', 'further reading', 'acknowledgments', 'acknowledgements') THEN 1 WHEN l LIKE '## %' THEN 0 END AS e FROM line),
s AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS t FROM ev)
SELECT document_id, count(*) FILTER (t = 0) AS kept, count(*) FILTER (t = 1) AS in_tail FROM s GROUP BY 1""")
def win_boilerplate(spark, d):
    marked = cleaning.tail_marked(cleaning.lines(docs(spark, d).where("text is not null")))
    return marked.groupBy("document_id").agg(F.count_if(~F.col("in_tail")).alias("kept"), F.count_if("in_tail").alias("in_tail"))


@query(f"""WITH {DOC}, raw AS (SELECT document_id, string_split({LINES.format('text')}, chr(10)) AS ls FROM doc WHERE text IS NOT NULL),
line AS (SELECT document_id, i, {STRIP.format('ls[i]')} AS l FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM raw))
SELECT document_id, h AS heading, count(*) AS lines FROM (SELECT document_id, l, last_value(CASE WHEN l LIKE '## %' THEN substr(l, 4) END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM line) WHERE l <> '' AND l NOT LIKE '## %' GROUP BY 1, 2""")
def win_heading_carry(spark, d):
    every = cleaning.lines(docs(spark, d).where("text is not null"))
    title = F.when(F.col("line").startswith("## "), F.substr("line", F.lit(4)))
    carried = every.withColumn("heading", F.last(title, ignorenulls=True).over(Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    return carried.where((F.col("line") != "") & ~F.col("line").startswith("## ")).groupBy("document_id", "heading").agg(F.count(F.lit(1)).alias("lines"))


@query(f"WITH {CHUNK} SELECT chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY ordinal, chunk_id) AS ordinal FROM chunk")
def win_ordinal(spark, d):
    return chunk_rows(spark, d).select("chunk_id", F.row_number().over(Window.partitionBy("document_id").orderBy("ordinal", "chunk_id")).cast("long").alias("ordinal"))


@query(f"WITH {FILES}, r AS (SELECT source_id, filename, row_number() OVER (PARTITION BY source_id ORDER BY filename) AS n FROM file) SELECT source_id, (n - 1) // 5 AS batch, string_agg(filename, ',' ORDER BY n) AS items FROM r GROUP BY 1, 2")
def win_batch(spark, d):
    out = planning.batches(files(spark, d), ["source_id"], ["filename"], 5, "filename")
    return out.select("source_id", "batch", F.array_join("items", ",").alias("items"))


@query("""SELECT a::DATE AS start, least(a::DATE + 6, DATE '2025-12-31') AS "end" FROM (SELECT unnest(generate_series(DATE '2025-01-01', DATE '2025-12-31', INTERVAL 7 DAY)) AS a)""")
def win_date_tumbling(spark, d):
    return planning.date_windows(spark, date(2025, 1, 1), date(2025, 12, 31))


@query(f"""WITH {CHUNK}, r AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY document_id, ordinal, chunk_id) - 1 AS n FROM chunk)
SELECT source_id, n // 250 AS segment, min(n) AS original_start, count(*) AS rows FROM r GROUP BY 1, 2""")
def win_row_segments(spark, d):
    return planning.segments(chunk_rows(spark, d), ["source_id"], ["document_id", "ordinal", "chunk_id"], 250)


@query(f"""WITH RECURSIVE {CHUNK}, n AS (SELECT source_id, document_id, count(*) AS size, row_number() OVER (PARTITION BY source_id ORDER BY document_id) AS i FROM chunk GROUP BY 1, 2),
f AS (SELECT source_id, document_id, size, i, 0 AS job, size AS used FROM n WHERE i = 1
UNION ALL SELECT n.source_id, n.document_id, n.size, n.i, CASE WHEN f.used > 0 AND f.used + n.size > 40 THEN f.job + 1 ELSE f.job END, CASE WHEN f.used > 0 AND f.used + n.size > 40 THEN n.size ELSE f.used + n.size END FROM f JOIN n ON n.source_id = f.source_id AND n.i = f.i + 1)
SELECT source_id, document_id, size, job FROM f""")
def win_job_pack(spark, d):
    sizes = chunk_rows(spark, d).groupBy("source_id", "document_id").agg(F.count(F.lit(1)).alias("size"))
    return planning.next_fit(sizes, ["source_id"], ["document_id"], "size", 40)




@query(f"""WITH {DOC}, r AS (SELECT document_id, row_number() OVER (ORDER BY document_id) - 1 AS i, count(*) OVER () AS n FROM doc)
SELECT document_id FROM r WHERE i IN (SELECT (k * (n - 1) // 99)::BIGINT FROM range(100) t(k), (SELECT count(*) AS n FROM doc))""")
def win_linspace(spark, d):
    return planning.even_sample(docs(spark, d).select("document_id"), ["document_id"], 100)


@query(f"WITH {CHUNK} SELECT chunk_id, row_number() OVER (ORDER BY source_id, document_id, ordinal, chunk_id) AS row_no FROM chunk")
def idx_chunkstore(spark, d):
    rows = chunk_rows(spark, d).select("chunk_id", "source_id", "document_id", "ordinal")
    return planning.numbered(rows, ["source_id", "document_id", "ordinal", "chunk_id"], "row_no").select("chunk_id", F.col("row_no").cast("long").alias("row_no"))



_SQUEEZE = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({LINES.format("regexp_replace({0}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')")}, '[ \t]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{{{{3,}}}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"WITH {DOC} SELECT document_id, md5({_SQUEEZE.format('text')}) AS text_md5, length({_SQUEEZE.format('text')}) AS chars FROM doc WHERE text IS NOT NULL")
def txt_squeeze(spark, d):
    clean = tx.squeeze(F.col("text"))
    return docs(spark, d).where("text is not null").select("document_id", F.md5(clean).alias("text_md5"), F.length(clean).cast("long").alias("chars"))


@query(f"WITH {DOC} SELECT document_id, md5(replace({_SQUEEZE.format('text')}, 'µ', 'μ')) AS text_md5 FROM doc WHERE text IS NOT NULL")
def txt_clean_structured(spark, d):
    return cleaning.clean_structured(docs(spark, d).where("text is not null").select("document_id", "text")).select("document_id", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- sections and chunks

_SECT = rf"""raw AS (SELECT document_id, title, string_split(regexp_replace({LINES.format('text')}, '(?m)^##\s+(.+?)\s*$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM doc WHERE text IS NOT NULL),
part AS (SELECT document_id, title, len(parts) AS k, i AS section_no, parts[i + 1] AS p FROM (SELECT *, unnest(range(0, len(parts))) AS i FROM raw)),
sect AS (SELECT document_id, title, section_no, CASE WHEN section_no > 0 THEN split_part(p, chr(2), 1) END AS section, {STRIP.format("CASE WHEN section_no > 0 THEN split_part(p, chr(2), 2) ELSE p END")} AS body, k FROM part)"""


@query(f"WITH {DOC}, {_SECT} SELECT document_id, section_no, section, md5(body) AS body_md5 FROM sect WHERE k = 1 OR body <> ''")
def chk_sections(spark, d):
    rows = chunking.sections(docs(spark, d).where("text is not null").select("document_id", "text"))
    return rows.select("document_id", F.col("section_no").cast("long").alias("section_no"), "section", F.md5("body").alias("body_md5"))


_CHUNKED = rf"""{_SECT},
pre AS (SELECT *, title || CASE WHEN section IS NOT NULL AND lower(section) <> lower(title) THEN chr(10) || chr(10) || section ELSE '' END || chr(10) || chr(10) AS prefix FROM sect WHERE k = 1 OR body <> ''),
tok AS (SELECT *, len(regexp_extract_all(prefix, '\S+')) AS used, regexp_extract_all(body, '\S+\s*') AS pieces FROM pre),
bud AS (SELECT *, len(pieces) AS n, greatest(1, 450 - used) AS b FROM tok), stp AS (SELECT *, greatest(1, b - 64) AS s, used + n <= 510 OR n <= b AS whole FROM bud),
lst AS (SELECT *, CASE WHEN whole THEN 0 ELSE greatest(0, least(floor((n - 320)::DOUBLE / s), ceil((n - b)::DOUBLE / s)))::BIGINT END AS last FROM stp),
win AS (SELECT *, unnest(list_concat(list_transform(range(0, last + 1), lambda x: [x * s, CASE WHEN whole THEN n ELSE least(x * s + b, n) END]), CASE WHEN NOT whole AND last * s + b < n THEN [[n - b, n]] ELSE [] END)) AS w FROM lst),
chunked AS (SELECT document_id, section, row_number() OVER (PARTITION BY document_id ORDER BY section_no, w[1]) AS ordinal, {STRIP.format("prefix || " + STRIP.format("array_to_string(list_slice(pieces, w[1] + 1, w[2]), '')"))} AS t FROM win)"""


@query(rf"""WITH {DOC}, {_CHUNKED} SELECT document_id, 'chunk:' || substr(sha256(document_id || chr(0) || ordinal::VARCHAR || chr(0) || t), 1, 24) AS chunk_id, ordinal, section, len(regexp_extract_all(t, '\S+')) AS token_count FROM chunked""")
def chk_windows(spark, d):
    rows = chunking.chunk(docs(spark, d).where("text is not null").select("document_id", "title", "text"))
    return rows.select("document_id", "chunk_id", F.col("ordinal").cast("long").alias("ordinal"), "section", F.col("token_count").cast("long").alias("token_count"))


@query(rf"""WITH {DOC}, {_CHUNKED} SELECT document_id, count(*) AS chunks, max(len(regexp_extract_all(t, '\S+'))) AS longest, min(len(regexp_extract_all(t, '\S+'))) AS shortest FROM chunked GROUP BY 1""")
def chk_emit(spark, d):
    rows = chunking.chunk(docs(spark, d).where("text is not null").select("document_id", "title", "text"))
    n = F.col("token_count").cast("long")
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(n).alias("longest"), F.min(n).alias("shortest"))


# ---------------------------------------------------------------- retrieval


_TERMS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
_INDEX = rf"""col AS (SELECT chunk_id, 'title' AS col, {_TERMS.format("coalesce(title, '')")} AS ts FROM chunk UNION ALL SELECT chunk_id, 'section', {_TERMS.format("coalesce(section, '')")} FROM chunk UNION ALL SELECT chunk_id, 'text', {_TERMS.format("coalesce(text, '')")} FROM chunk),
pos AS (SELECT chunk_id, col, ts[i] AS term, i AS p FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM col)), size AS (SELECT chunk_id, sum(len(ts)) AS length FROM col GROUP BY 1)"""


@query(rf"WITH {CHUNK}, {_INDEX} SELECT term, count(DISTINCT chunk_id) AS chunks, count(*) AS places FROM pos GROUP BY 1")
def idx_fts(spark, d):
    index = retrieval.postings(chunk_rows(spark, d))
    return index.groupBy("term").agg(F.count_distinct("chunk_id").alias("chunks"), F.sum(F.size("positions")).alias("places"))


@query("SELECT pmid, list_distinct_in_order AS terms FROM (SELECT pmid, array_to_string(list_filter(ts, lambda x, i: list_position(ts, x) = i), ' ') AS list_distinct_in_order FROM (SELECT pmid, regexp_extract_all(question, '[A-Za-z0-9][A-Za-z0-9_-]{1,}') AS ts FROM pubmedqa_item))")
def ret_terms(spark, d):
    return table(spark, d, "pubmedqa_item").select("pmid", F.array_join(tx.query_terms(F.col("question")), " ").alias("terms"))


def _asked(spark, d):
    return table(spark, d, "pubmedqa_item").where(F.col("pmid").cast("long") % 20 == 0).select(F.col("pmid").alias("query_id"), F.col("question").alias("query"))


def _bm25_sql(queries: str) -> str:
    return rf"""{_INDEX}, q AS ({queries}),
asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9_-]{{1,}}')) AS asked FROM q),
sub AS (SELECT query_id, asked, len(s) AS m, i AS j, s[i] AS term FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, {_TERMS.format("asked")} AS s FROM asked))),
place AS (SELECT query_id, asked, m, chunk_id, col, p - j AS start FROM sub JOIN pos USING (term) GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) = max(m)),
hit AS (SELECT query_id, asked, chunk_id, count(*) AS f FROM place GROUP BY 1, 2, 3), df AS (SELECT query_id, asked, count(*) AS n FROM hit GROUP BY 1, 2), tot AS (SELECT count(*) AS docs, avg(length) AS mean FROM size),
scored AS (SELECT query_id, chunk_id, round(sum(greatest(ln((docs - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM hit JOIN df USING (query_id, asked) JOIN size USING (chunk_id), tot GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS sparse_rank FROM scored) WHERE sparse_rank <= 50)"""


@query(f"WITH {CHUNK}, {_bm25_sql('SELECT pmid AS query_id, question AS query FROM pubmedqa_item WHERE pmid::BIGINT % 20 = 0')} SELECT query_id, chunk_id, score, sparse_rank FROM sparse")
def ret_sparse(spark, d):
    out = retrieval.bm25_over(_asked(spark, d), table(spark, d, "chunks"), last_by="written_at")
    return out.select("query_id", "chunk_id", "score", F.col("sparse_rank").cast("long").alias("sparse_rank"))


def _mapped(spark, d):
    """(query_id, chunk_id, embedding, query): embedded chunks whose dense_id is divisible by 20, as queries."""
    chunks = chunk_rows(spark, d).select("chunk_id", "row_id", F.col("title").alias("query"))
    some = table(spark, d, "dense_map").where("dense_id % 20 = 0").join(chunks, F.col("row_id") == F.col("chunk_row_id"))
    return some.join(unit_vectors(spark, d), "chunk_id").select(F.col("dense_id").cast("string").alias("query_id"), "chunk_id", "embedding", "query")


_DENSE = """asker AS (SELECT dense_id::VARCHAR AS query_id, chunk.chunk_id, e, chunk.title AS query FROM dense_map JOIN chunk ON row_id = chunk_row_id JOIN vec ON vec.chunk_id = chunk.chunk_id WHERE dense_id % 20 = 0),
near AS (SELECT query_id, vec.chunk_id, round(list_cosine_similarity(list_transform(asker.e, lambda x: x::DOUBLE), list_transform(vec.e, lambda x: x::DOUBLE)), 6) AS score FROM asker, vec),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS dense_rank FROM near) WHERE dense_rank <= 50)"""


@query(f"WITH {CHUNK}, {VEC}, {_DENSE} SELECT query_id, chunk_id, score, dense_rank FROM dense")
def ret_dense(spark, d):
    out = retrieval.dense(_mapped(spark, d), unit_vectors(spark, d))
    return out.select("query_id", "chunk_id", "score", F.col("dense_rank").cast("long").alias("dense_rank"))


_RRF = """both_legs AS (SELECT query_id, chunk_id, dense_rank, sparse_rank, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + sparse_rank), 0), 9) AS rrf_score FROM dense FULL JOIN sparse USING (query_id, chunk_id)),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM both_legs) WHERE rank <= 10)"""


def _fused(spark, d):
    asked = cut(_mapped(spark, d))
    sparse = retrieval.bm25_over(asked, table(spark, d, "chunks"), last_by="written_at")
    return retrieval.fuse(retrieval.dense(asked, unit_vectors(spark, d)), sparse)


_HYBRID = f"{CHUNK}, {VEC}, {_DENSE}, {_bm25_sql('SELECT query_id, query FROM asker')}, {_RRF}"


@query(f"WITH {_HYBRID} SELECT query_id, chunk_id, rrf_score, dense_rank, sparse_rank, rank FROM fused")
def ret_rrf(spark, d):
    f = _fused(spark, d)
    return f.select("query_id", "chunk_id", "rrf_score", *[F.col(c).cast("long").alias(c) for c in ("dense_rank", "sparse_rank", "rank")])


@query(f"WITH {_HYBRID} SELECT query_id, rank, fused.chunk_id, rrf_score, source_id, title, section FROM fused JOIN chunk USING (chunk_id)")
def ret_search(spark, d):
    fetched = chunk_rows(spark, d).select("chunk_id", "source_id", "title", "section")
    return _fused(spark, d).join(fetched, "chunk_id").select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "rrf_score", "source_id", "title", "section")


@query(f"""WITH {VEC}, one AS (SELECT i - 1 AS d, e[i]::DOUBLE AS x FROM (SELECT e, unnest(range(1, 65)) AS i FROM (SELECT * FROM vec ORDER BY chunk_id LIMIT 100000))) SELECT d, min(x) AS low, max(x) - min(x) AS width FROM one GROUP BY 1""")
def idx_sq8(spark, d):
    return retrieval.quantizer(unit_vectors(spark, d)).select(F.col("d").cast("long").alias("d"), "low", "width")


@query(f"""WITH {VEC}, r AS (SELECT i, min(e[i]::DOUBLE) AS low, max(e[i]::DOUBLE) - min(e[i]::DOUBLE) AS width FROM (SELECT e, unnest(range(1, 65)) AS i FROM vec) GROUP BY 1),
c AS (SELECT chunk_id, i, CASE WHEN width = 0 THEN 0 ELSE least(255, greatest(0, floor(255 * (e[i]::DOUBLE - low) / width))) END::BIGINT AS code FROM (SELECT *, unnest(range(1, 65)) AS i FROM vec) JOIN r USING (i))
SELECT chunk_id, sum(code)::BIGINT AS total, max(code) AS highest FROM c GROUP BY 1""")
def idx_sq8_codes(spark, d):
    v = unit_vectors(spark, d)
    codes = retrieval.encode_sq8(v, retrieval.quantizer(v))
    return codes.select("chunk_id", F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("codes").cast("long").alias("highest"))



# ---------------------------------------------------------------- sets, order, state



@query("SELECT source_id FROM corpus_document INTERSECT SELECT source_id FROM manifest_file")
def set_intersection(spark, d):
    return table(spark, d, "corpus_document").select("source_id").intersect(table(spark, d, "manifest_file").select("source_id"))


@query("SELECT license_id, count(*) AS n FROM (SELECT license_id FROM corpus_document UNION ALL SELECT license_id FROM documents UNION ALL SELECT license_id FROM curation_smoke) GROUP BY 1")
def set_union_all(spark, d):
    one = lambda t: table(spark, d, t).select("license_id")
    return one("corpus_document").unionByName(one("documents")).unionByName(one("curation_smoke")).groupBy("license_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT record_id, judged_at, len(list_filter(curation.quality_flags, lambda f: f NOT IN ('short', 'boilerplate'))) = 0 AS subset FROM curation_smoke WHERE curation.quality_flags IS NOT NULL")
def set_subset(spark, d):
    c = table(spark, d, "curation_smoke").where("curation.quality_flags is not null")
    return c.select("record_id", "judged_at", (F.size(F.filter("curation.quality_flags", lambda f: ~f.isin("short", "boilerplate"))) == 0).alias("subset"))


@query(f"WITH {DOC} SELECT document_id FROM doc ORDER BY source_id, source_path, document_id LIMIT 25")
def top_head(spark, d):
    """The first inputs in order, a limit that is the feature."""
    return docs(spark, d).orderBy("source_id", "source_path", "document_id").limit(25).select("document_id")


@query(f"WITH {FILES} SELECT source_id, max(try_cast(regexp_extract(filename, '([0-9]+)\\.[a-z]+$', 1) AS BIGINT)) AS latest FROM file GROUP BY 1")
def top_latest_version(spark, d):
    number = F.nullif(F.regexp_extract("filename", r"([0-9]+)\.[a-z]+$", 1), F.lit("")).cast("long")
    return files(spark, d).groupBy("source_id").agg(F.max(number).alias("latest"))


@query("""WITH old AS (SELECT source_id, filename, max(url) AS url, max(expected_bytes) AS bytes, max(expected_checksum) AS checksum, 'old' AS status FROM manifest_file WHERE status = 'planned' GROUP BY 1, 2),
new AS (SELECT source_id, filename, max(url) AS url, max(actual_bytes) AS bytes, max(sha256) AS checksum, 'planned' AS status FROM manifest_file WHERE status <> 'planned' GROUP BY 1, 2)
SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.filename, n.filename) AS filename, CASE WHEN n.source_id IS NOT NULL THEN n.url ELSE o.url END AS url, coalesce(n.bytes, o.bytes) AS bytes, coalesce(n.checksum, o.checksum) AS checksum,
 CASE WHEN o.source_id IS NOT NULL THEN o.status ELSE n.status END AS status FROM old o FULL JOIN new n ON o.source_id = n.source_id AND o.filename = n.filename""")
def st_manifest_upsert(spark, d):
    m = table(spark, d, "manifest_file")
    side = lambda rows, size, sum_, name: rows.groupBy("source_id", "filename").agg(F.max("url").alias("url"), F.max(size).alias("bytes"), F.max(sum_).alias("checksum"), F.lit(name).alias("status"))
    old = side(m.where("status = 'planned'"), "expected_bytes", "expected_checksum", "old")
    new = side(m.where("status <> 'planned'"), "actual_bytes", "sha256", "planned")
    return ledger.upsert(old, new, ["source_id", "filename"], ["url"], ["bytes", "checksum"], ["status"])



@query(f"""WITH {FILES} SELECT source_id, filename, sum(actual_bytes) OVER (PARTITION BY source_id ORDER BY filename ROWS UNBOUNDED PRECEDING)::BIGINT AS used,
 sum(actual_bytes) OVER (PARTITION BY source_id ORDER BY filename ROWS UNBOUNDED PRECEDING) <= 1000000 AS fits FROM file WHERE actual_bytes IS NOT NULL""")
def st_budget(spark, d):
    rows = files(spark, d).where("actual_bytes is not null")
    return ledger.running_budget(rows, ["source_id"], ["filename"], "actual_bytes", 1_000_000).select("source_id", "filename", "used", "fits")


@query(f"""WITH {FILES}, done AS (SELECT local_path, min(coalesce(sha256, '-')) AS signature FROM manifest_file WHERE status = 'complete' AND local_path IS NOT NULL GROUP BY 1)
SELECT f.local_path, CASE WHEN done.signature IS NULL THEN 'process' WHEN done.signature = f.signature THEN 'skip' ELSE 'changed' END AS action FROM (SELECT local_path, max(coalesce(sha256, expected_checksum, '-')) AS signature FROM file WHERE local_path IS NOT NULL GROUP BY 1) f LEFT JOIN done USING (local_path)""")
def st_resume(spark, d):
    done = table(spark, d, "manifest_file").where("status = 'complete' and local_path is not null").groupBy("local_path").agg(F.min(F.coalesce("sha256", F.lit("-"))).alias("signature"))
    now = files(spark, d).where("local_path is not null").groupBy("local_path").agg(F.max(F.coalesce("sha256", "expected_checksum", F.lit("-"))).alias("signature"))
    return ledger.resume(now, done, ["local_path"]).select("local_path", "action")


def _more() -> None:
    from . import source_queries  # noqa: F401  (adds its own)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _more()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(_SQL)
