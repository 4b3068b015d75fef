"""The queries of this subpackage, by name, over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import chosen_path, encoding, leakage, neighbours, packing, reading_level, scans, splitting, subjects
from .common import latest


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dense_id, embedding): the latest embedding of each chunk that dense_map reaches through a chunks row.

    Unusable embeddings stay in until the latest row of a chunk is chosen, as only that one counts.
    """
    last = latest(table(spark, sf_dir, "chunk_vector").select("chunk_id", "embedding", "embedded_at"), "chunk_id", "embedded_at")
    chunks = table(spark, sf_dir, "chunks").select("row_id", "chunk_id").distinct()
    mapped = table(spark, sf_dir, "dense_map").select("dense_id", F.col("chunk_row_id").alias("row_id")).distinct()
    return mapped.join(chunks, "row_id").join(last, "chunk_id").select("dense_id", "embedding")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.mutual_pairs(neighbours.neighbours(vectors(spark, sf_dir)))


def p1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose dense_id is divisible by 20, against all vectors, by greedy graph search."""
    every = cut(vectors(spark, sf_dir))
    return neighbours.searched(every, every.where(F.col("dense_id") % 20 == 0))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.direct_pairs(*chosen_path.join(table(spark, sf_dir, "corpus_document")))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.link_counts(*chosen_path.join(table(spark, sf_dir, "corpus_document")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.read_levels(table(spark, sf_dir, "curation_smoke"), table(spark, sf_dir, "level_sample"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.defects(table(spark, sf_dir, "corpus_document"))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.reflow(table(spark, sf_dir, "corpus_document"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "corpus_document"), table(spark, sf_dir, "pubmedqa_item"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that the operator cuts at least once, which only texts over the limit are."""
    ends = splitting.cuts(table(spark, sf_dir, "corpus_document"))
    return ends.where(F.col("end") < F.col("total")).select("document_id").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "corpus_document"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def p8_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = encoding.token_counts(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size"))
    return packing.pack(sizes).select(F.col("item").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), F.concat_ws("-", "round", "grp", "box").alias("container_id"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.find_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_sample")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_search": p1_search,
        "p2_found": p2_found,
        "p2_classes": p2_classes,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_paragraphs": p4_paragraphs,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p6_pieces": p6_pieces,
        "p7_ids": p7_ids,
        "p8_assignment": p8_assignment,
        "p9_found": p9_found,
    }


_P2_PAIRS = """
WITH last AS (SELECT document_id, arg_max(coalesce(title, '') || ' ' || coalesce(text, ''), ingested_at) AS t FROM corpus_document WHERE document_id IS NOT NULL GROUP BY 1),
words AS (SELECT document_id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM last),
each AS (SELECT DISTINCT document_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT document_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
sized AS (SELECT document_id, count(*) AS n FROM each GROUP BY 1 HAVING count(*) >= 20),
inter AS (SELECT a.document_id AS x, b.document_id AS y, count(*) AS c FROM each a JOIN each b ON a.s = b.s AND a.document_id < b.document_id GROUP BY 1, 2),
pairs AS (SELECT x AS document_id_a, y AS document_id_b FROM inter JOIN sized p ON p.document_id = x JOIN sized q ON q.document_id = y WHERE c / (p.n + q.n - c) >= 0.6)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
WITH last AS (SELECT chunk_id, arg_max(struct_pack(e := embedding), embedded_at).e AS e FROM chunk_vector GROUP BY 1),
v AS (SELECT DISTINCT dense_id, list_transform(e, lambda x: x::DOUBLE) AS e FROM dense_map m JOIN (SELECT DISTINCT row_id, chunk_id FROM chunks) c ON m.chunk_row_id = c.row_id JOIN last USING (chunk_id)
 WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT a.dense_id AS x, b.dense_id AS y, round(list_cosine_similarity(a.e, b.e), 9) AS sim FROM v a, v b WHERE a.dense_id <> b.dense_id),
r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS k FROM s)
SELECT DISTINCT least(x, y) AS dense_id_a, greatest(x, y) AS dense_id_b FROM r WHERE k <= 10""",
        "p2_found": _P2_PAIRS + "SELECT document_id_a, document_id_b FROM pairs",
        "p2_classes": _P2_PAIRS
        + """, sets AS (SELECT document_id, string_agg(s, '|' ORDER BY s) AS body FROM each JOIN sized USING (document_id) GROUP BY 1),
classes AS (SELECT document_id, min(document_id) OVER (PARTITION BY body) AS class_id FROM sets),
ends AS (SELECT document_id_a AS d FROM pairs UNION ALL SELECT document_id_b FROM pairs)
SELECT document_id, class_id, (SELECT count(*) FROM ends WHERE d = document_id) AS links FROM classes""",
        "p6_found": r"""
SELECT document_id FROM (SELECT document_id, arg_max(coalesce(text, ''), ingested_at) AS t FROM corpus_document WHERE document_id IS NOT NULL GROUP BY 1)
WHERE len(regexp_extract_all(t, '[A-Za-z0-9]+|[^ \t\r\n]')) > 510""",
    }
