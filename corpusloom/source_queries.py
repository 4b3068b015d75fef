"""Queries over readers, writers and plans: rows of the tables are rendered in each format, written, and read back by its
reader; the SQL says what the same rows are as documents. Sizes and ids are those of the tables."""

from __future__ import annotations

import gzip
import io
import json
import re
import tarfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import chunking, cleaning, dedup, ledger, planning
from .queries import CHUNK, DOC, FILES, LINES, STRIP, chunk_rows, docs, files, query
from .session import _delete_at_end, shared_dir, table
from .sources import archives, parsers, sinks
from .sources import files as listing
from .streaming import runs

SOURCE = {"source_id": "s", "category": "qa", "license_id": None}


def rendered(spark: SparkSession, rows: DataFrame, by: str | None = None) -> str:
    """A folder of text files with the column ``value`` of the rows, one after another; with ``by``, a file for each of its values."""
    path = f"{shared_dir(spark)}/rendered-{uuid.uuid4().hex}"
    (rows.repartition(by).write.partitionBy(by) if by else rows.select("value").write).text(path)
    _delete_at_end(spark, path)
    return path


def put(spark: SparkSession, path: str, raw: bytes) -> str:
    """A small file of given content, wherever the shared folder is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(raw))
    out.close()
    return path


def items(spark: SparkSession, d: str) -> DataFrame:
    """Held-out items with their contexts as one text, white space collapsed."""
    flat = F.transform("contexts", lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    return table(spark, d, "pubmedqa_item").select("pmid", "question", F.filter(flat, lambda c: c != "").alias("contexts"), "long_answer", "year", "meshes")


_ITEM = r"""item AS (SELECT pmid, question, list_filter(list_transform(contexts, lambda c: trim(regexp_replace(c, '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g'))), lambda c: c <> '') AS cs, long_answer, year, meshes FROM pubmedqa_item)"""
_NL = "chr(10) || chr(10)"


def xml(c: Column | str) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def element(tag: str, body: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}{attributes}>"), body, F.lit(f"</{tag}>"))


def parsed(spark: SparkSession, path: str, parser: str) -> DataFrame:
    return parsers.parse(spark, [path], SOURCE | {"parser": parser}).select("external_id", "title", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- readers


@query(f"WITH {DOC} SELECT document_id, source_id, md5(text) AS text_md5 FROM doc")
def src_jsonl(spark, d):
    """Written as gzipped JSON lines, null fields left out, and read with a schema; a bad line would end the job."""
    path = f"{shared_dir(spark)}/rendered-{uuid.uuid4().hex}"
    rows = docs(spark, d).select("document_id", "source_id", "text")
    sinks.jsonl(rows, path, 1000)
    _delete_at_end(spark, path)
    return spark.read.schema(rows.schema).option("mode", "FAILFAST").json(path).select("document_id", "source_id", F.md5("text").alias("text_md5"))


@query(f"WITH {_ITEM} SELECT pmid AS external_id, question AS title, md5('## Abstract' || {_NL} || array_to_string(cs, ' ')) AS text_md5 FROM item WHERE pmid::BIGINT % 7 <> 0")
def src_pubmed_jsonl(spark, d):
    """Every seventh item has no abstract and gives no document."""
    abstract = F.when(F.col("pmid").cast("long") % 7 != 0, F.array_join("contexts", " "))
    rows = items(spark, d).select(F.to_json(F.struct("pmid", F.col("question").alias("title"), abstract.alias("abstract"), "year")).alias("value"))
    return parsed(spark, rendered(spark, rows), "pubmed_jsonl")


@query(f"WITH {_ITEM} SELECT 'PMC' || pmid AS external_id, question AS title, md5('## Abstract' || {_NL} || cs[1] || {_NL} || '## Evidence' || {_NL} || array_to_string(cs, {_NL})) AS text_md5 FROM item WHERE len(cs) > 0")
def src_jats(spark, d):
    own = element("article-id", F.concat(F.lit("PMC"), "pmid"), ' pub-id-type="pmc"')
    abstract = element("abstract", element("p", xml(F.get("contexts", F.lit(0)))))
    front = element("front", element("article-meta", F.concat(own, element("title-group", element("article-title", F.concat(F.lit("<i>"), xml("question"), F.lit("</i>")))), abstract)))
    body = element("body", element("sec", F.concat(F.lit("<title>Evidence</title>"), F.array_join(F.transform("contexts", lambda c: element("p", xml(c))), ""))))
    return parsed(spark, rendered(spark, items(spark, d).where(F.size("contexts") > 0).select(element("article", F.concat(front, body)).alias("value"))), "jats_xml")


@query(f"WITH {_ITEM} SELECT pmid AS external_id, question AS title, md5(array_to_string(list_concat(['## MeSH descriptor' || {_NL} || question], list_filter(meshes, lambda m, i: list_position(meshes, m) = i)), {_NL})) AS text_md5 FROM item")
def src_mesh(spark, d):
    terms = F.array_join(F.transform("meshes", lambda m: element("Term", xml(m))), "")
    record = F.concat(element("DescriptorUI", F.col("pmid")), element("DescriptorName", element("String", xml("question"))), terms)
    return parsed(spark, rendered(spark, items(spark, d).select(element("DescriptorRecord", record).alias("value"))), "mesh_xml")


@query(f"""WITH {_ITEM} SELECT 'P' || pmid AS external_id, question AS title, md5('## Protein' || {_NL} || 'E' || pmid || '_X' || {_NL} || '## Description' || {_NL} || question || {_NL} || '## Organism' || {_NL} || {_NL} || '## Function and comments' || {_NL} || array_to_string(cs, chr(10))
 || {_NL} || '## Cross-references' || {_NL} || {_NL} || '## Keywords' || {_NL} || array_to_string(meshes, ' ')) AS text_md5 FROM item""")
def src_uniprot(spark, d):
    lines = lambda code, c: F.array_join(F.transform(c, lambda x: F.concat(F.lit(f"{code}   "), x, F.lit("\n"))), "")
    head = F.concat(F.lit("ID   E"), "pmid", F.lit("_X  Reviewed;\nAC   P"), "pmid", F.lit(";\nDE   "), "question", F.lit("\n"))
    return parsed(spark, rendered(spark, items(spark, d).select(F.concat(head, lines("CC", "contexts"), lines("KW", "meshes"), F.lit("//")).alias("value"))), "uniprot_dat")


@query(f"""WITH {_ITEM} SELECT 'T:' || pmid AS external_id, question AS title, md5('## Gene Ontology term' || {_NL} || question || {_NL} || '"' || cs[1] || '"' || {_NL} || '## Synonyms' || {_NL} || array_to_string(meshes, chr(10)) || {_NL} || '## Relations' || {_NL} || 'T:1' || chr(10) || 'part_of T:2') AS text_md5 FROM item WHERE len(meshes) > 0 AND len(cs) > 0""")
def src_obo(spark, d):
    synonyms = F.array_join(F.transform("meshes", lambda m: F.concat(F.lit("synonym: "), m, F.lit("\n"))), "")
    term = F.concat(F.lit("[Term]\nid: T:"), "pmid", F.lit("\nname: "), "question", F.lit('\ndef: "'), F.get("contexts", F.lit(0)), F.lit('"\n'), synonyms, F.lit("is_a: T:1\nrelationship: part_of T:2\n\n[Typedef]\nid: part_of\n"))
    return parsed(spark, rendered(spark, items(spark, d).where((F.size("meshes") > 0) & (F.size("contexts") > 0)).select(term.alias("value"))), "obo")


@query(f"WITH {_ITEM} SELECT 'R-' || pmid AS external_id, question AS title, md5('## Pathway summary' || {_NL} || coalesce(replace(long_answer, '\"', ''), '')) AS text_md5 FROM item")
def src_reactome(spark, d):
    """A table with a header in each file."""
    plain = F.coalesce(F.replace("long_answer", F.lit('"'), F.lit("")), F.lit(""))
    row = F.concat_ws("\t", F.concat(F.lit("R-"), "pmid"), "question", plain)
    rows = items(spark, d).withColumn("b", F.pmod(F.xxhash64("pmid"), F.lit(4))).groupBy("b").agg(F.concat(F.lit("Identifier\tName\tSummation\n"), F.array_join(F.collect_list(row), "\n")).alias("value"))
    return parsed(spark, rendered(spark, rows, "b"), "reactome_tsv")


@query(f"WITH {_ITEM} SELECT pmid AS external_id, question AS title, md5('## Introduction' || {_NL} || question || {_NL} || '## Evidence' || {_NL} || array_to_string(cs, {_NL})) AS text_md5 FROM item WHERE len(cs) > 0")
def src_wikipedia(spark, d):
    """API answers of some fifty pages each; templates, links, emphasis and tail sections are markup."""
    content = F.concat(F.lit("'''"), "question", F.lit("'''{{cite|x}}\n== [[Proof|Evidence]] ==\n"), F.array_join("contexts", "\n\n"), F.lit("\n== See also ==\n* [[Other]]"))
    one = F.struct(F.struct(F.struct(content.alias("content")).alias("main")).alias("slots"), F.lit(3).alias("revid"))
    page = F.struct(F.col("pmid").cast("long").alias("pageid"), F.col("question").alias("title"), F.array(one).alias("revisions"))
    rows = items(spark, d).where(F.size("contexts") > 0).withColumn("b", F.pmod(F.xxhash64("pmid"), F.lit(10))).groupBy("b").agg(F.to_json(F.struct(F.struct(F.collect_list(page).alias("pages")).alias("query"))).alias("value"))
    return parsed(spark, rendered(spark, rows, "b"), "wikipedia_json")


@query("SELECT 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name AS text, count(*) AS n FROM customer GROUP BY 1")
def src_delimited(spark, d):
    """Rows of a table with a header as ``key: value`` lines; empty cells are left out."""
    path = f"{shared_dir(spark)}/rendered-{uuid.uuid4().hex}"
    table(spark, d, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("none")).write.option("header", True).csv(path)
    _delete_at_end(spark, path)
    paths = sorted(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").collect())
    return parsers.parse(spark, paths, SOURCE | {"parser": "csv_txt"}).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


_CITED = """cite AS (SELECT pmid, question, cs, pmid::BIGINT AS k, array_to_string(cs, chr(10)) AS abstract FROM item),
screen AS (SELECT pmid, abstract, CASE WHEN k % 13 = 0 THEN 'malformed' WHEN k % 11 = 0 THEN 'short_or_missing_abstract' WHEN k % 7 = 0 THEN 'non_english' WHEN k % 5 = 0 THEN 'retracted' WHEN k % 3 = 0 THEN 'low_value_type' ELSE 'accepted' END AS reason FROM cite)"""


def _citations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("pmid").cast("long")
    title = F.when(k % 13 != 0, element("ArticleTitle", xml("question"))).otherwise("")
    abstract = F.when(k % 11 != 0, F.array_join(F.transform("contexts", lambda c: element("AbstractText", xml(c))), "")).otherwise(F.lit("<AbstractText>Short</AbstractText>"))
    language = F.when(k % 7 == 0, F.lit("<Language>fre</Language>")).otherwise(F.lit("<Language>eng</Language>"))
    kind = F.when(k % 5 == 0, F.lit("Retracted Publication")).when(k % 3 == 0, F.lit("Letter")).otherwise(F.lit("Journal Article"))
    data = element("Article", F.concat(title, element("Abstract", abstract), language, element("PublicationTypeList", element("PublicationType", kind))))
    book = F.when(k % 13 == 0, F.lit("PubmedBookArticle")).otherwise(F.lit("PubmedArticle"))
    inner = element("MedlineCitation", F.concat(element("PMID", F.col("pmid")), data))
    rows = items(spark, d).select(F.concat(F.lit("<"), book, F.lit(">"), inner, F.lit("</"), book, F.lit(">")).alias("value"))
    return parsers.screened(parsers.pubmed_citations(spark, [rendered(spark, rows)]))


@query(f"WITH {_ITEM}, {_CITED} SELECT pmid, md5(abstract) AS abstract_md5 FROM screen WHERE reason = 'accepted'")
def src_pubmed_xml(spark, d):
    return _citations(spark, d).where("reason = 'accepted'").select("pmid", F.md5("abstract").alias("abstract_md5"))


@query(f"WITH {_ITEM}, {_CITED} SELECT pmid, reason FROM screen")
def flt_pubmed_chain(spark, d):
    return _citations(spark, d).select("pmid", "reason")


@query(f"WITH {_ITEM}, {_CITED} SELECT count(*) AS input, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("accepted", "malformed", "short_or_missing_abstract", "non_english", "retracted", "low_value_type")) + " FROM screen")
def agg_pubmed_funnel(spark, d):
    each = parsers.funnel(_citations(spark, d))
    return each.agg(*[F.sum(c).alias(c) for c in each.columns if c != "path"])


@query("SELECT 'https://books.example/shelf/b' || pmid AS target, 'A book ' || trim(regexp_replace(question, '\\s+', ' ', 'g')) || ' cover' AS title FROM pubmedqa_item")
def src_html_links(spark, d):
    page = F.concat(F.lit('<p><a href="b'), "pmid", F.lit('#top" title="A book">'), xml("question"), F.lit(' <img alt="cover"></a> <a href="mailto:x@y.z">mail</a></p>'))
    rows = table(spark, d, "pubmedqa_item").select(F.lit("https://books.example/shelf/index.html").alias("url"), page.alias("html"))
    return parsers.links_of(rows).select("target", "title")


@query("SELECT pmid, line_no FROM (SELECT pmid, row_number() OVER (ORDER BY pmid) AS line_no FROM pubmedqa_item)")
def src_tar(spark, d):
    """JSON lines from the one member of an archive that has the name asked for, packed once more."""
    rows = [json.dumps({"pmid": r.pmid}) for r in table(spark, d, "pubmedqa_item").select("pmid").orderBy("pmid").collect()]  # 500 at any scale
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as t:
        for name, body in (("a/part.jsonl.gz", gzip.compress("\n\n".join(rows).encode())), ("../evil.jsonl", b"x"), ("a/other.txt", b"y")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    path = f"{shared_dir(spark)}/rendered-{uuid.uuid4().hex}.tar.gz"
    put(spark, path, raw.getvalue())
    _delete_at_end(spark, path)
    found = archives.json_rows(spark, [path], "part.jsonl")
    return found.select(F.get_json_object("value", "$.pmid").alias("pmid"), ((F.col("line_no") + 1) / 2).cast("long").alias("line_no"))


@query("""SELECT * FROM (VALUES ('bad.gz', 'integrity: BadGzipFile'), ('bad.json', 'integrity: JSONDecodeError'), ('bad.pdf', 'no PDF signature'), ('bad.xml', 'no XML tag'), ('bad.zip', 'integrity: BadZipFile'), ('good.json', 'ok'), ('good.pdf', 'ok'), ('good.txt.gz', 'ok'), ('good.xml', 'ok')) t(name, verdict)""")
def flt_validate(spark, d):
    """Files by their suffix; one without any content is not read at all, its length in the inventory tells."""
    path = f"{shared_dir(spark)}/rendered-{uuid.uuid4().hex}"
    for name, raw in {"bad.gz": b"no", "bad.json": b"{", "bad.pdf": b"pdf", "bad.xml": b"text", "bad.zip": b"PK\x03\x04", "good.json": b"{}", "good.pdf": b"%PDF-1.7", "good.txt.gz": gzip.compress(b"x"), "good.xml": b"<a/>"}.items():
        put(spark, f"{path}/{name}", raw)
    _delete_at_end(spark, path)
    return archives.checked(spark.read.format("binaryFile").load(path).select("path", "content")).select(F.substring_index("path", "/", -1).alias("name"), "verdict")


@query("SELECT source_id, category, count(*) AS files FROM (SELECT DISTINCT source_id, 'c' AS category, filename FROM manifest_file WHERE source_id IS NOT NULL AND filename IS NOT NULL AND filename NOT LIKE '%.part') GROUP BY ALL")
def src_discover(spark, d):
    """A file for each file of the manifest, found again by a pattern a source; partial downloads are left out."""
    rows = table(spark, d, "manifest_file").where("source_id is not null and filename is not null").select("source_id", "filename").distinct()
    root = rendered(spark, rows.withColumn("value", F.lit("x")).withColumn("path", F.concat_ws("/", "source_id", "filename")).select("value", F.col("path").alias("p")), "p")
    names = rows.select("source_id").distinct()
    sources = names.select("source_id", F.lit("c").alias("category"), F.lit("csv_txt").alias("parser"), F.lit(1).alias("priority"), F.array(F.concat(F.lit("p="), "source_id", F.lit("%2F*/**/*"))).alias("patterns"))
    return listing.discover(spark, root, sources).groupBy("source_id", "category").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {CHUNK} SELECT source_id, source_path AS shard, count(*) AS records FROM chunk GROUP BY ALL")
def src_ledger(spark, d):
    """Records of each shard, from a ledger with rows of two stages."""
    per = chunk_rows(spark, d).groupBy("source_id", F.col("source_path").alias("shard")).agg(F.count(F.lit(1)).alias("records")).withColumn("stage", F.lit("chunk"))
    return per.unionByName(per.withColumn("stage", F.lit("ingest"))).where("stage = 'chunk'").select("source_id", "shard", "records")


@query("SELECT candidate FROM (SELECT DISTINCT url AS candidate FROM manifest_file WHERE url IS NOT NULL) ORDER BY candidate LIMIT 20")
def src_candidates(spark, d):
    """The first candidates in order, a limit that is the feature."""
    return table(spark, d, "manifest_file").where("url is not null").select(F.col("url").alias("candidate")).distinct().orderBy("candidate").limit(20)


# ---------------------------------------------------------------- cleaning and chunking

_CLEAN = rf"""{DOC}, sq AS (SELECT document_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({LINES.format("regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')")}, '[ \t]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM doc WHERE text IS NOT NULL),
line AS (SELECT document_id, i, ls[i] AS l FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT document_id, string_split(t, chr(10)) AS ls FROM sq))),
ev AS (SELECT *, CASE WHEN lower(regexp_replace(l, '^[# ]+', '')) IN ('references', 'external links', 'see also', 'further reading', 'acknowledgments', 'acknowledgements') THEN 1 WHEN l LIKE '## %' THEN 0 END AS e FROM line),
s AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS tail FROM ev),
cleaned AS (SELECT document_id, {STRIP.format("regexp_replace(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (tail = 0 AND NOT regexp_matches(l, '(?i)^https?://[^ ]+$') AND lower(l) NOT IN ('contents', 'table of contents')), ''), '\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM s GROUP BY 1)"""


@query(f"WITH {_CLEAN} SELECT document_id, md5(t) AS text_md5 FROM cleaned")
def txt_clean(spark, d):
    """Tails, address-only lines and contents lines off, within the row."""
    return docs(spark, d, text=cleaning.without_boilerplate(tx.squeeze(F.col("text")))).where("text is not null").select("document_id", F.md5("text").alias("text_md5"))


_PARAGRAPHS = rf"list_filter(list_transform(regexp_split_to_array({LINES.format('text')}, '\n\s*\n'), lambda p: {STRIP.format('p')}), lambda p: p <> '')"


@query(rf"""WITH {DOC}, p AS (SELECT document_id, source_id, ps[i] AS p, i, ingested_at FROM (SELECT *, {_PARAGRAPHS} AS ps, unnest(range(1, len({_PARAGRAPHS}) + 1)) AS i FROM doc WHERE length(text) >= 200)),
r AS (SELECT *, length(p) < 180 OR row_number() OVER (PARTITION BY source_id, sha256(trim(regexp_replace(replace(replace(lower(regexp_replace(p, '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+', ' ', 'g')), 'ß', 'ss'), 'µ', 'μ'), '\s+', ' ', 'g'))), length(p) >= 180 ORDER BY ingested_at, document_id, i) = 1 AS keep FROM p)
SELECT document_id, 'too_short_after_deduplication' AS reason FROM r GROUP BY 1 HAVING length(coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (keep), '')) < 200""")
def flt_after_dedup(spark, d):
    """Documents that were long enough until the paragraphs of earlier ones were taken out."""
    thinned = dedup.paragraph_dedup(docs(spark, d).where(F.length("text") >= 200), ["ingested_at", "document_id"])
    return dedup.length_gate(thinned).where("rejected is not null").select("document_id", F.lit("too_short_after_deduplication").alias("reason"))


def _signs(text: str) -> list[tuple[int, int]]:
    """Tokens of runs of ASCII letters and digits, or one other sign."""
    return [m.span() for m in re.finditer(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]", text, re.A)]


_TOKEN = r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"


def _cut_sql(used: str, n: str, sizes: tuple[int, int, int, int], passage: str, count: str) -> str:
    """Sections cut by windows over n tokens of the body, with ``used`` tokens of the prefix."""
    minimum, target, most, overlap = sizes
    return rf"""WITH {DOC}, raw AS (SELECT document_id, title, string_split(regexp_replace({LINES.format('text')}, '(?m)^##\s+(.+?)\s*$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM doc WHERE text IS NOT NULL),
part AS (SELECT document_id, title, len(parts) AS k, i AS section_no, parts[i + 1] AS p FROM (SELECT *, unnest(range(0, len(parts))) AS i FROM raw)),
sect AS (SELECT document_id, title, section_no, CASE WHEN section_no > 0 THEN split_part(p, chr(2), 1) END AS section, {STRIP.format("CASE WHEN section_no > 0 THEN split_part(p, chr(2), 2) ELSE p END")} AS body, k FROM part),
pre AS (SELECT *, title || CASE WHEN section IS NOT NULL AND lower(section) <> lower(title) THEN chr(10) || chr(10) || section ELSE '' END || chr(10) || chr(10) AS prefix FROM sect WHERE k = 1 OR body <> ''),
tok AS (SELECT *, {used} AS used, {n} AS n, regexp_extract_all(body, '\s*(?:{_TOKEN})') AS pieces FROM pre),
stp AS (SELECT *, greatest(1, {target} - used) AS b, greatest(1, greatest(1, {target} - used) - {overlap}) AS s, used + n <= {most} AS fits FROM tok),
lst AS (SELECT *, CASE WHEN fits OR n <= b THEN 0 ELSE greatest(0, least(floor((n - {minimum})::DOUBLE / s), ceil((n - b)::DOUBLE / s)))::BIGINT END AS last FROM stp),
win AS (SELECT *, unnest(list_concat(list_transform(range(0, last + 1), lambda x: [x * s, CASE WHEN fits THEN n ELSE least(x * s + b, n) END]), CASE WHEN NOT fits AND last * s + b < n THEN [[n - b, n]] ELSE [] END)) AS w FROM lst),
back AS (SELECT *, coalesce(list_max(list_filter(range(1, w[1] + 2), lambda j: j = 1 OR regexp_matches(pieces[j], '^\s'))), 1) AS j FROM win),
made AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY section_no, w[1]) AS ordinal, {STRIP.format(f"prefix || CASE WHEN fits THEN body ELSE {passage} END")} AS t FROM back)
SELECT document_id, ordinal, md5(t) AS text_md5, {count} AS token_count FROM made"""


def _cut(spark: SparkSession, d: str, sizes: tuple[int, int, int, int], tokenizer: chunking.Tokenizer) -> DataFrame:
    rows = chunking.chunk(docs(spark, d).where("text is not null").select("document_id", "title", "text"), *sizes, tokenizer=tokenizer)
    return rows.select("document_id", F.col("ordinal").cast("long").alias("ordinal"), F.md5("text").alias("text_md5"), F.col("token_count").cast("long").alias("token_count"))


_SIGN_SIZES, _LETTER_SIZES = (60, 90, 110, 12), (300, 500, 560, 60)


@query(_cut_sql(f"len(regexp_extract_all(prefix, '{_TOKEN}'))", f"len(regexp_extract_all(body, '{_TOKEN}'))", _SIGN_SIZES, r"regexp_replace(array_to_string(list_slice(pieces, j, w[2]), ''), '^\s+', '')", f"len(regexp_extract_all(t, '{_TOKEN}'))"))
def chk_tokenizer(spark, d):
    """A tokenizer of words and signs that knows their places: passages are cut from the source, from the begin of a word on."""
    return _cut(spark, d, _SIGN_SIZES, chunking.Tokenizer(spans=_signs))


@query(_cut_sql("length(prefix)", "length(body)", _LETTER_SIZES, "substr(body, w[1] + 1, w[2] - w[1])", "length(t)"))
def chk_fallback(spark, d):
    """A tokenizer that only encodes and decodes, here code points: passages are what it makes of a window's ids."""
    return _cut(spark, d, _LETTER_SIZES, chunking.Tokenizer(encode=lambda text: [ord(c) for c in text], decode=lambda ids: "".join(map(chr, ids))))


# ---------------------------------------------------------------- plans of work


_SEGMENTS = f"""{CHUNK}, n AS (SELECT source_id, chunk_id, row_number() OVER (PARTITION BY source_id ORDER BY document_id, ordinal, chunk_id) - 1 AS position FROM chunk)"""


def _plan(spark: SparkSession, d: str, most: int = 50, cap: int = 120) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks with their shard and position, the shards, and their segments in jobs, with where each begins in its job."""
    rows = planning.placed(chunk_rows(spark, d).select("source_id", "document_id", "ordinal", "chunk_id"), ["source_id"], ["document_id", "ordinal", "chunk_id"])
    rows = rows.select(F.col("source_id").alias("shard"), "chunk_id", (F.col("_at") - 1).alias("position"), F.floor((F.col("_at") - 1) / most).alias("segment"))
    shards = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("records")).withColumn("signature", F.concat(F.lit("n"), F.col("records").cast("string")))
    cuts = rows.groupBy("shard", "segment").agg(F.min("position").alias("original_start"), F.count(F.lit(1)).alias("count")).withColumn("all", F.lit(0))
    jobs = planning.next_fit(cuts, ["all"], ["shard", "original_start"], "count", cap)
    offset = F.coalesce(F.sum("count").over(Window.partitionBy("job").orderBy("shard", "original_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, shards, jobs.withColumn("output_offset", offset).join(shards.select("shard", "signature"), "shard").drop("all")


@query(f"WITH {_SEGMENTS} SELECT source_id AS shard, position, chunk_id FROM n")
def snk_import(spark, d):
    """Rows of capped jobs back at the places of the shards they came from: here each row's vector is the hash of its chunk."""
    rows, shards, jobs = _plan(spark, d)
    stand_in = lambda c: F.array(F.xxhash64(c).cast("double"))
    inside = (F.col("r.shard") == F.col("j.shard")) & F.col("r.segment").eqNullSafe(F.col("j.segment"))
    out = rows.alias("r").join(jobs.alias("j"), inside).select("j.job", (F.col("r.position") - F.col("j.original_start") + F.col("j.output_offset")).alias("at"), stand_in("r.chunk_id").alias("embedding"))
    back = sinks.imported(jobs, out, shards)
    known = rows.select("chunk_id", stand_in("chunk_id")[0].alias("h"))
    return back.join(known, back["embedding"][0] == known["h"]).select("shard", "position", "chunk_id")


@query(f"""WITH {_SEGMENTS}, g AS (SELECT source_id, position // 50 AS segment, min(position) AS s, count(*) AS n FROM n GROUP BY 1, 2), kept AS (SELECT * FROM g WHERE segment % 4 <> 1),
e AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected FROM kept) SELECT source_id AS shard, s AS original_start, expected::BIGINT AS expected FROM e WHERE s <> expected""")
def win_contiguity(spark, d):
    """Segments after one that is missing, every fourth, don't begin where those before end."""
    _, _, jobs = _plan(spark, d)
    return ledger.gaps(jobs.where("segment % 4 <> 1").select("shard", "original_start", "count"), "shard", "original_start", "count").select("shard", "original_start", F.col("expected").cast("long").alias("expected"))


@query(f"""WITH {_SEGMENTS}, g AS (SELECT source_id, position // 50 AS segment, min(position) AS s, count(*) AS n FROM n GROUP BY 1, 2) SELECT source_id AS shard, count(*) AS segments, sum(n)::BIGINT AS vectors, true AS whole FROM g GROUP BY 1""")
def jn_segments(spark, d):
    """Segments of the markers joined to the shards as they are now: how many each has, and whether they add up to it."""
    _, shards, jobs = _plan(spark, d)
    per = jobs.groupBy("shard", "signature").agg(F.count(F.lit(1)).alias("segments"), F.sum("count").alias("vectors"))
    return per.join(shards, ["shard", "signature"]).select("shard", "segments", "vectors", (F.col("vectors") == F.col("records")).alias("whole"))


@query(f"""WITH RECURSIVE {_SEGMENTS}, g AS (SELECT source_id, min(position) AS s, count(*) AS n, row_number() OVER (ORDER BY source_id, min(position)) AS i FROM n GROUP BY source_id, position // 50),
f AS (SELECT source_id, n, i, 0 AS job, n AS used FROM g WHERE i = 1 UNION ALL SELECT g.source_id, g.n, g.i, CASE WHEN f.used > 0 AND f.used + g.n > 120 THEN f.job + 1 ELSE f.job END, CASE WHEN f.used > 0 AND f.used + g.n > 120 THEN g.n ELSE f.used + g.n END FROM f JOIN g ON g.i = f.i + 1)
SELECT job, sum(t)::BIGINT AS tasks, sum(c)::BIGINT AS chunks, string_agg(source_id || '=' || c, ',' ORDER BY source_id) AS per_source FROM (SELECT job, source_id, count(*) AS t, sum(n)::BIGINT AS c FROM f GROUP BY 1, 2) GROUP BY 1""")
def agg_job_record(spark, d):
    """What each job holds, of which sources; entries of the map as text."""
    _, _, jobs = _plan(spark, d)
    made = planning.job_records(jobs, "shard", "count")
    entries = F.transform(F.map_entries("per_source"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return made.select(F.col("job").cast("long").alias("job"), "tasks", "chunks", F.array_join(entries, ",").alias("per_source"))


@query(f"""WITH RECURSIVE {FILES}, n AS (SELECT source_id, filename, coalesce(actual_bytes, 0) AS size, row_number() OVER (PARTITION BY source_id ORDER BY filename) AS i FROM file),
f AS (SELECT *, 0 AS job, size AS used FROM n WHERE i = 1 UNION ALL SELECT n.*, CASE WHEN f.used > 0 AND f.used + n.size > 1000000 THEN f.job + 1 ELSE f.job END, CASE WHEN f.used > 0 AND f.used + n.size > 1000000 THEN n.size ELSE f.used + n.size END FROM f JOIN n ON n.source_id = f.source_id AND n.i = f.i + 1)
SELECT source_id, filename, job AS bundle FROM f""")
def win_bundle_rotate(spark, d):
    rows = files(spark, d).select("source_id", "filename", F.coalesce("actual_bytes", F.lit(0)).alias("size"))
    return planning.next_fit(rows, ["source_id"], ["filename"], "size", 1_000_000, "bundle").select("source_id", "filename", F.col("bundle").cast("long").alias("bundle"))


# ---------------------------------------------------------------- ledgers and joins


@query(f"""WITH {FILES}, lines AS (SELECT filename, min(lower(expected_checksum)) AS listed FROM file WHERE expected_checksum IS NOT NULL AND length(expected_checksum) IN (32, 40, 64) GROUP BY 1)
SELECT source_id, file.filename, CASE WHEN listed IS NULL THEN 'unlisted' WHEN sha256 IS NULL THEN 'unknown' WHEN lower(sha256) = listed THEN 'same' ELSE 'other' END AS verdict FROM file LEFT JOIN lines USING (filename)""")
def jn_checksum(spark, d):
    """Files against the lines of a checksum file, written and read again."""
    own = files(spark, d)
    lines = own.where("expected_checksum is not null").select(F.concat(F.upper("expected_checksum"), F.lit(" *raw/"), "filename").alias("value"))
    read = spark.read.text(rendered(spark, lines)).select(tx.checksum_line(F.col("value")).alias("l")).where("l is not null").select("l.*")
    return ledger.compared(own, read, "filename", "sha256").select("source_id", "filename", "verdict")


@query("""WITH base AS (SELECT source_id, filename, min(url) AS url FROM manifest_file GROUP BY 1, 2), ch AS (SELECT source_id, filename, arg_max(status, updated_at) AS status, arg_max(actual_bytes::VARCHAR, updated_at) FILTER (actual_bytes IS NOT NULL) AS b FROM manifest_file WHERE updated_at IS NOT NULL AND source_id IS NOT NULL AND filename IS NOT NULL GROUP BY 1, 2)
SELECT source_id, filename, url, coalesce(status, 'new') AS status, coalesce(b::BIGINT, -1) AS actual_bytes FROM base LEFT JOIN ch USING (source_id, filename)""")
def st_manifest_update(spark, d):
    """New rows after all changes of their status and size, each field by its last."""
    m = table(spark, d, "manifest_file")
    rows = m.groupBy("source_id", "filename").agg(F.min("url").alias("url")).withColumn("status", F.lit("new")).withColumn("actual_bytes", F.lit(-1).cast("long"))
    timed = m.where("updated_at is not null")
    change = lambda c: timed.where(F.col(c).isNotNull()).select("source_id", "filename", F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), "updated_at")
    return ledger.changed_fields(rows, change("status").unionByName(change("actual_bytes")), ["source_id", "filename"], ["status", "actual_bytes"], "updated_at")


@query("""WITH l AS (SELECT source_id, filename, updated_at, row_number() OVER (PARTITION BY source_id, filename ORDER BY updated_at DESC) AS r FROM manifest_file WHERE updated_at IS NOT NULL)
SELECT source_id, count(*) AS kept, sum(r - 1)::BIGINT AS dropped FROM (SELECT source_id, filename, max(r) AS r FROM l GROUP BY 1, 2) GROUP BY 1""")
def st_compact(spark, d):
    """A ledger with many states of an input, one kept of each."""
    all_ = table(spark, d, "manifest_file").where("updated_at is not null").select("source_id", "filename", "updated_at")
    kept = dedup.first_wins(all_, ["source_id", "filename"], F.desc("updated_at")).groupBy("source_id").agg(F.count(F.lit(1)).alias("kept"))
    before = all_.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(before, "source_id").select("source_id", "kept", (F.col("n") - F.col("kept")).alias("dropped"))


@query("SELECT source_id, filename, row_number() OVER (ORDER BY source_id, filename) AS line FROM (SELECT DISTINCT source_id, filename FROM manifest_file WHERE source_id IS NOT NULL AND filename IS NOT NULL)")
def top_export_order(spark, d):
    """The lines of the manifest's export, by source and name."""
    rows = table(spark, d, "manifest_file").where("source_id is not null and filename is not null").select("source_id", "filename").distinct()
    return planning.numbered(rows, ["source_id", "filename"], "line").select("source_id", "filename", F.col("line").cast("long").alias("line"))


@query(f"WITH {DOC} SELECT DISTINCT source_id FROM doc WHERE source_id NOT IN (SELECT source_id FROM manifest_file WHERE status = 'planned' AND source_id IS NOT NULL)")
def jn_source_cfg(spark, d):
    """Sources of documents that a configuration, here of the planned ones, lacks."""
    return ledger.missing_keys(docs(spark, d), table(spark, d, "manifest_file").where("status = 'planned'"), "source_id")


@query("SELECT DISTINCT source AS source_id FROM documents WHERE source IS NOT NULL EXCEPT SELECT source_id FROM corpus_document")
def set_difference(spark, d):
    return table(spark, d, "documents").where("source is not null").select(F.col("source").alias("source_id")).subtract(table(spark, d, "corpus_document").select("source_id"))


@query("""SELECT record_id, judged_at, array_to_string(list_sort(list_filter(list_distinct(list_concat(coalesce(categories, []), coalesce(curation.quality_flags, []))), lambda x: x NOT IN ('short', 'boilerplate') AND x IS NOT NULL)), ',') AS rest FROM curation_smoke""")
def set_union_minus(spark, d):
    """The union of two lists of a row without those allowed."""
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("categories", none), F.coalesce("curation.quality_flags", none))
    return table(spark, d, "curation_smoke").select("record_id", "judged_at", F.array_join(F.array_sort(F.array_except(both, F.array(F.lit("short"), F.lit("boilerplate")))), ",").alias("rest"))


@query(f"WITH {CHUNK} SELECT chunk_id FROM chunk WHERE source_id NOT IN ('conference_abstracts', 'encyclo_biology')")
def flt_qa_exclude(spark, d):
    """The chunks an index takes when sources are held out."""
    return chunk_rows(spark, d).where(~F.col("source_id").isin("conference_abstracts", "encyclo_biology")).select("chunk_id")


@query(rf"""WITH {DOC}, line AS (SELECT document_id, unnest(string_split({LINES.format("concat_ws(chr(10), text, 'Contents', url)")}, chr(10))) AS l FROM doc)
SELECT document_id, count(*) AS dropped FROM (SELECT document_id, {STRIP.format('l')} AS l FROM line) WHERE regexp_matches(l, '(?i)^https?://[^\s]+$') OR lower(l) IN ('contents', 'table of contents') GROUP BY 1""")
def flt_url_line(spark, d):
    """Lines of texts with a contents line and the address at their end."""
    every = cleaning.lines(docs(spark, d).withColumn("text", F.concat_ws("\n", "text", F.lit("Contents"), "url")))
    return every.where(cleaning.is_address() | cleaning.is_contents()).groupBy("document_id").agg(F.count(F.lit(1)).alias("dropped"))


@query("""SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= 5""")
def idx_flat(spark, d):
    """The five best of all vectors by exact inner product for every vector whose id is divisible by 20."""
    from .operators.retrieval import dense

    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    names = v.select(F.lpad(F.col("vec_id").cast("string"), 19, "0").alias("chunk_id"), "embedding")
    return dense(asked, names, 5).select(F.col("query_id").cast("long").alias("query_id"), F.col("chunk_id").cast("long").alias("vec_id"), "score")


# ---------------------------------------------------------------- records and scalars


@query("""SELECT record_id, judged_at, source_id, coalesce(title, '') AS title, coalesce(license_id, 'unknown') AS license_id, md5(substr(coalesce(text, ''), 1, 6000)) AS excerpt_md5 FROM curation_smoke""")
def prj_curation_prompt(spark, d):
    """The fields a judge may see, as JSON, read back."""
    c = table(spark, d, "curation_smoke")
    seen = F.struct("source_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("license_id", F.lit("unknown")).alias("license_id"), F.coalesce("retracted", F.lit(False)).alias("retracted"), F.col("categories").alias("existing_categories"), F.substring(F.coalesce("text", F.lit("")), 1, 6000).alias("excerpt"))
    get = lambda f: F.get_json_object("prompt", f"$.{f}")
    return c.select("record_id", "judged_at", F.to_json(seen).alias("prompt")).select("record_id", "judged_at", get("source_id").alias("source_id"), get("title").alias("title"), get("license_id").alias("license_id"), F.md5(get("excerpt")).alias("excerpt_md5"))


@query("SELECT DISTINCT url, substr(sha256(url), 1, 20) || '.pdf' AS filename FROM manifest_file WHERE url IS NOT NULL AND status = 'complete'")
def prj_book_item(spark, d):
    return table(spark, d, "manifest_file").where("url is not null and status = 'complete'").select("url", F.concat(F.substring(F.sha2("url", 256), 1, 20), F.lit(".pdf")).alias("filename")).distinct()


@query("""SELECT o_orderkey, floor(o_orderkey % 1000 * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1048576 ELSE 1000000000 END)::BIGINT AS bytes FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 0""")
def fn_byte_count(spark, d):
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(F.lit(""), F.lit(" kB"), F.lit("MiB"), F.lit(" GB ")), (k % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", tx.byte_count(F.concat((k % 1000).cast("string"), F.when(k % 5 == 0, F.lit(" parsecs")).otherwise(unit))).alias("bytes"))


@query("SELECT pmid, trim(regexp_replace(question, '\\s+', ' ', 'g')) || ' & more' AS text FROM pubmedqa_item")
def fn_plain_markup(spark, d):
    page = F.concat(F.lit("<html><style>p {}</style><script>var x = '<b>';</script><p>"), xml("question"), F.lit("</p>\n <br/> &amp; <b>more</b></html>"))
    return table(spark, d, "pubmedqa_item").select("pmid", tx.plain_markup(page).alias("text"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'CC BY' WHEN 1 THEN 'CC BY,CC BY-NC-SA' WHEN 2 THEN 'CC0' ELSE '' END AS codes FROM part""")
def fn_cc_licenses(spark, d):
    by, nc, zero = (F.lit(f"https://creativecommons.org/{x}") for x in ("licenses/by/4.0/", "licenses/BY-NC-SA/3.0/de", "publicdomain/zero/1.0/"))
    k = F.col("p_partkey") % 4
    links = F.when(k == 0, F.array(by, by)).when(k == 1, F.array(nc, F.lit("https://x.org"), by)).when(k == 2, F.array(zero)).otherwise(F.array(F.lit("https://x.org/licenses/by/4.0")))
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.cc_licenses(links), ",").alias("codes"))


@query("SELECT DISTINCT filename, 'https://bucket.s3.amazonaws.com/a/' || filename AS url, md5(filename) AS md5 FROM manifest_file WHERE filename IS NOT NULL")
def prj_s3_url(spark, d):
    made = tx.https_of_s3(F.concat(F.lit("s3://bucket/a/"), "filename", F.lit("?md5="), F.md5("filename")))
    return table(spark, d, "manifest_file").where("filename is not null").select("filename", made.alias("u")).select("filename", "u.url", "u.md5").distinct()


@query("""WITH g AS (SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1) SELECT user_id, counts, (SELECT count(*) FROM events e WHERE e.user_id = g.user_id) AS events FROM g""")
def fn_multimap(spark, d):
    """Ids by kind of event as a map of lists, its sizes, and a map put over another."""
    pairs = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("key"), F.col("event_id").alias("value"))).alias("pairs"))
    sizes = F.transform_values(tx.multimap(F.col("pairs")), lambda k, v: F.size(v))
    zero = F.create_map(F.lit("click"), F.lit(0), F.lit("none"), F.lit(0))
    both = F.map_filter(tx.merged(zero, sizes), lambda k, v: v > 0)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(both)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return pairs.select("user_id", text.alias("counts"), F.size("pairs").cast("long").alias("events"))


# ---------------------------------------------------------------- runs


_KINDS = {"view": "trace", "signup": "trace", "click": "delta", "purchase": "completed", "error": "failed"}
_RUN = """run AS (SELECT user_id::VARCHAR AS run_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'delta' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'trace' END AS kind, 't' || (event_id % 7) AS tid, event_id::VARCHAR AS payload FROM events),
trace AS (SELECT run_id, tid, max(seq) AS seq FROM run WHERE kind = 'trace' GROUP BY 1, 2), moved AS (SELECT run_id, string_agg(tid, ',' ORDER BY seq) AS trace_ids FROM trace GROUP BY 1),
last AS (SELECT run_id, max(seq) FILTER (kind = 'completed') AS done, max(seq) FILTER (kind = 'failed') AS failed, max(seq) AS seq FROM run GROUP BY 1)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as those of runs, a run a user."""
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("kind"), F.concat(F.lit("t"), (F.col("event_id") % 7).cast("string")).alias("event_id"), F.col("event_id").cast("string").alias("payload"))


@query(f"""WITH {_RUN} SELECT last.run_id, coalesce(trace_ids, '') AS trace_ids, md5(coalesce(done::VARCHAR, '') || coalesce((SELECT string_agg(payload, '' ORDER BY seq) FROM run WHERE run.run_id = last.run_id AND kind = 'delta' AND run.seq > coalesce(done, -1)), '')) AS markdown_md5,
 CASE WHEN coalesce(failed, -1) > coalesce(done, -1) THEN 'failed' WHEN done IS NOT NULL THEN 'completed' ELSE 'running' END AS status, failed::VARCHAR AS error, last.seq FROM last LEFT JOIN moved USING (run_id)""")
def str_run_reducer(spark, d):
    """The state of each run after all its events."""
    return runs.run_states_batch(_events(spark, d)).select("run_id", F.array_join("trace_ids", ",").alias("trace_ids"), F.md5("markdown").alias("markdown_md5"), "status", "error", "seq")


@query(f"WITH {_RUN} SELECT run_id, tid AS event_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS place FROM trace")
def win_trace_upsert(spark, d):
    """Where each trace event of a run stands: an event that comes again replaces its id's and moves to the end."""
    last = _events(spark, d).where("kind = 'trace'").groupBy("run_id", "event_id").agg(F.max("seq").alias("seq"))
    return last.select("run_id", "event_id", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")).cast("long").alias("place"))


@query(f"WITH {_RUN} SELECT count(*) FILTER (done IS NULL AND failed IS NULL) AS running, count(*) FILTER (done IS NOT NULL OR failed IS NOT NULL) AS ended FROM last")
def agg_active(spark, d):
    states = runs.run_states_batch(_events(spark, d))
    return states.agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") != "running").alias("ended"))


@query("SELECT user_id, round(sum(value), 4) AS duration, sum(try_cast(props->>'$.k' AS BIGINT))::BIGINT AS tokens, count(props->>'$.k') AS calls FROM events GROUP BY 1")
def agg_trace(spark, d):
    """Durations, tokens and calls of each run's events."""
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("duration"), F.sum(k.cast("long")).alias("tokens"), F.count(k).alias("calls"))


@query("SELECT source_id, document_id FROM (SELECT source_id, document_id, row_number() OVER (PARTITION BY source_id, content_sha256 ORDER BY ingested_at, document_id) AS r FROM corpus_document WHERE content_sha256 IS NOT NULL) WHERE r = 1 AND document_id IS NOT NULL")
def str_incremental_ingest(spark, d):
    """Deliveries in two batches by parity of a hash, the earlier ones first of their digest; what the first batch has seen the second leaves."""
    rows = table(spark, d, "corpus_document").where("content_sha256 is not null")
    each = dedup.first_wins(rows, ["source_id", "content_sha256"], "ingested_at", "document_id").select("source_id", "document_id", F.col("content_sha256").alias("digest"), F.concat(F.lit("batch-"), F.pmod(F.xxhash64("content_sha256"), F.lit(2)).cast("string")).alias("owner"))
    scope = F.concat(F.lit("document:"), "source_id")
    first = each.where("owner = 'batch-0'")
    seen = dedup.remembered(spark.createDataFrame([], "kind string, digest string, owner string"), first, scope, F.col("digest"), "owner")
    return first.unionByName(dedup.unseen(each, seen, scope, F.col("digest"), "owner").where("owner = 'batch-1'")).where("document_id is not null").select("source_id", "document_id")
