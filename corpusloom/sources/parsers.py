"""Readers of each source format as DataFrames of documents."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stable_id, strip
from ..operators.ledger import first_reason
from . import markup
from .records import qa_text, sectioned

DOCUMENT = "document_id string, source_id string, category string, title string, text string, source_path string, external_id string, url string, license_id string, authors array<string>, published string, section string, metadata string, schema_version string"
COLUMNS = [c.split()[0] for c in DOCUMENT.split(", ")]
#: What parsers give: documents, and records that can't be parsed with their error and no text.
PARSED = f"{DOCUMENT}, error string"


def document(rows: DataFrame, source: dict, identity: Column, title: Column, text: Column, **more: Column) -> DataFrame:
    """Rows with ``path`` as documents; an empty title becomes the file's stem, columns not given are null."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    own = {
        "document_id": stable_id(F.lit(source["source_id"]), identity),
        "source_id": F.lit(source["source_id"]),
        "category": F.lit(source.get("category")),
        "title": F.coalesce(F.nullif(strip(F.coalesce(title, F.lit(""))), F.lit("")), stem),
        "text": text,
        "source_path": F.col("path"),
        "license_id": F.lit(source.get("license_id")),
        "authors": F.array().cast("array<string>"),
        "metadata": F.lit("{}"),
        "schema_version": F.lit("1.0"),
    } | more
    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string").alias("error")
    return rows.select(*[own.get(c, F.lit(None)).cast("array<string>" if c == "authors" else "string").alias(c) for c in COLUMNS], error)


def _xml_records(spark: SparkSession, paths: list[str], tag: str, whole: bool = True) -> DataFrame:
    """(path, ordinal, xml): the elements ``tag`` of each file; a file without any is one record where ``whole``.

    The reader ends a row at each end tag, so a file is read record by record, and large ones by several tasks; only a file
    whose tags carry a prefix comes as one row. ``ordinal`` stands for the record's content.
    """
    rows = spark.read.option("lineSep", f"</{tag}>").text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    own = F.regexp_extract("value", rf"(?s)<{tag}(?:\s[^>]*)?>.*", 0)
    prefixed = F.regexp_extract_all("value", F.lit(rf"(?s)<\w+:{tag}(?:\s[^>]*)?>.*?</\w+:{tag}>"), F.lit(0))
    content = F.regexp_replace("value", r"(?s)<!--.*?-->|</[\w:.-]+\s*>|\s+", "") != ""  # more than end tags
    found = F.when(own != "", F.array(F.concat(own, F.lit(f"</{tag}>")))).when(F.size(prefixed) > 0, prefixed)
    found = found.when(content & F.lit(whole), F.array("value")).otherwise(F.array().cast("array<string>"))
    return rows.select("path", F.explode(found).alias("xml")).select("path", F.xxhash64("xml").alias("ordinal"), "xml")


def _parsed(rows: DataFrame, parse: Callable[[str], dict], schema: str) -> DataFrame:
    """rows with column r, the parsed record, or error where it can't be parsed."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for xml in b["xml"]:
                try:
                    r = parse(xml)
                    out.append([r.get(n) for n in names] + [None])
                except Exception as e:  # a bad record is a row with an error, not the end of the job
                    out.append([None] * len(names) + [f"{type(e).__name__}: {e}"[:500]])
            yield pd.concat([b[["path", "ordinal"]].reset_index(drop=True), pd.DataFrame(out, columns=[*names, "error"])], axis=1)

    return rows.mapInPandas(run, f"path string, ordinal long, {schema}, error string")


def pubmed_jsonl(spark, paths, source):
    schema = "pmid string, title string, abstract string, url string, year string, doi string, journal string, mesh array<struct<name: string, ui: string, major: boolean>>, keywords array<string>, publication_types array<string>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(paths).select("*", F.col("_metadata.file_path").alias("path")).where(F.coalesce("abstract", F.lit("")) != "")
    pmid = F.nullif(F.col("pmid"), F.lit(""))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("PubMed "), F.coalesce(pmid, F.lit(""))))
    identity = F.coalesce(pmid, F.concat_ws(":", F.element_at(F.split("path", "/"), -1), title))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c)
    meta = F.to_json(F.struct("doi", "journal", empty("mesh"), empty("keywords"), empty("publication_types")))
    return document(rows, source, identity, title, sectioned(("Abstract", F.col("abstract"))), external_id=pmid, url=F.col("url"), published=F.nullif(F.col("year"), F.lit("")), metadata=meta)


def jats_xml(spark, paths, source):
    tables = [p for p in paths if p.lower().endswith((".txt", ".csv", ".tsv"))]
    xml = [p for p in paths if p not in tables]
    out = delimited(spark, tables, source) if tables else None
    if xml or out is None:
        schema = "external_id string, doi string, title string, authors array<string>, published string, text string"
        rows = _parsed(_xml_records(spark, xml, "article"), markup.article, schema)
        identity = F.coalesce("external_id", "doi", F.concat_ws(":", "path", F.col("ordinal").cast("string"), "title"))
        url = F.concat(F.lit("https://doi.org/"), "doi")
        made = document(rows, source, identity, F.col("title"), F.col("text"), external_id=F.col("external_id"), url=url, authors=F.col("authors"), published=F.col("published"), metadata=F.to_json(F.struct("doi")))
        out = made if out is None else out.unionByName(made)
    return out


def wikipedia_json(spark, paths, source):
    page = "struct<pageid: long, title: string, canonicalurl: string, fullurl: string, length: long, revisions: array<struct<revid: long, timestamp: string, slots: struct<main: struct<content: string>>>>>"
    whole = spark.read.schema(f"query struct<pages: array<{page}>>").option("multiLine", True).json(paths)
    pages = whole.select(F.col("_metadata.file_path").alias("path"), F.explode("query.pages").alias("p")).where(F.size("p.revisions") > 0)
    plain = F.pandas_udf(lambda s: s.map(lambda x: markup.wiki_sections(x or "")), T.StringType())
    last = F.col("p.revisions")[0]
    key = F.coalesce(F.col("p.pageid").cast("string"), "p.title")
    meta = F.to_json(F.struct(last["revid"].alias("revision_id"), F.col("p.length").alias("page_length")))
    return document(pages, source, key, F.coalesce("p.title", key), plain(last["slots"]["main"]["content"]), external_id=key, url=F.coalesce("p.canonicalurl", "p.fullurl"), published=last["timestamp"], metadata=meta)


def mesh_xml(spark, paths, source):
    rows = _parsed(_xml_records(spark, paths, "DescriptorRecord"), markup.descriptor, "external_id string, title string, text string")
    return document(rows, source, F.coalesce("external_id", F.concat_ws(":", "path", F.col("ordinal").cast("string"))), F.col("title"), F.col("text"), external_id=F.col("external_id"))


def uniprot_dat(spark, paths, source):
    """Records end with a line //; each line has a two-letter code and a value from column six."""
    records = spark.read.option("lineSep", "\n//").text(paths).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("lines"))

    def lines_of(code: str) -> Column:
        return F.transform(F.filter("lines", lambda x: F.substring(x, 1, 2) == code), lambda x: strip(F.substr(x, F.lit(6))))

    accession = F.nullif(F.split(F.get(lines_of("AC"), F.lit(0)), ";")[0], F.lit(""))
    entry = F.coalesce(F.nullif(F.split(F.get(lines_of("ID"), F.lit(0)), r"\s+")[0], F.lit("")), accession)
    about, organism = F.array_join(lines_of("DE"), " "), F.array_join(lines_of("OS"), " ")
    parts = [("Protein", F.coalesce(entry, F.lit(""))), ("Description", about), ("Organism", organism), ("Function and comments", F.array_join(lines_of("CC"), "\n")), ("Cross-references", F.array_join(lines_of("DR"), "\n")), ("Keywords", F.array_join(lines_of("KW"), " "))]
    text = F.concat_ws("\n\n", *[F.concat(F.lit(f"## {h}\n\n"), b) for h, b in parts])
    known = records.where(F.exists("lines", lambda x: F.substring(x, 1, 2).rlike("[A-Z]{2}")))
    url = F.concat(F.lit("https://www.uniprot.org/uniprotkb/"), accession)
    return document(known, source, F.coalesce(accession, entry), F.coalesce(F.nullif(about, F.lit("")), entry), text, external_id=accession, url=url, metadata=F.to_json(F.struct(entry.alias("entry_name"), organism.alias("organism"))))


def obo(spark, paths, source):
    """[Term] stanzas of ``key: value`` lines; obsolete terms stay."""
    stanzas = spark.read.option("lineSep", "\n[").text(paths).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^\[", "").alias("value"))
    terms = stanzas.where(F.col("value").startswith("Term]")).withColumn("lines", F.transform(F.split("value", "\n"), strip))

    def values(key: str) -> Column:
        return F.transform(F.filter("lines", lambda x: x.startswith(f"{key}: ")), lambda x: F.substr(x, F.lit(len(key) + 3)))

    own = F.coalesce(F.get(values("id"), F.lit(0)), F.lit(""))
    title = F.coalesce(F.get(values("name"), F.lit(0)), own)
    head = F.concat(F.lit("## Gene Ontology term\n\n"), title, F.lit("\n\n"), F.array_join(values("def"), " "))
    text = F.concat_ws("\n\n", head, F.nullif(sectioned(("Synonyms", F.array_join(values("synonym"), "\n")), ("Relations", F.array_join(F.concat(values("is_a"), values("relationship")), "\n"))), F.lit("")))
    return document(terms.where(F.size("lines") > 1), source, own, title, text, external_id=own)


def reactome_tsv(spark, paths, source):
    rows = spark.read.schema("Identifier string, Name string, Summation string").option("sep", "\t").option("header", True).option("encoding", "UTF-8").csv(paths)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"))
    own = F.coalesce("Identifier", F.lit(""))
    text = F.concat(F.lit("## Pathway summary\n\n"), F.coalesce("Summation", F.lit("")))
    url = F.when(own != "", F.concat(F.lit("https://reactome.org/content/detail/"), own))
    return document(rows, source, own, F.coalesce("Name", own), text, external_id=own, url=url)


def pubmedqa(spark, paths, source):
    item = "struct<QUESTION: string, CONTEXTS: array<string>, LONG_ANSWER: string, YEAR: string, final_decision: string, LABELS: array<string>, MESHES: array<string>>"
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"map<string, {item}>").alias("m"))
    rows = whole.select("path", F.explode("m").alias("pmid", "r")).select("path", "pmid", "r.*")
    meta = F.to_json(F.struct(F.col("final_decision").alias("decision"), F.col("LABELS").alias("labels"), F.col("MESHES").alias("mesh")))
    url = F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/"))
    return document(rows, source, F.col("pmid"), F.col("QUESTION"), qa_text("QUESTION", "CONTEXTS", "LONG_ANSWER"), external_id=F.col("pmid"), url=url, published=F.col("YEAR"), metadata=meta)


def delimited(spark, paths, source):
    """Each row of CSV and TSV files as ``key: value`` lines; a text file is one document."""
    out = None
    for path in paths:
        if path.lower().endswith((".csv", ".tsv")):
            rows = spark.read.option("header", True).option("sep", "\t" if path.lower().endswith(".tsv") else ",").option("multiLine", True).csv(path)
            cells = [F.when(F.coalesce(F.col(f"`{c}`"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in rows.columns]
            rows = rows.select(F.array_join(F.array_compact(F.array(*cells)), "\n").alias("text"), F.monotonically_increasing_id().alias("n")).withColumn("path", F.lit(path)).where("text <> ''")
            made = document(rows, source, F.concat_ws(":", "path", (F.col("n") + 1).cast("string")), F.lit(""), F.col("text"))
        else:
            rows = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text")).where(strip(F.col("text")) != "")
            made = document(rows, source, F.col("path"), F.lit(""), F.col("text"))
        out = made if out is None else out.unionByName(made)
    return out


def pdf_pages(pages: DataFrame, source: dict, per: int = 25) -> DataFrame:
    """Documents of ``pages(path, title, page, text)``: units of ``per`` pages, blank pages left out.

    The pages come from whatever reads PDF on the cluster; no reader is part of this library.
    """
    unit = pages.where(strip(F.coalesce("text", F.lit(""))) != "").withColumn("unit", F.floor((F.col("page") - 1) / per))
    last = pages.groupBy("path").agg(F.max("page").alias("pages"))
    rows = unit.groupBy("path", "unit").agg(F.max("title").alias("title"), F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p")).join(last, "path")
    a, b = F.col("unit") * per + 1, F.least((F.col("unit") + 1) * per, F.col("pages"))
    section = F.concat(F.lit("Pages "), a.cast("string"), F.lit("-"), b.cast("string"))
    text = F.concat(F.lit("## "), section, F.lit("\n\n"), F.array_join("p.text", "\n\n"))
    identity = F.concat_ws(":", F.element_at(F.split("path", "/"), -1), (a - 1).cast("string"))
    meta = F.to_json(F.struct(a.alias("page_start"), b.alias("page_end"), F.col("pages").alias("page_count")))
    return document(rows, source, identity, F.col("title"), text, section=section, metadata=meta)


CITATION = "pmid string, title string, abstract string, journal string, year string, doi string, languages array<string>, publication_types array<string>, keywords array<string>, mesh array<struct<name: string, ui: string, major: boolean>>"


def pubmed_citations(spark, paths):
    """Citations of PubMed XML files (also .gz), journal articles and book chapters; what can't be parsed has an error."""
    both = _xml_records(spark, paths, "PubmedArticle", False).unionByName(_xml_records(spark, paths, "PubmedBookArticle", False))
    return _parsed(both, markup.citation, CITATION)


#: Publication types that carry no findings of their own.
LOW_VALUE = ["editorial", "news", "newspaper article", "comment", "letter"]


def screened(citations: DataFrame, least: int = 300) -> DataFrame:
    """Citations with reason: accepted, or the first that applies of malformed, short_or_missing_abstract, non_english, retracted and low_value_type."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    types = F.transform("publication_types", F.lower)
    reasons = {
        "malformed": F.col("error").isNotNull() | blank("pmid") | blank("title"),
        "short_or_missing_abstract": F.coalesce(F.length("abstract"), F.lit(0)) < least,
        "non_english": (F.size("languages") > 0) & ~F.array_contains("languages", "eng"),
        "retracted": F.array_contains(types, "retracted publication"),
        "low_value_type": (F.size(types) > 0) & (F.size(F.array_except(types, F.array(*map(F.lit, LOW_VALUE)))) == 0),
    }
    return citations.withColumn("reason", first_reason(reasons))


def funnel(screened_: DataFrame) -> DataFrame:
    """(path, input, accepted and a column a reason): how many citations of each file came how far."""
    names = ["accepted", "malformed", "short_or_missing_abstract", "non_english", "retracted", "low_value_type"]
    return screened_.groupBy("path").agg(F.count(F.lit(1)).alias("input"), *[F.count_if(F.col("reason") == n).alias(n) for n in names])


def pdf(spark, paths, source, read: Callable[[bytes], list[str]] | None = None):
    """PDF files by 25 pages; ``read`` gives the texts of a file's pages, by default pypdf's where it is installed."""
    if read is None:
        try:
            from pypdf import PdfReader
        except ImportError:
            raise ValueError("a reader of PDF is needed: pypdf, or one handed over as read") from None

        def read(raw: bytes) -> list[str]:
            return [p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                texts = read(bytes(raw))
                yield pd.DataFrame({"path": path, "title": None, "page": range(1, len(texts) + 1), "text": texts})

    pages = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, title string, page long, text string")
    return pdf_pages(pages, source)


PARSERS: dict[str, Callable[[SparkSession, list[str], dict], DataFrame]] = {
    "pubmed_jsonl": pubmed_jsonl,
    "jats_xml": jats_xml,
    "wikipedia_json": wikipedia_json,
    "mesh_xml": mesh_xml,
    "uniprot_dat": uniprot_dat,
    "obo": obo,
    "reactome_tsv": reactome_tsv,
    "pubmedqa": pubmedqa,
    "pubmedqa_json": pubmedqa,
    "pdf": pdf,
    "csv_txt": delimited,
}


def parse(spark: SparkSession, paths: list[str], source: dict) -> DataFrame:
    """Documents of the files by the source's parser."""
    if source["parser"] not in PARSERS:
        raise ValueError(f"unknown parser: {source['parser']}")
    return PARSERS[source["parser"]](spark, paths, source)


def links_of(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(url, target, title) for each anchor of each page."""
    kind = T.ArrayType(T.StructType([T.StructField("target", T.StringType()), T.StructField("title", T.StringType())]))

    @F.pandas_udf(kind)
    def found(h: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([[{"target": t, "title": n} for t, n in markup.links(x or "", b or "")] for x, b in zip(h, base)])

    return pages.select(url, F.explode(found(html, url)).alias("l")).select(url, "l.target", "l.title")
