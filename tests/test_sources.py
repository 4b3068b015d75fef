import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.pipeline import Settings
from corpusloom.sources import archives, files, markup, parsers, sinks

SOURCE = {"source_id": "s", "category": "literature", "license_id": "CC0"}


def docs(spark, parser, path, **more):
    return parsers.parse(spark, [str(path)], SOURCE | {"parser": parser} | more).collect()


def test_pubmed_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl.gz"
    rows = [{"pmid": "1", "title": "T", "abstract": "Some text", "year": "2020", "doi": "10/x"}, {"pmid": "2", "title": "no abstract"}, {"pmid": "3", "abstract": "B"}]
    p.write_bytes(gzip.compress("\n\n".join(map(json.dumps, rows)).encode()))
    got = {r.external_id: r for r in docs(spark, "pubmed_jsonl", p)}
    assert set(got) == {"1", "3"} and got["1"].text == "## Abstract\n\nSome text" and got["3"].title == "PubMed 3"
    assert json.loads(got["1"].metadata) == {"doi": "10/x", "mesh": [], "keywords": [], "publication_types": []}
    assert got["1"].document_id.startswith("s:") and len(got["1"].document_id) == 26


JATS = """<?xml version="1.0"?><pmc-articleset><article><front><article-meta><article-id pub-id-type="pmc">PMC1</article-id><article-id pub-id-type="doi">10/y</article-id>
<title-group><article-title>A <i>mixed</i> title</article-title></title-group><contrib-group><contrib><name><surname>Li</surname><given-names>A B</given-names></name></contrib></contrib-group>
<pub-date><year>2021</year></pub-date><abstract><p>Short view.</p></abstract></article-meta></front><body><sec><title>Results</title><p>One <b>bold</b> word.</p><p>Two.</p></sec><ack><p>Thanks.</p></ack></body></article>
<article><front><article-meta><article-title>Second</article-title></article-meta></front><body><p>Text</p></body></article></pmc-articleset>"""


def test_jats(spark, tmp_path):
    p = tmp_path / "a.xml"
    p.write_text(JATS)
    got = {r.title: r for r in docs(spark, "jats_xml", p)}
    a = got["A mixed title"]
    assert (a.external_id, a.url, a.authors, a.published) == ("PMC1", "https://doi.org/10/y", ["A B Li"], "2021")
    assert a.text == "## Abstract\n\nShort view.\n\n## Results\n\nOne bold word.\n\nTwo.\n\nThanks."
    assert got["Second"].text == "## Content\n\nText"


def test_a_bad_record_is_an_error_row(spark, tmp_path):
    p = tmp_path / "b.xml"
    p.write_text("<article><p>open</article>")
    (bad,) = docs(spark, "jats_xml", p)
    assert bad.text is None and bad.error.startswith("ParseError") and bad.document_id.startswith("s:") and bad.title == "b"
    rows = parsers._parsed(parsers._xml_records(spark, [str(p)], "article"), markup.article, "title string").collect()
    assert rows[0].error.startswith("ParseError")


def test_wikipedia(spark, tmp_path):
    p = tmp_path / "w.json"
    text = "'''Membrane''' is a [[cell|cells']] part.{{cite|a{{b}}}}<ref>x</ref>[1]\n== Role ==\nIt [[gate]]s.\n=== Deep ===\nMore\n== References ==\n* x"
    p.write_text(json.dumps({"query": {"pages": [{"pageid": 7, "title": "M", "canonicalurl": "https://w/M", "revisions": [{"revid": 3, "timestamp": "2024", "slots": {"main": {"content": text}}}]}, {"pageid": 8, "title": "none"}]}}))
    (r,) = docs(spark, "wikipedia_json", p)
    assert r.text == "## Introduction\n\nMembrane is a cells' part.\n\n## Role\n\nIt gates.\n\n## Deep\n\nMore"
    assert (r.external_id, r.url, r.published) == ("7", "https://w/M", "2024") and json.loads(r.metadata)["revision_id"] == 3


def test_mesh_uniprot_obo_reactome(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<Set><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Name</String></DescriptorName><ScopeNote>Scope</ScopeNote><Annotation>Note</Annotation><Term>Scope</Term></DescriptorRecord></Set>")
    (r,) = docs(spark, "mesh_xml", tmp_path / "m.xml")
    assert (r.external_id, r.text) == ("D1", "## MeSH descriptor\n\nName\n\nNote\n\nScope")
    (tmp_path / "u.dat").write_text("ID   P53_HUMAN  Reviewed\nAC   P04637; Q1;\nDE   RecName: P53\nOS   Homo\nOS   sapiens\nCC   -!- FUNCTION\nCC       acts\nKW   Repair\n//\nID   X_Y\nAC   Q2;\n//\n")
    a, b = sorted(docs(spark, "uniprot_dat", tmp_path / "u.dat"), key=lambda r: r.external_id)
    assert a.external_id == "P04637" and "## Organism\n\nHomo sapiens" in a.text and "-!- FUNCTION\nacts" in a.text and b.title == "X_Y"
    (tmp_path / "o.obo").write_text("format-version: 1.2\n\n[Term]\nid: GO:1\nname: thing\ndef: \"d\"\nsynonym: \"s\"\nis_a: GO:0\n\n[Typedef]\nid: part_of\n\n[Term]\nid: GO:2\nis_obsolete: true\n")
    got = {r.external_id: r for r in docs(spark, "obo", tmp_path / "o.obo")}
    assert set(got) == {"GO:1", "GO:2"} and got["GO:1"].text == '## Gene Ontology term\n\nthing\n\n"d"\n\n## Synonyms\n\n"s"\n\n## Relations\n\nGO:0' and got["GO:2"].title == "GO:2"
    (tmp_path / "r.tsv").write_text("Identifier\tName\tSummation\nR-1\tPath\tWhat it does\n")
    (r,) = docs(spark, "reactome_tsv", tmp_path / "r.tsv")
    assert (r.title, r.text, r.url) == ("Path", "## Pathway summary\n\nWhat it does", "https://reactome.org/content/detail/R-1")


def test_pubmedqa_and_delimited(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"11": {"QUESTION": "Why?", "CONTEXTS": ["a", "b"], "LONG_ANSWER": "c", "YEAR": "2010", "final_decision": "yes"}, "12": {"QUESTION": "No answer?", "CONTEXTS": []}}))
    got = {r.external_id: r for r in docs(spark, "pubmedqa", tmp_path / "q.json")}
    assert got["11"].text == "## Question\n\nWhy?\n\n## Evidence\n\na\n\nb\n\n## Answer\n\nc" and got["12"].text == "## Question\n\nNo answer?\n\n## Evidence\n\n"
    (tmp_path / "t.csv").write_text("a,b\n1,\n,\n2,x\n")
    assert sorted(r.text for r in docs(spark, "csv_txt", tmp_path / "t.csv")) == ["a: 1", "a: 2\nb: x"]
    (tmp_path / "t.txt").write_text("whole file")
    (r,) = docs(spark, "csv_txt", tmp_path / "t.txt")
    assert (r.title, r.text) == ("t", "whole file")
    with pytest.raises(ValueError):
        docs(spark, "unheard_of", tmp_path / "t.txt")


def test_pubmed_citations(spark, tmp_path):
    x = '<S><PubmedArticle><MedlineCitation><PMID>5</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>1999 Jan</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText>y</AbstractText></Abstract><Language>eng</Language></Article><MeshHeadingList><MeshHeading><DescriptorName UI="D9" MajorTopicYN="Y">M</DescriptorName></MeshHeading></MeshHeadingList><KeywordList><Keyword>b</Keyword><Keyword>a</Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10/z</ArticleId></ArticleIdList></PubmedData></PubmedArticle></S>'
    (tmp_path / "p.xml.gz").write_bytes(gzip.compress(x.encode()))
    r = parsers.pubmed_citations(spark, [str(tmp_path / "p.xml.gz")]).first()
    assert (r.pmid, r.abstract, r.year, r.doi, r.keywords) == ("5", "AIM: x\ny", "1999 Jan", "10/z", ["a", "b"]) and r.mesh[0].major


def test_pdf_pages_in_units(spark):
    pages = spark.createDataFrame([("/d/b.pdf", "Book", k, "" if k == 2 else f"page {k}") for k in range(1, 28)], "path string, title string, page int, text string")
    got = sorted(parsers.pdf_pages(pages, SOURCE).collect(), key=lambda r: r.section)
    assert [r.section for r in got] == ["Pages 1-25", "Pages 26-27"] and got[0].text.startswith("## Pages 1-25\n\npage 1\n\npage 3")


def test_links(spark):
    html = '<a href="/x#f" title="T"> a <b>b</b><img alt="pic"></a><a href="mailto:q">m</a><a href="y">y</a>'
    got = parsers.links_of(spark.createDataFrame([("https://h.org/d/", html), ("https://n", None)], "url string, html string")).collect()
    assert [(r.target, r.title) for r in got] == [("https://h.org/x", "T a b pic"), ("https://h.org/d/y", "y")]


def test_discovery_and_registry(spark, tmp_path):
    root = tmp_path / "raw"
    for name in ("lit/a.xml", "lit/b.xml.part", "lit/deep/c.xml", "kb/d.obo"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    reg = tmp_path / "s.toml"
    reg.write_text('[[sources]]\nid="one"\nparser="jats_xml"\npriority=2\npatterns=["lit/*.xml"]\n[[sources]]\nid="two"\nparser="obo"\npriority=1\npatterns=["kb/*.obo","lit/**/*.xml"]\n')
    sources = files.load_sources(spark, str(reg))
    got = {r.relative: r.source_id for r in files.discover(spark, str(root), sources).collect()}
    assert got == {"lit/a.xml": "two", "lit/deep/c.xml": "two", "kb/d.obo": "two"}
    total = files.inventory(files.discover(spark, str(root), sources)).where("source_id is null").first()
    assert (total.files, total.bytes) == (3, 3)
    assert files.select_sources(sources, ["one"]).count() == 1
    with pytest.raises(ValueError):
        files.select_sources(sources, ["three"])
    reg.write_text('[pipeline]\nmin_document_chars = 7\nchunk_target_tokens = 99\n[[sources]]\nid="a"\nparser="pdf"\nparagraph_dedup=false\ncompression_level=1\npage_size=3\n')
    (r,) = files.load_sources(spark, str(reg)).collect()
    assert (r.paragraph_dedup, r.compression_level, r.trusted_unique, r.extra) == (False, 1, False, '{"page_size": 3}')
    assert Settings.of(files.load_settings(str(reg))) == Settings(min_document_chars=7, target=99)
    assert files.artifacts(spark, str(root)).orderBy("stage").collect() == [("kb", 1, 1), ("lit", 3, 3)]
    assert files.load_env("# x\nexport A='1 2'\nB = \"c=d\"\n\nno\n=x") == {"A": "1 2", "B": "c=d"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "é", None) for i in range(10)], "i int, t string, n string")
    sinks.jsonl(df.coalesce(1), str(tmp_path / "j"), rows_a_file=4)
    parts = list((tmp_path / "j").glob("*.json.gz"))
    assert len(parts) == 3 and spark.read.json(str(tmp_path / "j")).count() == 10 and "n" not in gzip.decompress(parts[0].read_bytes()).decode()
    sized = spark.createDataFrame([(i, 30) for i in range(10)], "i int, bytes long")
    assert sinks.size_capped(sized, "bytes", "i", 100).groupBy("bundle").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] == 90
    assert sinks.size_capped(spark.createDataFrame([(1, 10), (2, 300), (3, 10)], "i int, bytes long").coalesce(1), "bytes", "i", 100).select("bundle").distinct().count() == 3
    names = spark.createDataFrame([("a/b.txt",), ("../x.txt",), ("/etc/y.txt",), ("C:/z.txt",), ("p.exe",)], "name string")
    assert [r.name for r in sinks.safe_members(names).collect()] == ["a/b.txt"]


def test_magic(spark):
    df = spark.createDataFrame([(bytearray(b"\x1f\x8b\x08"),), (bytearray(b"%PDF-1.4"),), (bytearray(b""),), (bytearray(b"PK\x03\x04"),), (bytearray(b"x"),)], "c binary")
    assert [r[0] for r in df.select(files.magic(F.col("c"))).collect()] == ["gzip", "pdf", "empty", "zip", "other"]


def test_records_of_large_and_prefixed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?><S>" + "".join(f"<P>{i}</P>\n" for i in range(3000)) + "<!-- end --></S>")
    (tmp_path / "b.xml").write_text('<x:S xmlns:x="u"><x:P a="1">7</x:P><x:P>8</x:P></x:S>')
    (tmp_path / "c.xml").write_text("<other>9</other>")
    found = lambda name, **how: sorted(r.xml for r in parsers._xml_records(spark, [str(tmp_path / name)], "P", **how).collect())
    assert found("a.xml") == sorted(f"<P>{i}</P>" for i in range(3000))
    assert found("b.xml") == ['<x:P a="1">7</x:P>', "<x:P>8</x:P>"]
    assert found("c.xml") == ["<other>9</other>"] and found("c.xml", whole=False) == []


def test_pdf_by_a_reader_handed_over(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-" + b"|".join(b"page %d" % i for i in range(1, 31)))
    rows = parsers.pdf(spark, [str(tmp_path / "a.pdf")], SOURCE, lambda raw: [x.decode() if i != 2 else " " for i, x in enumerate(raw[5:].split(b"|"))]).collect()
    got = {r.section: r for r in rows}
    assert set(got) == {"Pages 1-25", "Pages 26-30"} and got["Pages 26-30"].text.endswith("page 30") and "page 3\n" not in got["Pages 1-25"].text
    assert got["Pages 1-25"].title == "a" and json.loads(got["Pages 26-30"].metadata)["page_count"] == 30


def test_archives_vectors_and_checks(spark, tmp_path):
    import numpy as np

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "one")
        z.writestr("two.exe", "two")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name, body in (("d/r.jsonl.gz", gzip.compress(b'{"a": 1}\n\n{"a": 2}')), ("../r.jsonl", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    both = [str(tmp_path / "a.zip"), str(tmp_path / "b.tar.gz")]
    assert sorted(r.name for r in archives.text_members(spark, both).collect()) == ["d/r.jsonl.gz", "x/one.txt"]
    assert [(r.line_no, r.value) for r in archives.json_rows(spark, both[1:], "r.jsonl").collect()] == [(1, '{"a": 1}'), (3, '{"a": 2}')]
    with pytest.raises(ValueError):
        archives.json_rows(spark, both, "r.jsonl")
    checks = {r.path.rsplit("/", 1)[-1]: r.verdict for r in archives.checked(spark.read.format("binaryFile").load(both).select("path", "content")).collect()}
    assert checks == {"a.zip": "ok", "b.tar.gz": "unsafe member: ../r.jsonl"}
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float16).reshape(3, 2))
    assert [(r.at, r.embedding) for r in archives.vector_shards(spark, [str(tmp_path / "v.npy")]).orderBy("at").collect()] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]


def test_import_refuses_gaps_and_changes(spark):
    shards = spark.createDataFrame([("s", "x", 3)], "shard string, signature string, records long")
    vectors = spark.createDataFrame([("j", 0, [0.0]), ("j", 1, [1.0]), ("j", 2, [2.0])], "job string, at long, embedding array<double>")
    kind = "job string, shard string, original_start long, count long, output_offset long, signature string"
    good = [("j", "s", 0, 2, 1, "x"), ("j", "s", 2, 1, 0, "x")]
    got = sinks.imported(spark.createDataFrame(good, kind), vectors, shards).orderBy("position").collect()
    assert [(r.position, r.embedding) for r in got] == [(0, [1.0]), (1, [2.0]), (2, [0.0])]
    for bad, why in (([good[0]], "count"), ([good[0], ("j", "s", 1, 1, 0, "x")], "gap"), ([good[0], ("j", "s", 2, 1, 0, "y")], "changed"), ([("j", "t", 0, 1, 0, "x")], "missing")):
        with pytest.raises(ValueError, match=why):
            sinks.imported(spark.createDataFrame(bad, kind), vectors, shards)
