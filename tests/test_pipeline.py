import json

import pytest
from pyspark.sql import functions as F

from corpusloom.__main__ import main
from corpusloom.plans.pipeline import Pipeline, Settings
from corpusloom.streaming import runs

EVENTS = [("r1", 1, "trace", "a", "p1"), ("r1", 2, "delta", None, "He"), ("r1", 3, "trace", "b", "p2"), ("r1", 4, "trace", "a", "p3"), ("r1", 5, "delta", None, "y"), ("r2", 1, "delta", None, "x"), ("r2", 2, "completed", None, "Done"), ("r3", 1, "failed", None, "boom")]
WANT = {"r1": (["b", "a"], ["p2", "p3"], "Hey", "running", None), "r2": ([], [], "Done", "completed", None), "r3": ([], [], "", "failed", "boom")}


def states(rows):
    return {r.run_id: (list(r.trace_ids), list(r.trace), r.markdown, r.status, r.error) for r in sorted(rows, key=lambda r: r.seq)}


def test_run_states_batch(spark):
    assert states(runs.run_states_batch(spark.createDataFrame(EVENTS, runs.EVENT)).collect()) == WANT


def test_run_states_stream(spark, tmp_path):
    for k, part in enumerate((EVENTS[:3] + EVENTS[5:6], EVENTS[3:5] + EVENTS[6:] + EVENTS[:1])):
        spark.createDataFrame(part, runs.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = runs.run_states(spark.readStream.schema(runs.EVENT).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}"))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert states(spark.read.parquet(str(tmp_path / "out")).collect()) == WANT


def test_incremental_ingest(spark, tmp_path):
    schema = "document_id string, source_id string, text string"
    for rows in ([("1", "s", "a"), ("2", "s", "b"), ("3", "s", "a")], [("4", "s", "b"), ("5", "t", "b"), ("6", "s", "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        runs.ingest_increments(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "fp"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.document_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "5", "6"]


def test_end_to_end(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    para = "The membrane of the cell gates the flow of ions through many channels. " * 4
    rows = [{"pmid": str(i), "title": f"Paper {i}", "abstract": para + f"Finding number {i} concerns the kinase k{i}. " * 8} for i in range(6)]
    rows += [{"pmid": "50", "title": "Paper 0 again", "abstract": rows[0]["abstract"]}, {"pmid": "51", "title": "Tiny", "abstract": "short"}]
    (raw / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (raw / "g.obo").write_text("".join(f"[Term]\nid: GO:{i}\nname: term {i}\ndef: \"{'a process of repair ' * 14}{i}\"\n\n" for i in range(3)))
    (tmp_path / "s.toml").write_text('[[sources]]\nid="pm"\nparser="pubmed_jsonl"\ncategory="literature"\npatterns=["*.jsonl"]\n[[sources]]\nid="go"\nparser="obo"\ncategory="knowledge_base"\ntrusted_unique=true\nstructured_cleaning=true\npatterns=["*.obo"]\n')
    p = Pipeline(spark, str(raw), str(tmp_path / "tables"), str(tmp_path / "s.toml"), Settings(minimum=20, target=60, maximum=80, overlap=10, min_chunk_tokens=8))
    assert p.inventory().where("source_id is null").first().files == 2
    accepted, rejected = p.ingest()
    assert accepted.groupBy("source_id").count().orderBy("source_id").collect() == [("go", 3), ("pm", 6)]
    assert sorted((r.reason, r.source_id) for r in rejected.collect()) == [("duplicate_document", "pm"), ("too_short", "pm")]
    chunks = p.chunk()
    assert chunks.select("chunk_id").distinct().count() == chunks.count() > 9 and chunks.agg(F.max("token_count")).first()[0] <= 80
    assert p.embed().count() == chunks.count()
    p.index()
    hits = p.search(["kinase k3", "process of repair"], top_k=3).orderBy("query_id", "rank").collect()
    assert "k3" in hits[0].text and len(hits) == 6
    assert p.search(["kinase k3"], mode="bm25").where("rank = 1").first().sparse_rank == 1
    assert {r.source_id: r.documents for r in p.status().collect()} == {"go": 3, "pm": 6}
    assert all(r.chunks == r.embedded for r in p.status().collect())
    args = ["--root", str(raw), "--tables", str(tmp_path / "tables"), "--registry", str(tmp_path / "s.toml")]
    main(["search", *args, "--query", "kinase k2", "--source", "pm", "--top-k", "2"], spark)
    main(["run", *args], spark)
    assert {r.source_id: r.documents for r in p.status().collect()} == {"go": 3, "pm": 6}
    assert p.search(["kinase k3"], sources=["go"]).where("source_id <> 'go'").count() == 0


def searchable(spark, tmp_path):
    """A pipeline over 120 chunks of one source and 5 of another, embedded but not indexed."""
    (tmp_path / "s.toml").write_text("".join(f'[[sources]]\nid="{s}"\nparser="pubmed_jsonl"\ncategory="literature"\npatterns=["*.jsonl"]\n' for s in ("big", "small")))
    text = {"big": "kinase", "small": "kinase of a membrane channel gates the flow of ions"}
    rows = [(f"{s}-{i:03}", s, "", "", f"{text[s]} {i}") for s, n in (("big", 120), ("small", 5)) for i in range(n)]
    spark.createDataFrame(rows, "chunk_id string, source_id string, title string, section string, text string").write.parquet(str(tmp_path / "tables/chunks"))
    p = Pipeline(spark, str(tmp_path), str(tmp_path / "tables"), str(tmp_path / "s.toml"))
    p.embed()
    return p


def test_a_small_source_fills_top_k(spark, tmp_path):
    p = searchable(spark, tmp_path)
    p.index()
    for mode in ("bm25", "dense", "hybrid"):
        got = p.search(["kinase"], top_k=3, mode=mode, sources=["small"]).collect()
        assert sorted((r["rank"], r.source_id) for r in got) == [(1, "small"), (2, "small"), (3, "small")]


def test_a_held_out_source_never_comes_back(spark, tmp_path):
    p = searchable(spark, tmp_path)
    p.index(held_out=["small"])
    for mode in ("bm25", "dense", "hybrid"):
        got = p.search(["kinase of a membrane channel"], mode=mode).collect()
        assert (len(got), [r.source_id for r in got if r.source_id == "small"]) == (10, [])
    assert p.search(["kinase of a membrane channel"], sources=["small"]).count() == 0


def test_a_late_event_takes_its_place(spark, tmp_path):
    batches = [[("r", 1, "delta", None, "a"), ("r", 3, "delta", None, "c"), ("r", 5, "trace", "x", "late")], [("r", 2, "delta", None, "b"), ("r", 4, "trace", "x", "early")]]
    for k, part in enumerate(batches):
        spark.createDataFrame(part, runs.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = runs.run_states(spark.readStream.schema(runs.EVENT).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}"))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out")).orderBy("b").collect()[-1]
    assert (last.markdown, list(last.trace), last.seq) == ("abc", ["late"], 5)
    assert runs.needed({1: ("delta", None, "a"), 2: ("completed", None, "z"), 3: ("delta", None, "b")}).keys() == {2, 3}


def made(spark, tmp_path, sources, **contents):
    raw = tmp_path / "raw"
    raw.mkdir(exist_ok=True)
    for name, text in contents.items():
        (raw / name.replace("__", ".")).write_text(text)
    (tmp_path / "s.toml").write_text(sources)
    return Pipeline(spark, str(raw), str(tmp_path / "tables"), str(tmp_path / "s.toml"), Settings(minimum=5, target=30, maximum=40, overlap=4, min_chunk_tokens=1))


PM = '[[sources]]\nid="pm"\nparser="pubmed_jsonl"\ncategory="literature"\npatterns=["*.jsonl"]\n'


def lines(*ids, salt=""):
    return "\n".join(json.dumps({"pmid": i, "title": f"Paper {i}", "abstract": f"The finding {i} {salt} concerns the membrane k{i}. " * 12}) for i in ids)


def test_a_clean_corpus_and_one_with_nothing_to_accept(spark, tmp_path):
    accepted, rejected = made(spark, tmp_path, PM, a__jsonl=lines("1", "2")).ingest()
    assert (accepted.count(), rejected.count()) == (2, 0)
    p = made(spark, tmp_path, PM, a__jsonl=json.dumps({"pmid": "1", "abstract": "short"}))
    accepted, rejected = p.ingest()
    assert (accepted.count(), [r.reason for r in rejected.collect()]) == (0, ["too_short"])
    assert p.chunk().count() == 0


def test_rows_of_one_id_are_cleaned_and_chunked_apart(spark, tmp_path):
    trusted = PM.replace("category", "trusted_unique=true\ncategory")
    p = made(spark, tmp_path, trusted, a__jsonl=lines("1"), b__jsonl=lines("1", salt="other"))
    accepted, _ = p.ingest()
    assert accepted.count() == 2 and accepted.select("document_id").distinct().count() == 1
    assert all(("other" in r.text) != ("finding 1  concerns" in r.text.replace("1 concerns", "1  concerns")) for r in accepted.collect())
    chunks = p.chunk().collect()
    assert len({r.chunk_id for r in chunks}) == len(chunks) and sorted({r.ordinal for r in chunks if "other" in r.text}) == sorted({r.ordinal for r in chunks if "other" not in r.text}) == list(range(1, 1 + len(chunks) // 2))
    assert all(len({x for x in ("other",) if x in r.text}) in (0, 1) for r in chunks)


def test_a_record_that_cant_be_parsed_is_rejected(spark, tmp_path):
    ok = f"<article><front><article-meta><article-title>T</article-title></article-meta></front><body><p>{'A word on the cell. ' * 20}</p></body></article>"
    p = made(spark, tmp_path, '[[sources]]\nid="x"\nparser="jats_xml"\npatterns=["*.xml"]\n', a__xml=f"<set>{ok}<article><p>open</article></set>")
    accepted, rejected = p.ingest()
    assert accepted.count() == 1 and [(r.reason, r.detail.split(":")[0]) for r in rejected.collect()] == [("parse_error", "ParseError")]
    assert [(r.source_id, r.status) for r in p.probe().collect()] in ([("x", "ok")], [("x", "error")])


def test_resume_takes_new_inputs_only(spark, tmp_path):
    p = made(spark, tmp_path, PM, a__jsonl=lines("1", "2"))
    p.ingest(resume=True)
    p = made(spark, tmp_path, PM, b__jsonl=lines("1", "3"))
    accepted, rejected = p.ingest(resume=True)
    assert sorted(r.external_id for r in accepted.collect()) == ["1", "2", "3"]
    assert [(r.reason, r.source_path.rsplit("/", 1)[-1]) for r in rejected.collect()] == [("duplicate_document", "b.jsonl")]
    p.ingest(resume=True)
    assert accepted.count() == 3 and p.compact() == 2
    made(spark, tmp_path, PM, b__jsonl=lines("1", "3", "4"))
    with pytest.raises(ValueError, match="changed"):
        p.ingest(resume=True)
    with pytest.raises(ValueError):
        p.reset()
    p.chunk(delete_documents=True)
    p.embed()
    once = spark.read.parquet(str(tmp_path / "tables/embeddings.complete")).inputFiles()
    p.embed()
    assert spark.read.parquet(str(tmp_path / "tables/embeddings.complete")).inputFiles() == once
    p.index()
    assert spark.read.parquet(str(tmp_path / "tables/codes")).count() == spark.read.parquet(str(tmp_path / "tables/dense_map")).count() == p.status().first().embedded
    assert {r.stage for r in p.artifacts().collect()} >= {"chunks", "codes", "postings", "store"}
    p.reset(yes=True)
    assert not (tmp_path / "tables/chunks").exists() and not (tmp_path / "tables/documents").exists()
