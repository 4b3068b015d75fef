import math
import random
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, cleaning, dedup, ledger, planning, retrieval


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


# ------------------------------------------------------------ text functions


@pytest.mark.parametrize("raw, want", [("1.5GB", 1_500_000_000), ("2 KiB", 2048), ("7", 7), ("10mb", 10_000_000), ("x", None), ("", None), ("5 quux", None)])
def test_byte_count(spark, raw, want):
    assert one(spark, tx.byte_count(F.col("v")), v=raw) == want


def test_checksum_lines(spark):
    line = tx.checksum_line(F.col("v"))
    got = one(spark, line, v=f"{'A' * 32} *folder/file.tar.gz ")
    assert (got.name, got.algorithm, got.digest) == ("file.tar.gz", "md5", "a" * 32)
    assert one(spark, line, v=f"{'b' * 64}  f").algorithm == "sha256"
    assert one(spark, line, v="no checksum here") is None


def test_repair_and_squeeze(spark):
    assert one(spark, tx.repair(F.col("v")), v="cafÃ© &amp; ﬁne") == "café & fine"
    assert one(spark, tx.squeeze(F.col("v")), v=" a\t b \r\n\r\n\n\n c\x07d ") == "a b\n\nc d"
    assert one(spark, tx.fingerprint_text(F.col("v")), v="  Straße\n ＡＢ ") == "strasse ab"


def test_terms(spark):
    assert one(spark, tx.query_terms(F.col("v")), v="p53-mediated p53-mediated A the_x é9") == ["p53-mediated", "the_x"]
    assert one(spark, tx.index_terms(F.col("v")), v="Crème brûlée, P53-mediated") == ["creme", "brulee", "p53", "mediated"]


def test_licences_markup_and_addresses(spark):
    df = spark.createDataFrame([(["https://creativecommons.org/licenses/by-nc-sa/4.0/", "https://creativecommons.org/licenses/BY/3.0", "https://creativecommons.org/publicdomain/zero/1.0", "https://x.org"],)], "l array<string>")
    assert df.select(tx.cc_licenses(F.col("l"))).first()[0] == ["CC BY", "CC BY-NC-SA", "CC0"]
    assert one(spark, tx.plain_markup(F.col("v")), v="<p>A&nbsp;<b>b</b><script>x<y</script> c</p>") == "A b c"
    got = one(spark, tx.https_of_s3(F.col("v")), v="s3://bucket/a/b.xml?md5=ab12")
    assert (got.url, got.md5) == ("https://bucket.s3.amazonaws.com/a/b.xml", "ab12")


# ------------------------------------------------------------ cleaning


def test_tails_start_and_end(spark):
    text = "Intro\nReferences\n[1] x\n### still\n## Next\nbody\nhttps://a.b/c\nContents\n## See also\nlink"
    got = cleaning.clean(spark.createDataFrame([("d", text), ("n", None)], "document_id string, text string")).collect()
    assert {r.document_id: r.text for r in got} == {"d": "Intro\n## Next\nbody", "n": None}


# ------------------------------------------------------------ deduplication


def test_first_wins_and_paragraphs(spark):
    long = "p" * 200
    rows = [("s", 1, "a", f"{long}\n\nshort\n\n{long}"), ("s", 2, "b", f"short\n \n{long.upper()}\n\nown {long}"), ("t", 3, "c", long), ("t", 4, "e", ""), ("t", 5, "n", None)]
    df = spark.createDataFrame(rows, "source_id string, seq int, document_id string, text string")
    got = {r.document_id: (r.text, r.removed) for r in dedup.paragraph_dedup(df.where("text is not null"), ["seq"]).collect()}
    assert got["a"] == (f"{long}\n\nshort", 1) and got["b"] == (f"short\n\nown {long}", 1) and got["c"] == (long, 0)
    assert [r.document_id for r in dedup.first_wins(df, ["source_id"], "seq").orderBy("seq").collect()] == ["a", "c"]


def test_fingerprints_ignore_an_inputs_own_rows(spark):
    seen = spark.createDataFrame([("k", "d1", "in1"), ("k", "d2", "in1")], "kind string, digest string, owner string")
    rows = spark.createDataFrame([("d1", "in1"), ("d2", "in2"), ("d3", "in2"), ("d3", "in3")], "digest string, owner string")
    fresh = dedup.unseen(rows, seen, F.lit("k"), F.col("digest"), "owner")
    assert sorted(map(tuple, fresh.collect())) == [("d1", "in1"), ("d3", "in2"), ("d3", "in3")]
    after = dedup.remembered(seen, fresh, F.lit("k"), F.col("digest"), "owner")
    assert sorted((r.digest, r.owner) for r in after.collect()) == [("d1", "in1"), ("d2", "in1"), ("d3", "in2")]


# ------------------------------------------------------------ chunking


def loop(n, budget, minimum, overlap):
    """Windows one after the other."""
    step, start, out = max(1, budget - overlap), 0, []
    while True:
        end = min(start + budget, n)
        out.append((start, end))
        if end >= n:
            return out
        start = start + step if n - (start + step) >= minimum else max(start + 1, n - budget)


def test_windows_equal_the_loop(spark):
    cases = [(n, b, m, o) for n in (0, 1, 5, 9, 10, 11, 23, 57, 100, 101, 334) for b in (1, 3, 10, 40, 120) for m, o in ((4, 2), (20, 6), (1, 0))]
    for m, o in ((4, 2), (20, 6), (1, 0)):
        some = [(n, b) for n, b, mm, oo in cases if (mm, oo) == (m, o)]
        df = spark.createDataFrame(some, "n int, b int").select("n", "b", chunking.windows(F.col("n"), F.col("b"), m, o).alias("w"))
        for r in df.collect():
            assert [tuple(x) for x in r.w] == loop(r.n, r.b, m, o), (r.n, r.b, m, o)


def test_sections(spark):
    rows = [("a", "lead\n## One\nbody\n##\nTwo\n\nmore\n### deep\n## Empty\n\n## Last\r\nend"), ("b", "no heading"), ("c", "")]
    got = {}
    for r in chunking.sections(spark.createDataFrame(rows, "document_id string, text string")).orderBy("section_no").collect():
        got.setdefault(r.document_id, []).append((r.section, r.body))
    assert got == {"a": [(None, "lead"), ("One", "body"), ("Two", "more\n### deep"), ("Last", "end")], "b": [(None, "no heading")], "c": [(None, "")]}


def test_chunks_carry_prefix_and_keep_white_space(spark):
    text = "## Title\n" + "a  b\n" * 30
    df = spark.createDataFrame([("d", "title", text, None)], "document_id string, title string, text string, section string")
    got = chunking.chunk(df, 5, 20, 25, 4).orderBy("ordinal").collect()
    assert got[0].text.startswith("title\n\na  b\na  b") and len(got) == len(loop(60, 19, 5, 4))
    assert all(r.token_count <= 20 and r.chunk_id.startswith("chunk:") and len(r.chunk_id) == 30 for r in got)
    with pytest.raises(ValueError):
        chunking.chunk(df, 5, 20, 10, 4)


def test_tokens_of_a_batch_are_held_as_numbers(spark):
    """10,000 rows of 700 tokens are one batch of Arrow; with an object a token it took over a GB."""
    import resource

    peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
    tokenizer = chunking.Tokenizer(spans=lambda text: [(2 * i, 2 * i + 1) for i in range(len(text) // 2)] if text != "peak" else [(0, peak())])
    first = spark.range(0, 10_000, 1, 1).select(F.array(F.when(F.col("id") < 9_999, F.repeat(F.lit("ab"), 700)).otherwise("peak")).alias("t"))
    got = first.select(tokenizer.offsets(F.col("t"))[0].alias("o")).select(F.size("o").alias("n"), F.element_at("o", -1)["end"].alias("end"))
    n, held = got.agg(F.sum("n"), F.max(F.when(F.col("n") == 1, F.col("end")))).first()
    assert n == 700 * 9_999 + 1 and held < 900  # the last text asks for the worker's memory, in MB


def test_tokenizer_of_nulls_and_empty_texts(spark):
    rows = spark.createDataFrame([(0, None), (1, []), (2, ["", "ab c"])], "k int, t array<string>")
    t = chunking.Tokenizer(spans=lambda x: [(i, i + 1) for i in range(len(x)) if x[i] != " "], encode=lambda x: [ord(c) for c in x], decode=lambda ids: "".join(map(chr, ids)))
    got = {r.k: r for r in rows.select("k", t.counts(F.col("t")).alias("n"), t.offsets(F.col("t")).alias("o"), t.ids(F.col("t")).alias("i"), t.texts(t.ids(F.col("t"))).alias("back")).collect()}
    assert got[0][1:] == (None, None, None, None) and got[1][1:] == ([], [], [], [])
    assert got[2].n == [0, 3] and [[tuple(p) for p in x] for x in got[2].o] == [[], [(0, 1), (1, 2), (3, 4)]] and got[2].i == [[], [97, 98, 32, 99]] and got[2].back == ["", "ab c"]


# ------------------------------------------------------------ retrieval

TEXTS = {"c1": "p53 mediated repair of dna", "c2": "dna and more dna in the cell", "c3": "mediated by p53 in cells", "c4": "unrelated words only", "c5": ""}


def corpus(spark):
    return spark.createDataFrame([(k, "t", None, v) for k, v in TEXTS.items()], "chunk_id string, title string, section string, text string")


def test_bm25_and_phrases(spark):
    chunks = corpus(spark)
    asked = spark.createDataFrame([("q1", "dna"), ("q2", "p53-mediated"), ("q3", "?"), ("q4", "absent")], "query_id string, query string")
    got = retrieval.bm25(asked, retrieval.postings(chunks), retrieval.lengths(chunks)).orderBy("query_id", "sparse_rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [("q1", "c2"), ("q1", "c1"), ("q2", "c1")]
    lengths = {k: 1 + len(v.split()) for k, v in TEXTS.items()}
    idf = math.log((5 - 2 + 0.5) / 2.5)
    want = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * lengths["c2"] / (sum(lengths.values()) / 5)))
    assert got[0].score == pytest.approx(want, abs=1e-6)


def test_bm25_over_moves_no_row_for_each_hit(spark, monkeypatch):
    rng = random.Random(3)
    names = ["p53", "DNA", "dm-34", "cell", "x", "Mediated_by", "dm", "34"]
    rows = [(f"c{i:03}", k, "t", None, " ".join(rng.choices(["p53", "dna", "dm-34", "cell", "mediated by", "the", "34", "dm"], k=rng.randint(0, 9)))) for i in range(300) for k in range(1 + (i % 5 == 0))]
    chunks = spark.createDataFrame(rows, "chunk_id string, written_at int, title string, section string, text string")
    asked = spark.createDataFrame([(f"q{i % 23:02}", " ".join(rng.choices(names, k=3))) for i in range(25)] + [("none", None), ("absent", "zebra")], "query_id string, query string")
    latest = ledger.last_wins(chunks, ["chunk_id"], "written_at")
    terms = asked.select("query_id", F.explode(F.regexp_extract_all("query", F.lit("[A-Za-z0-9][A-Za-z0-9_-]{1,}"), F.lit(0))).alias("t")).distinct().groupBy("query_id").agg(F.concat_ws(" ", F.collect_list("t")).alias("query"))
    want = retrieval.bm25(terms, retrieval.postings(latest), retrieval.lengths(latest), 7)  # by way of a row a hit
    order = ["query_id", "sparse_rank", "chunk_id", "score"]
    want = sorted(map(tuple, want.select(*order).collect()))

    def no_hits(*_, **__):
        raise AssertionError("a row a query, term and chunk grows with queries times chunks")

    monkeypatch.setattr(retrieval, "hits", no_hits)
    for block in (5, 4096):
        got = sorted(map(tuple, retrieval.bm25_over(asked, chunks, 7, last_by="written_at", block=block).select(*order).collect()))
        assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)


def test_dense_in_blocks_and_fusion(spark):
    rng = random.Random(1)
    v = [(f"c{i:02}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(40)]
    vectors = spark.createDataFrame(v, "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(f"q{i}", v[i][1]) for i in range(7)], "query_id string, embedding array<float>")
    got = retrieval.dense(asked, vectors, limit=5, block=3)
    assert {r.query_id: r.chunk_id for r in got.where("dense_rank = 1").collect()} == {f"q{i}": f"c{i:02}" for i in range(7)}
    assert got.count() == 35
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, chunk_id string, dense_rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, chunk_id string, sparse_rank int")
    fused = retrieval.fuse(a, b).orderBy("rank").collect()
    assert [r.chunk_id for r in fused] == ["y", "x", "z"] and fused[0].rrf_score == pytest.approx(1 / 62 + 1 / 61)


def test_legs_keep_rows_in_few_tasks_and_no_tables_of_blocks(spark, monkeypatch):
    rng = random.Random(5)
    v = [(f"c{i:03}", i, "t", None, " ".join(rng.choices("abcdefgh", k=9)).replace("a", "dna").replace("b", "rna"), [rng.gauss(0, 1) for _ in range(8)]) for i in range(240)]
    rows = spark.createDataFrame(v, "chunk_id string, written_at int, title string, section string, text string, embedding array<float>")
    asked = spark.createDataFrame([(f"q{i}", ["dna", "rna", "dna rna"][i % 3], v[i][5]) for i in range(7)], "query_id string, query string, embedding array<float>")
    legs = [lambda rows, **how: retrieval.dense(asked, rows, 5, **how), lambda rows, **how: retrieval.bm25_over(asked, rows, 5, last_by="written_at", **how)]
    want = [sorted(map(tuple, leg(rows).collect())) for leg in legs]
    tasks, shared = [], Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    old = set(shared.glob("table-*"))
    monkeypatch.setattr(retrieval, "SLICES", 2, raising=False)
    monkeypatch.setattr(retrieval, "written", lambda df, f=retrieval.written: f(df.repartition(24)))
    monkeypatch.setattr(retrieval, "top", lambda df, *how, f=retrieval.top: tasks.append(df.rdd.getNumPartitions()) or f(df, *how))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task a file
    try:
        got = [sorted(map(tuple, leg(rows.repartition(12), block=2).collect())) for leg in legs]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want
    assert max(tasks) <= spark.sparkContext.defaultParallelism == 4  # however many rows, what is shuffled grows with the queries alone
    assert len(set(shared.glob("table-*")) - old) == 4 + 2  # the results of the blocks alone


def test_quantizer_round_trip(spark):
    v = spark.createDataFrame([("a", [0.0, 5.0]), ("b", [1.0, 5.0]), ("c", [0.5, 5.0])], "chunk_id string, embedding array<float>")
    ranges = retrieval.quantizer(v)
    codes = retrieval.encode_sq8(v, ranges)
    back = {r.chunk_id: r.embedding for r in retrieval.decode_sq8(codes, ranges).collect()}
    assert {r.chunk_id: r.codes for r in codes.collect()} == {"a": [0, 0], "b": [255, 0], "c": [127, 0]}
    assert back["c"][0] == pytest.approx(0.5, abs=1 / 255) and back["a"][1] == 5.0


# ------------------------------------------------------------ ledger and planning


def test_upsert_resume_and_gaps(spark):
    cols = "k string, url string, bytes long, status string"
    old = spark.createDataFrame([("a", "u1", 5, "complete"), ("b", "u2", None, "planned")], cols)
    new = spark.createDataFrame([("a", "u9", None, "planned"), ("c", "u3", 7, "planned")], cols)
    got = {r.k: (r.url, r.bytes, r.status) for r in ledger.upsert(old, new, ["k"], ["url"], ["bytes"], ["status"]).collect()}
    assert got == {"a": ("u9", 5, "complete"), "b": ("u2", None, "planned"), "c": ("u3", 7, "planned")}
    done = spark.createDataFrame([("a", "s"), ("b", "s")], "k string, signature string")
    now = spark.createDataFrame([("a", "s"), ("b", "t"), ("c", "s")], "k string, signature string")
    assert {r.k: r.action for r in ledger.resume(now, done, ["k"]).collect()} == {"a": "skip", "b": "changed", "c": "process"}
    parts = spark.createDataFrame([("x", 0, 3), ("x", 3, 2), ("x", 6, 1), ("y", 0, 1)], "k string, start int, count int")
    assert [(r.k, r.start, r.expected) for r in ledger.gaps(parts, "k", "start", "count").collect()] == [("x", 6, 5)]


def test_packing_batches_and_dates(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([2, 2, 1, 4, 3])], "s string, i int, n long")
    assert [r.job for r in planning.next_fit(df, ["s"], ["i"], "n", 3).orderBy("i").collect()] == [0, 1, 1, 2, 3]
    assert [r["items"] for r in planning.batches(df, ["s"], ["i"], 2, "n").orderBy("batch").collect()] == [[2, 2], [1, 4], [3]]
    assert [(r.original_start, r.rows) for r in planning.segments(df, ["s"], ["i"], 3).orderBy("segment").collect()] == [(0, 3), (3, 2)]
    w = planning.date_windows(spark, date(2024, 12, 25), date(2025, 1, 3)).orderBy("start").collect()
    assert [(r.start, r.end) for r in w] == [(date(2024, 12, 25), date(2024, 12, 31)), (date(2025, 1, 1), date(2025, 1, 3))]
    with pytest.raises(ValueError):
        planning.date_windows(spark, date(2025, 1, 2), date(2025, 1, 1))


def test_numbering_and_even_sample(spark):
    df = spark.createDataFrame([(i,) for i in random.Random(1).sample(range(1000), 300)], "i int")
    numbered = planning.numbered(df, ["i"], "n").orderBy("i").collect()
    assert [r.n for r in numbered] == list(range(1, 301))
    order = [r.i for r in numbered]
    got = sorted(r.i for r in planning.even_sample(df, ["i"], 7).collect())
    assert got == [order[int(k * 299 / 6)] for k in range(7)]
    assert planning.even_sample(df, ["i"], 500).count() == 300


def test_breadth_first_links(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "source string, target string")
    got = planning.reachable(links, spark.createDataFrame([("a",)], "url string"), 3)
    assert {r.url: r.depth for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_enrich_from_the_last_row_of_a_file(spark):
    m = "local_path string, url string, metadata string, status string, sha256 string, actual_bytes long, error string, updated_at timestamp"
    rows = [("f", "u1", '{"license_id": "CC0", "license_state": "ok"}', "complete", "ab", 5, "normalized to g", None), ("h", "u2", "{}", "failed", None, None, None, None)]
    manifest = spark.createDataFrame(rows, m).withColumn("updated_at", F.lit("2025-01-01").cast("timestamp"))
    docs = spark.createDataFrame([("1", "f", None, "L"), ("2", "g", "own", None), ("3", "h", None, "L"), ("4", "x", None, None)], "document_id string, source_path string, url string, license_id string")
    got = {r.document_id: (r.url, r.license_id, r.acquisition) for r in ledger.enrich(docs, manifest).collect()}
    full = '{"status":"complete","sha256":"ab","bytes":5,"license_state":"ok"}'
    assert got == {"1": ("u1", "CC0", full), "2": ("own", "CC0", full), "3": ("u2", "L", '{"status":"failed"}'), "4": (None, None, None)}
