import random
from datetime import datetime

from corpusloom.llm import leakage as L
from corpusloom.llm import reading_level as R
from corpusloom.llm import scans as S
from corpusloom.llm import subjects as J
from corpusloom.session import table


# ------------------------------------------------------------ reading level


def graded(rng, level, n=8):
    words = {"elementary": "cat dog sun big run jump".split(), "high_school": "cell energy tissue respire diffusion plants".split(), "undergraduate": "receptor substrate transcription equilibrium pathway".split(), "graduate": "epistasis haploinsufficiency allele scaffold contested".split(), "professional": "sensorgrams isotherm kcat refolded variant pm2".split()}[level]
    return " ".join(" ".join(rng.choice(words) for _ in range(6)).capitalize() + "." for _ in range(n))


def test_levels_with_foreign_sentences(spark):
    rng = random.Random(1)
    sample = spark.createDataFrame([(graded(rng, k), k) for k in R.LEVELS for _ in range(12)] + [(None, "graduate"), ("text", None), ("text", "odd")], "text string, academic_level string")
    rows, want = [], {}
    for i in range(40):
        k = rng.randrange(5)
        mixed = graded(rng, R.LEVELS[k], 9) + " " + graded(rng, R.LEVELS[max(0, k - 1)], 2)
        rows.append((i, mixed, datetime(2025, 1, 1), "x"))
        want[i] = R.LEVELS[k]
    rows += [(0, rows[0][1], datetime(2025, 2, 1), "x"), (100, "too short", None, "x"), (101, None, None, "x"), (102, "", None, "x"), (103, "zzz " * 100, None, None), (None, rows[1][1], None, None)]
    df = spark.createDataFrame(rows, "record_id long, text string, judged_at timestamp, academic_level string")
    got = {r.record_id: r.academic_level for r in R.read_levels(df, sample).collect()}
    assert got == want | {103: "undergraduate"}
    assert R.read_levels(df.limit(0), sample).count() == 0
    assert {r.academic_level for r in R.read_levels(df, sample.limit(0)).collect()} == {"undergraduate"}


def test_held_out_accuracy_on_the_reviewed_texts(spark, data):
    assert R.fit(table(spark, data, "level_sample"))["held_out"] >= 0.95


# ------------------------------------------------------------ subjects


def test_held_out_accuracy_of_subjects(spark, data):
    sample = table(spark, data, "subject_sample")
    model = J.fit(sample.where("sample_id % 4 <> 1"))
    held = sample.where("sample_id % 4 = 1")
    got = {}
    for r in J.subjects(held, model, "sample_id").collect():
        got.setdefault(r.sample_id, set()).add(r.subject)
    truth = {r.sample_id: set(r.subjects) for r in held.collect()}
    assert sum(got.get(k, set()) == v for k, v in truth.items()) / len(truth) >= 0.9


def test_subjects_of_odd_texts(spark):
    about = {"cats": "the cat and the kitten purr softly at night", "cars": "the engine and the gearbox roar down the road"}
    sample = spark.createDataFrame([(f"{t}. {t}.", [k]) for k, t in about.items() for _ in range(6)] + [(None, ["cats"]), ("x", None), ("y", [])], "text string, subjects array<string>")
    both = ". ".join([about["cats"]] * 3 + [about["cars"]] * 3) + "."
    rows = [(1, both), (2, about["cats"] + "."), (3, None), (4, ""), (5, "12 34 | 56"), (6, "物神膜 " * 20), (7, (about["cars"] + ". ") * 5000), (2, about["cats"] + "."), (8, "purr")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, subject string")
    got = sorted({(r.doc_id, r.subject) for r in J.find_subjects(df, sample).collect()})
    assert got == [(1, "cars"), (1, "cats"), (2, "cats"), (7, "cars")]
    assert J.find_subjects(df.limit(0), sample).count() == 0 and J.find_subjects(df, sample.limit(0)).count() == 0


# ------------------------------------------------------------ leakage

CHUNKS = "chunk_id string, document_id string, ordinal int, title string, section string, text string, written_at timestamp, pmid string"
ITEMS = "pmid string, question string, contexts array<string>, long_answer string"


def passage(rng, n=40):
    return " ".join(f"{rng.choice(['the', 'of', 'and', 'in'])} k{rng.randrange(4000)}" for _ in range(n // 2))


def test_leaks_with_edits_and_across_chunks(spark):
    rng = random.Random(2)
    held = [passage(rng) for _ in range(40)]
    items = spark.createDataFrame([(str(70000000 + i), None if i else "q", [p], None) for i, p in enumerate(held)] + [("1", None, None, None), (None, "x", [], "y"), ("2", "few words", [None], "")], ITEMS)
    rows, want = [], set()

    def add(d, ordinal, text, when=datetime(2025, 1, 1)):
        rows.append((f"{d}-{ordinal}", d, ordinal, "A title", "Part", None if text is None else f"A title\n\nPart\n\n{text}", when, "p"))

    for i in range(12):
        w = held[i].split()
        for k in range(3, len(w), 11):
            w[k] = "changed" if i % 3 == 0 else "" if i % 3 == 1 else w[k] + " added"
        add(f"edited{i}", 1, passage(rng, 30) + " " + "\n".join(" ".join(w).upper().split(" ")) + ", " + passage(rng, 30))
        want.add((f"edited{i}", str(70000000 + i)))
    whole = held[20].split()
    add("cut", 1, passage(rng, 20) + " " + " ".join(whole[:11]))
    add("cut", 2, " ".join(whole[11:22]) + " " + passage(rng, 20))
    add("overlap", 1, passage(rng, 20) + " " + " ".join(whole[:16]))
    add("overlap", 2, " ".join(whole[6:]))
    want |= {("cut", "70000020"), ("overlap", "70000020")}
    add("short", 1, passage(rng, 20) + " " + " ".join(whole[:10]) + " " + passage(rng, 20))
    add("clean", 1, passage(rng, 300))
    add("null", 1, None)
    add("empty", 1, "")
    rows += rows[:3]
    chunks = spark.createDataFrame(rows, CHUNKS)
    got = {(r.document_id, r.pmid) for r in L.by_text(chunks, items).distinct().collect()}
    assert got == want
    assert L.by_text(chunks.limit(0), items).count() == 0 and L.by_text(chunks, items.limit(0)).count() == 0


def test_leaks_in_title_and_section(spark):
    rng = random.Random(6)
    held = [" ".join(passage(rng).split()[:16]) for _ in range(4)]
    items = spark.createDataFrame([(str(i), None, [p], None) for i, p in enumerate(held)], ITEMS)
    half = held[2].split()
    heads = {"title": (held[0], "Part", ""), "section": ("A title", held[1], ""), "across": (" ".join(half[:6]), " ".join(half[6:9]), " ".join(half[9:])), "absent": ("A title", "Part", "")}
    rows = [(f"{d}-{k}", d, k, t, s, f"{t}\n\n{s}\n\n{body if k == 1 else ''} {passage(rng, 100)}", datetime(2025, 1, 1), "p") for d, (t, s, body) in heads.items() for k in (0, 1)]
    rows.append(("unsaid-0", "unsaid", 0, held[3], "Part", passage(rng, 100), datetime(2025, 1, 1), "p"))  # a title that isn't in the text
    got = {(r.document_id, r.pmid) for r in L.by_text(spark.createDataFrame(rows, CHUNKS), items).distinct().collect()}
    assert got == {("title", "0"), ("section", "1"), ("across", "2")}


def test_search_equals_plain_comparison():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    text = [rng.choice(words) for _ in range(3000)]
    p = L.Patterns([("1", " ".join(text[k : k + 20])) for k in (10, 500, 1200)] + [("2", " ".join(rng.choice(words) for _ in range(40))), ("3", "short")])
    ids = L.np.array([p.id.get(w, -1) for w in text])
    pos, pattern = p.search(ids)
    runs = {tuple(p.run[:, f].tolist()): k for k, f in enumerate(p.first)}
    want = {(i, runs[t]) for i in range(len(ids) - L.RUN + 1) if (t := tuple(ids[i : i + L.RUN].tolist())) in runs}
    assert set(zip(pos.tolist(), pattern.tolist())) == want
    empty = L.Patterns([("1", "too short")])
    assert all(len(x) == 0 for x in empty.leaks([text]))


def test_external_ids(spark):
    items = spark.createDataFrame([("7001234", "q", [], None)], ITEMS)
    spelled = ["7001234", " 7001234 ", "PMID:7001234", "pmid 7001234", "PubMed: 7001234", "7001234.1.xml", "https://pubmed.ncbi.nlm.nih.gov/7001234/"]
    other = ["PMC7001234", "GO:7001234", "R-BIO-7001234", "7001235", "", None, "D7001234", "x7001234"]
    df = spark.createDataFrame([(f"d{i}", e) for i, e in enumerate(spelled + other)], "document_id string, external_id string")
    assert {r.document_id for r in L.by_external_id(df, items).collect()} == {f"d{i}" for i in range(len(spelled))}


# ------------------------------------------------------------ scans

DOCS = "document_id string, title string, text string, parser string, ingested_at timestamp, word string, n long"
BODY = ["The membrane of the muscle cell depends on the nerve and on the", "dose-dependent signal of the nerve and of the muscle in every", "record of the membrane and of the cell that we have measured so", "far in the membrane of the nerve and of the muscle and the cell."]


def pages(*breaks):
    """Body pages with the given lines between them."""
    out = ["## Pages 1-3", "", *BODY]
    for b in breaks:
        out += ["", *b, *BODY]
    return "\n".join(out)


def run(spark, rows):
    clean = [(f"c{i}", "t", " ".join(BODY) + " Signals of the membrane depend on time-lapse and dose-dependent records.", "obo", None, "w", 1) for i in range(30)]
    return spark.createDataFrame([(d, t, x, p, None, "w", 1) for d, t, x, p in rows] + clean, DOCS)


def test_heads_numbers_cuts_and_misreadings(spark):
    text = pages(["- 12 -", "Muscle and Nerve, vol. 3"], ["- 13 -", "Muscle and Ncrve, vol. 3"]).split("\n")
    text[2] = "The mernbrane of the muscle cell depends on the nerve and on the mem-"
    text[3] = "brane and the dose-"
    text[4] = "dependent signal of the rnuscle in every record of the nerve and the cell"
    df = run(spark, [("d", "Muscle and Nerve", "\n".join(text), "pdf"), ("o", "x", "5\nThe membrane", "obo"), ("n", None, None, "pdf"), ("e", "t", "", "pdf"), (None, "t", "7", "pdf")])
    got = {(r.document_id, r.line_no, r.defect) for r in S.defects(df).collect()}
    at = {line: i for i, line in enumerate(text, 1)}
    want = {("d", at["- 12 -"], "page_number"), ("d", at["- 13 -"], "page_number"), ("d", at["Muscle and Nerve, vol. 3"], "running_head"), ("d", at["Muscle and Ncrve, vol. 3"], "running_head"), ("d", 3, "split_word"), ("d", 3, "misread"), ("d", 5, "misread")}
    assert got == want
    first = sorted(((r.paragraph_no, r.text) for r in S.reflow(df).where("document_id = 'd'").collect()))[0][1]
    assert first.startswith("The membrane of the muscle cell depends on the nerve and on the membrane and the dose-dependent signal of the muscle in every record")


def test_many_doubtful_words_are_joined(spark, monkeypatch):
    text = "\n".join(["## Pages 1-3", "", "The mernbrane of the muscle cell depends on the nerve and on the", "signal of the rnuscle in every record of the nerve and the cell", "zq" * 40])
    df = run(spark, [("d", "t", text, "pdf")])
    want = {("d", 3, "misread"), ("d", 4, "misread")}
    for rows in (100_000, 0):
        monkeypatch.setattr(S, "SMALL_ROWS", rows)
        assert {(r.document_id, r.line_no, r.defect) for r in S.defects(df).collect()} == want


def test_section_heads_recur_over_texts(spark):
    rows = [(f"d{i}", f"Title {i}x", pages([f"Overview | {i}"], [f"{i + 1}   OVERVIEW"]), "pdf") for i in range(4)]
    got = {(r.document_id, r.line_no) for r in S.defects(run(spark, rows)).collect() if r.defect == "running_head"}
    assert got == {(f"d{i}", n) for i in range(4) for n in (8, 14)}


def test_no_scans_no_defects(spark):
    df = run(spark, [("o", "x", "5\nThe mernbrane", "obo")])
    assert S.defects(df).count() == 0 and S.defects(df.limit(0)).count() == 0 and S.reflow(df.limit(0)).count() == 0


def chunked(spark, texts, d="d"):
    return spark.createDataFrame([(f"{d}-{i}", d, i, "t", None, t, None, None) for i, t in texts], CHUNKS)


def test_a_long_document_is_read_over_its_tasks(spark):
    rng = random.Random(5)
    held = passage(rng)
    w = held.split()
    texts = [[i, passage(rng, 12)] for i in range(1, 400)]
    for k in range(20, 380, 7):  # so that some are cut by the border of a task
        texts[k][1] = passage(rng, 10) + " " + " ".join(w[:12])
        texts[k + 1][1] = " ".join(w[12:24]) + " " + passage(rng, 10)
    items = spark.createDataFrame([("9", held, None, None)], ITEMS)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert [tuple(r) for r in L.by_text(chunked(spark, texts), items).distinct().collect()] == [("d", "9")]
        lone = [(i, x) for i, x in enumerate(w[:20] + passage(rng, 60).split())]  # a word a chunk, two chunks a task
        assert [tuple(r) for r in L.by_text(chunked(spark, lone), items).distinct().collect()] == [("d", "9")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_passage_over_gaps_and_over_many_small_chunks(spark):
    rng = random.Random(7)
    held = [passage(rng) for _ in range(4)]
    w = [h.split() for h in held]
    texts = {
        "gap": [(62, passage(rng, 20) + " " + " ".join(w[0][:12])), (64, " ".join(w[0][12:24]) + " " + passage(rng, 20))],
        "three": [(1, passage(rng, 20) + " " + " ".join(w[1][:6])), (2, " ".join(w[1][6:12])), (900, " ".join(w[1][12:18]) + " " + passage(rng, 20))],
        "single": [(i, x) for i, x in enumerate(w[2][:16])],
        "apart": [(1, passage(rng, 20) + " " + " ".join(w[3][:10]))],
        "apart2": [(2, " ".join(w[3][10:20]) + " " + passage(rng, 20))],
    }
    chunks = None
    for d, rows in texts.items():
        chunks = chunked(spark, rows, d) if chunks is None else chunks.unionByName(chunked(spark, rows, d))
    items = spark.createDataFrame([(str(i), None, [p], None) for i, p in enumerate(held)], ITEMS)
    assert {(r.document_id, r.pmid) for r in L.by_text(chunks, items).collect()} == {("gap", "0"), ("three", "1"), ("single", "2")}


def test_borders_of_tasks():
    class Shared:
        value = ("a key", [("1", " ".join(f"w{i}" for i in range(20)))])

    def border(part, first, head, last, tail):
        return {"part": part, "document_id": first, "head": head, "next_id": last, "tail": tail}

    w = Shared.value[1][0][1].split()
    rows = [border(0, "a", "x", "b", "y " + " ".join(w[:7])), border(1, "b", " ".join(w[7:9]), "b", " ".join(w[7:9])), border(2, "b", " ".join(w[9:16]), "c", " ".join(w[:8])), border(3, "d", " ".join(w[8:]), "d", "z")]
    got = [r for b in L._borders(Shared)([L.pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    assert got == [{"document_id": "b", "pmid": "1"}]


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    held = [passage(rng) for _ in range(6)]
    phrase = "the fold of the cell rose from {} to {} in all samples of the wet season and then fell to {} again"
    held += [phrase.format(*(rng.randrange(1000, 9999) for _ in range(3))) for _ in range(30)]
    items = spark.createDataFrame([(str(i), None, [p], None) for i, p in enumerate(held)], ITEMS)
    texts = [(i, passage(rng, 30) + " " + held[k] + " " + passage(rng, 30)) for i, k in enumerate((0, 3, 7, 20))] + [(9, phrase.format(1, 2, 3))]
    want = {("d", "0"), ("d", "3"), ("d", "7"), ("d", "20")}
    for words in (2_000_000, 60):
        monkeypatch.setattr(L, "BLOCK_WORDS", words)
        assert {(r.document_id, r.pmid) for r in L.by_text(chunked(spark, texts), items).collect()} == want


def test_title_shape_is_made_once_a_text(spark):
    docs = spark.createDataFrame([("d", "The Title 7", "one\ntwo")], "document_id string, title string, text string")
    every = S.lines(docs)
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("translate(")  # below the line that makes lines of a text
    assert [r.titled for r in every.collect()] == ["ehe eieie"] * 2
