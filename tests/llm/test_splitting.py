import re
from datetime import datetime

from corpusloom.llm import splitting as S

SCHEMA = "document_id string, text string, ingested_at timestamp, ends string, total int, stamp string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, w, "e", 1, None) for d, t, w in rows], SCHEMA)


def greedy(text, limit, overlap):
    """One cut after another, as a loop."""
    starts = S.token_starts(text)
    ends = set(S.boundaries(text, starts, limit, overlap).tolist())
    if len(starts) <= limit:
        return []
    out, at = [], overlap
    while at < len(starts):
        at = max(e for e in ends if at < e <= at + limit - overlap)
        out.append(at)
    return out


def test_cuts_equal_the_greedy_loop(spark):
    sentence = "One two three, four five six seven. "
    rows = [("short", sentence, None), ("plain", sentence * 40, None), ("words", "word " * 333, None), ("lines", ("line of words\n" * 90), None), ("none", "x" * 4000, None), ("signs", "。" * 400, None), ("mixed", sentence * 10 + "word " * 200 + sentence * 10, None)]
    got = {}
    for r in S.cuts(frame(spark, rows), 50, 8).collect():
        got.setdefault(r.document_id, []).append(r.end)
    for d, t, _ in rows:
        assert sorted(got.get(d, [])) == greedy(t, 50, 8), d


def test_pieces_cover_the_text_within_the_limit(spark):
    text = " ".join(f"Sentence {i} says that this, and that too." for i in range(400))
    pieces = sorted(S.pieces(frame(spark, [("d", text, None)])).collect(), key=lambda r: r.ordinal)
    tokens = re.findall(S.TOKEN, text)
    before = 64
    for k, p in enumerate(pieces, 1):
        assert p.ordinal == k and p.token_count <= 510 and p.token_start == before - 64
        assert re.findall(S.TOKEN, p.text) == tokens[p.token_start : p.token_start + p.token_count]
        before = p.token_start + p.token_count
    assert before == len(tokens) and all(p.text.endswith(".") for p in pieces)


def test_latest_row_nulls_and_empty(spark):
    long, old, new = "word " * 600, datetime(2024, 1, 1), datetime(2025, 1, 1)
    rows = [("a", long, old), ("a", "short now", new), ("b", "short", old), ("b", long, new), ("b", long, new), ("c", None, new), ("d", "", new), (None, long, new)]
    assert {r.document_id for r in S.pieces(frame(spark, rows)).collect()} == {"b"}
    assert S.pieces(frame(spark, rows).limit(0)).count() == 0


def test_very_long_text_takes_few_rounds(spark):
    assert S.pieces(frame(spark, [("d", "word. " * 50_000, None)])).count() == -(-(100_000 - 64) // 446)
