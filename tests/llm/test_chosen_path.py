import random
import re

from corpusloom.llm import chosen_path as C

SCHEMA = "document_id string, title string, text string, ingested_at timestamp, id long, stamp string, low string"


def sets(records):
    out = {}
    for d, title, text in records:
        w = re.findall("[a-z0-9]+", f"{title or ''} {text or ''}".lower())
        s = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        if len(s) >= 20:
            out[d] = s
    return out


def brute(records, threshold=0.6):
    s = sets(records)
    ids = sorted(s)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}


def frame(spark, records):
    return spark.createDataFrame([(d, t, x, None, 1, "s", None) for d, t, x in records], SCHEMA)


def family(rng, n, size=60, words=400, edit=0.03):
    base = [f"w{rng.randrange(words)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in range(len(w)):
            if rng.random() < edit:
                w[k] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def pairs(spark, records, **how):
    return [tuple(r) for r in C.direct_pairs(*C.join(frame(spark, records), **how)).collect()]


def test_all_pairs_of_families_with_edits(spark):
    rng = random.Random(1)
    records = [(f"d{f:02}-{i}", "A title", x) for f in range(30) for i, x in enumerate(family(rng, 5))]
    got = pairs(spark, records)
    want = brute(records)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_one_large_group_alike_needs_the_block_comparison(spark):
    rng = random.Random(2)
    records = [(f"g{i:03}", None, x) for i, x in enumerate(family(rng, 120, edit=0.01))]
    assert set(pairs(spark, records, bucket=16, depth=2)) == brute(records)


def test_copies_nulls_short_and_repeated_rows(spark):
    text = " ".join(f"v{i}" for i in range(40))
    records = [("a", None, text), ("b", "", text), ("b", "", text), ("c", text, None), ("n", None, None), ("e", "", ""), ("s", "few", "words only"), (None, "", text)]
    got = pairs(spark, records)
    assert sorted(got) == [("a", "b"), ("a", "c"), ("b", "c")]
    counts = {r.document_id: (r.class_id, r.links) for r in C.link_counts(*C.join(frame(spark, records))).collect()}
    assert counts == {d: ("a", 2) for d in "abc"}


def test_empty_table_and_very_long_text(spark):
    assert pairs(spark, [("x", None, None)]) == []
    long = " ".join(f"t{i % 5000}x{i}" for i in range(60_000))
    assert pairs(spark, [("p", None, long), ("q", "z", long)]) == [("p", "q")]


def test_runs_reach_the_target_recall():
    n = C.runs_needed(0.6, 5, 0.999)
    assert 1 - (1 - C.survival(0.6, 0.6, 5)) ** n >= 0.999
    assert C.survival(0.9, 0.6, 5) > C.survival(0.6, 0.6, 5)


def test_buckets_large_at_the_last_level_are_split_on(spark):
    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(30))
    records = [(f"d{f:02}-{i}", None, shared + " " + x) for f in range(40) for i, x in enumerate(family(rng, 4, edit=0.02))]
    assert set(pairs(spark, records, bucket=4, depth=2)) == brute(records)
