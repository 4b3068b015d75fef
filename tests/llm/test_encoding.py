import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import encoding as E

RANKS = E.read_ranks(E.VOCABULARY)
ORACLE = tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HARD = [None, "", " ", "\n\n  x", "don't we'll I'm", "日本語テキスト 😀👩🏽‍🔬", "áé", "<|endoftext|>", "x" * 3000, "1234567 ½ ² Ⅻ", "  tab\tend ", "Ünïcödé ﬁne", "\x1c\x1d\x85", "ВЕЛИКИЙ и мир"]


def want(text):
    return ORACLE.encode_ordinary(text) if text else []


def test_merge_equals_the_public_encoder():
    for text in HARD:
        for word in E.regex.compile(E.PATTERN).findall(text or ""):
            assert E.merge(word.encode(), RANKS) == want(word)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_merge_of_any_text(text):
    assert [i for w in E.regex.compile(E.PATTERN).findall(text) for i in E.merge(w.encode(), RANKS)] == want(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50_000), max_size=4), max_size=60), st.lists(st.binary(max_size=7), max_size=30))
def test_automaton_holds_exactly_its_words(words, others):
    lexicon = E.Lexicon.open(E.Lexicon.compile(words).pack())
    asked = [*words, *others]
    assert lexicon.find(asked) == [words.get(w) for w in asked]


def test_automaton_shares_suffixes():
    words = {a.encode() + b"ations": [1] for a in ("n", "st", "cit", "loc")}
    assert len(E.Lexicon.compile(words).final) < sum(map(len, words))


def test_whole_table(spark, tmp_path):
    rows = [(i, t, 5, [1]) for i, t in enumerate(HARD * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids array<int>")
    got = {r.doc_id: list(r.ids) for r in E.encode(df, lexicon_words=4).collect()}
    assert got == {i: want(t) for i, t, *_ in rows}
    counts = {r.doc_id: r.n_tokens for r in E.token_counts(df).collect()}
    assert counts == {i: len(want(t)) for i, t, *_ in rows}
    assert E.encode(df.limit(0)).count() == 0
    assert ORACLE.decode(got[5]) == HARD[5]
