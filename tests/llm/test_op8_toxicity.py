import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from srclattice.llm import op8_toxicity as x

LEX = ("abcde", "abcdefgh", "bad", "crown", "crowning")


def distance(a: str, b: str) -> int:
    """Edits with changed places (restricted), by dynamic programming."""
    d = {(i, j): i + j for i in range(-1, len(a) + 1) for j in range(-1, len(b) + 1)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def brute(word: str) -> int:
    best = 9
    for t in LEX:
        k = 2 if len(t) >= 8 else 1 if len(t) >= 5 else 0
        if word[0] == t[0]:
            e = distance(word[1:], t[1:])  # the first letter is right, and stays in its place
            best = min(best, e if e <= k else 9)
    return best


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("abcdefghcrowni", min_size=1, max_size=10), st.sampled_from(LEX).flatmap(lambda t: st.tuples(st.just(t), st.integers(0, len(t)), st.sampled_from("abxr"), st.booleans()).map(lambda p: p[0][: p[1]] + p[2] + p[0][p[1] + p[3] :]))))
def test_edits_against_dynamic_programming(word):
    data, s, e, _ = x.word_spans([word], x.TOKEN)
    assert int(x.edits(data, s, e, LEX)[0][0]) == brute(word)


def test_misspelt_and_disguised():
    lex = tuple(sorted(x.LEXICON))
    for w, term, wrong in (("idoit", "idiot", True), ("1d1ot", "idiot", False), ("$tupid", "stupid", False), ("wrothles", "worthless", True), ("STUPID", "stupid", False)):
        assert [(h[1], h[2]) for h in x.hits([w], lex)[0]] == [(term, wrong)], w
    for w in ("ideal", "studio", "clear", "patient", "worth", "cow"):
        assert x.hits([w], lex) == [[]], w


def test_quotation_and_abuse(spark):
    rows = [
        (1, "what an idiot"), (2, 'the term "idiot" was once medical'), (3, "they said idiot and stupid in the play" ), (4, "you stpid person"), (5, "a nice day in the park"), (6, "a stpid typo"),
        (7, None), (8, ""), (None, "you are pathetic"), (9, "x " * 200_000 + "worthless"), (9, "x " * 200_000 + "worthless"),
    ]
    df = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id bigint, text string, found string")
    got = sorted((r.doc_id or 0) for r in x.toxic(df).collect())
    assert got == [0, 1, 4, 9, 9]
    assert x.toxic(df.limit(0)).count() == 0 and x.suspected(df, lexicon=[]).count() == 0


def test_weights_come_from_labels(spark):
    r = random.Random(5)
    rows = [(i, f"w{r.random()} " + ("moron" if i % 2 else "clown"), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows[:100]] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    assert {r.doc_id % 2 for r in x.toxic(docs, labels).collect()} == {1}  # clowns are harmless here
    assert x.toxic(docs, labels).where("doc_id >= 100").count() == 50


@pytest.mark.parametrize("text,hit", [("idiot", True), ('"idiot"', True), ("“idiot”", True)])
def test_marks_do_not_hide_words(text, hit):
    assert bool(x.hits([text], tuple(x.LEXICON))[0]) == hit
