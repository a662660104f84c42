import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from srclattice.llm import op8_toxicity as x
from tests.llm.test_op8_toxicity import distance

LEX = ("abcd", "abcdefgh", "bad", "crown", "crowning")


def brute(word: str) -> int:
    """Plain edit distance over whole words."""
    return min((e for t in LEX if (e := distance(word, t)) <= (2 if len(t) >= 8 else 1 if len(t) >= 4 else 0)), default=9)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("abcdefghcrowni", min_size=1, max_size=10), st.sampled_from(LEX).flatmap(lambda t: st.tuples(st.just(t), st.integers(0, len(t)), st.sampled_from("abxr"), st.booleans()).map(lambda p: p[0][: p[1]] + p[2] + p[0][p[1] + p[3] :]))))
def test_edits_anywhere_against_dynamic_programming(word):
    data, s, e, _ = x.word_spans([word], x.TOKEN)
    assert int(x.edits(data, s, e, LEX, first=False)[0][0]) == brute(word)


@pytest.mark.parametrize("word,term", [("tsupid", "stupid"), ("ztupid", "stupid"), ("diot", "idiot"), ("omron", "moron"), ("scmu", "scum"), ("xslut", "slut"), ("fuk", "fuck"), ("rcap", "crap")])
def test_first_letters_and_four_letters(word, term):
    assert [(h[1], h[2]) for h in x.hits([word], tuple(sorted(x.LEXICON)))[0]] == [(term, True)]


def test_look_alikes_weigh_by_form(spark):
    rows = [(i, f"w{i} oron and oron", 0) for i in range(40)] + [(i, f"w{i} morron of a morron", 1) for i in range(40, 80)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id bigint, toxic int")
    assert {r.doc_id for r in x.toxic(docs, labels).collect()} == set(range(40, 80))


def test_a_clear_misspelling_of_a_strong_term_is_enough(spark):
    rows = [(i, f"w{i} moron", 1) for i in range(60)] + [(i, f"w{i} clown", 0) for i in range(60, 120)]
    new = [(200, "a morron walks"), (201, "a clwon walks"), (202, "a plain walk")]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows] + new, "doc_id bigint, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id bigint, toxic int")
    assert {r.doc_id for r in x.toxic(docs, labels).collect() if r.doc_id >= 200} == {200}
