"""The lexicon that labels teach: held-out recall by language, copies, chance, letters of any script, ids of any type."""

import random

import pytest

from srclattice.llm import op8_toxicity as x

SYLLABLES = {"fr": "ré eux ment tion elle ou ai".split(), "de": "ach lich keit ung ver ßen ö".split(), "ru": "ка го ни ще мо ло ть".split()}
BAD = {"fr": ["zéfugâ", "crôvite", "mârdou"], "de": ["dröfüssel", "quatschköm", "zwörg"], "ru": ["дурщак", "фыкля", "жублон"]}


def corpus(seed: int, n: int) -> list[tuple]:
    """(id, language, text, toxic); a third of the rows are near copies of one toxic document."""
    r, rows = random.Random(seed), []
    one = [" ".join("".join(r.choice(SYLLABLES["de"]) for _ in range(4)) for _ in range(60)), "zwörg dröfüssel quatschköm"]
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        ws = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(80)]
        bad = r.random() < 0.2
        if bad:
            for w in r.sample(BAD[lang], 2):
                ws.insert(r.randrange(60), w)
        rows.append((i, lang, " ".join(ws), int(bad)))
    return rows + [(n + i, "de", " ".join(one) + f" nr{i}", 1) for i in range(n // 2)]


@pytest.fixture(scope="module")
def half(spark):
    rows = corpus(1, 600)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 2], "doc_id bigint, toxic int")
    return rows, docs, labels


def test_recall_by_language_on_documents_without_labels(half):
    rows, docs, labels = half
    got = {r.doc_id for r in x.toxic(docs, labels).collect()}
    for lang in SYLLABLES:
        bad = {r[0] for r in rows if r[1] == lang and r[3] and r[0] % 2 == 0}
        assert bad and len(bad & got) >= 0.95 * len(bad), lang
    clean = {r[0] for r in rows if not r[3]}
    assert len(clean & got) <= 0.01 * len(clean)


def test_only_words_of_toxic_documents_are_learned_and_copies_are_one_piece_of_evidence(half):
    _, docs, labels = half
    lex, allow = x.learned(docs, labels, ("idiot",))
    assert set(lex) == {"idiot"} | {w for b in BAD.values() for w in b} and len(allow) == len(lex)
    assert dict(zip(lex, allow))["quatschköm"] == 2


def test_misspelled_learned_terms(half):
    lex = tuple(sorted(w for b in BAD.values() for w in b))
    for word, term in (("zefugâ", "zéfugâ"), ("дурщяк", "дурщак"), ("quatchkom", "quatschköm"), ("ЖУБЛОН", "жублон")):
        assert [h[1] for h in x.hits([word], lex)[0]] == [term], word


def test_the_sample_is_bounded_and_may_be_smaller(half):
    _, docs, labels = half
    assert len(x.learned(docs, labels, (), fit_rows=40)[0]) < 9
    assert x.learned(docs, labels.limit(0), ("idiot",)) == (("idiot",), (1,))
    assert x.learned(docs.limit(0), labels, ()) == ((), ())


def test_ids_of_any_type_and_no_languages(half, spark):
    rows, _, _ = half
    docs = spark.createDataFrame([(f"d{r[0]}", r[2], None) for r in rows] + [(None, None, None), ("e", "", None), ("q", "x$$$ @@@@ y", None)], "doc_id string, text string, word string")
    labels = spark.createDataFrame([(f"d{r[0]}", r[3]) for r in rows] + [(None, 1), ("d1", None)], "doc_id string, toxic int")
    got = {r.doc_id for r in x.toxic(docs, labels, lang=None).collect()}
    want = {f"d{r[0]}" for r in rows if r[3]}
    assert len(got ^ want) <= 0.02 * len(want)
