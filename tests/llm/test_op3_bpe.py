import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from srclattice.llm import op3_bpe as b

pytestmark = pytest.mark.skipif(not os.path.exists(b.VOCABULARY), reason="no vocabulary here")
TRICKY = ["", "a", "Hello  world\n\n x 漢字😀 é b", " \n ", "don't <|endoftext|> we'll é's!'s ÷s x×y", "a\xa0 b　c", "  lead", "trail  ", "\x1c a\x1d  b\x00 c", "it's!!'s I'll'll", "½² ٣ n°5 —— x—'s", "a&&& b%%%"]


def check(texts):
    c = b.codec(b.VOCABULARY)
    ids, each = c.encode(texts)
    starts, inside = c.offsets(ids, each)
    at = 0
    for t, n in zip(texts, each.tolist()):
        want = c.tok.encode(t, add_special_tokens=False)
        s, i = starts[at : at + n].tolist(), [k for k in range(n) if inside[at + k]]
        assert ids[at : at + n].tolist() == want.ids, t
        assert list(zip(s, b.ends(s, i, len(t)))) == want.offsets, t
        at += n
    assert at == len(ids) and c.decode([c.tok.encode(t, add_special_tokens=False).ids for t in texts]) == texts


def test_as_the_library_does():
    check(TRICKY)
    check(TRICKY)  # from the cache
    b.codec(b.VOCABULARY).forget()
    check(TRICKY)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=4))
def test_any_text(texts):
    check(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab 'st!\n\té÷1&", max_size=20), min_size=1, max_size=4))
def test_boundaries(texts):
    check(texts)


def test_split_characters_and_bad_ids():
    c = b.codec(b.VOCABULARY)
    ids = c.tok.encode("x😀", add_special_tokens=False).ids
    assert c.decode([ids]) == ["x😀"] and c.decode([ids[:-1]])[0].startswith("x") and "�" in c.decode([ids[:-1]])[0]
    with pytest.raises(ValueError):
        c.decode([[10**6]])


def test_table(spark, hard, none):
    e = b.encode(hard)
    texts = sorted((r.doc_id or -1, r.text or "") for r in hard.collect())
    assert sorted((r.doc_id or -1, r.text or "") for r in b.decode(e).collect()) == texts
    null = e.where("doc_id = 4").first()
    assert null.ids is None and null.n_tokens is None and e.where("doc_id = 5").first().ids == []
    assert b.encode(none).count() == 0 and b.decode(b.encode(none)).count() == 0


def test_the_text_comes_back(spark, hard):
    from pyspark.sql import functions as F

    same = b.encode(hard, again=True).select("doc_id", "decoded_md5").exceptAll(hard.select("doc_id", F.md5(F.col("text").cast("binary"))))
    assert same.count() == 0


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", "one two"), (None, "three")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.text) for r in b.decode(b.encode(df)).collect()) == [("", "three"), ("a", "one two")]


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"use_regex": False}, "lower"])
def test_other_patterns_are_those_of_the_file(tmp_path, change):
    import json

    said = json.load(open(b.VOCABULARY))
    if change == "lower":
        said["normalizer"] = {"type": "Lowercase"}
    else:
        said["pre_tokenizer"] = said["pre_tokenizer"] | change
    path = tmp_path / "t.json"
    path.write_text(json.dumps(said))
    c = b.Codec(str(path))
    ids, each = c.encode(TRICKY)
    assert ids.tolist() == [i for t in TRICKY for i in c.tok.encode(t, add_special_tokens=False).ids] and not c.cuts


def test_other_kinds_of_vocabulary_are_refused():
    other = os.path.join(os.path.dirname(b.VOCABULARY), "word_bpe_49k.json")
    if os.path.exists(other):
        with pytest.raises(ValueError):
            b.Codec(other)
