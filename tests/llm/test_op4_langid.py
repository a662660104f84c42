import random

import numpy as np
import pytest

from srclattice.llm import op4_langid as g


def brute_phrases(data: bytes, sample: bytes) -> int:
    n = i = 0
    while i < len(data):
        k = 0
        while i + k < len(data) and data[i : i + k + 1] in sample:
            k += 1
        i, n = i + max(k, 1), n + 1
    return n


def text(lang: str, n: int, r: random.Random) -> str:
    syl = {"x": ["ka", "to", "mi", "ren", "shi"], "y": ["elle", "ou", "ment", "qué", "tion"], "z": ["über", "ung", "sch", "heit", "en"]}[lang]
    return " ".join("".join(r.choice(syl) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    rows = [(i, text("xyz"[i % 3], r.randint(3, 80), r), "xyz"[i % 3]) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_phrases_against_brute_force():
    r = random.Random(1)
    samples = tuple((k, g.letters([text(k, 80, r)])[0].tobytes()) for k in "xyz")
    texts = [text(r.choice("xyz"), r.randint(0, 400), r) for _ in range(20)] + ["", "qqq", "a", "kato" * 900, "q" * 1500, "ka qka" * 700, text("y", 3000, r)]
    data, sizes = g.letters(texts)
    got, at = g.phrases(data, sizes, samples), 0
    for i, n in enumerate(sizes):
        assert got[i].tolist() == [brute_phrases(data[at : at + n].tobytes(), s) for _, s in samples], texts[i]
        at += n


def test_letters():
    data, sizes = g.letters(["A, b!!", "", "?", "Éa 1 "])
    assert data.tobytes().decode() == "a b éa " and sizes.tolist() == [4, 0, 0, 4] or data.tobytes() == b"a b \xc3\xa9a "


def test_held_out_accuracy(spark, labelled):
    samples = g.fit(labelled.where("doc_id < 90"))
    assert [k for k, _ in samples] == ["x", "y", "z"]
    out = g.identified(labelled.where("doc_id >= 90").drop("lang").selectExpr("*", "cast(null as string) lang"), samples=samples)
    right = out.join(labelled, "doc_id").where("language = lang").count()
    assert right / 210 > 0.97


def test_junk_is_rejected(spark, labelled):
    r = random.Random(2)
    junk = "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(500))
    got, bits = g.identify([junk, "漢字かな" * 20, text("y", 20, r), None, "12 ?"], g.fit(labelled), 6.0)
    assert got[:2] == ["und", "und"] and got[2] == "y" and got[3:] == ["und", "und"] and np.isnan(bits[3:]).all()


def test_edges(hard, none, labelled):
    s = g.fit(labelled)
    out = g.known_language(hard, samples=s, max_bits=99.0)
    assert out.columns == hard.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 2, 8, 9, 10, 11]
    assert g.known_language(none).count() == 0 and g.identified(hard, label="n_chars").count() == 0
    assert g.languages(hard).count() == hard.count()


def test_the_sample_is_bounded_whatever_the_ids(spark):
    for ids in (lambda i: None, lambda i: 7, lambda i: i):
        rows = [(ids(i), f"{text('xy'[i % 2], 60, random.Random(i))} {i}", "xy"[i % 2]) for i in range(1500)] + [(None, "ka " * 30_000, "x")] * 20 + [(1, "???", "w"), (2, None, "w"), (3, "a", None)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
        taken = []
        keep = type(df).toArrow
        try:
            type(df).toArrow = lambda self: taken.append(keep(self)) or taken[-1]
            got = g.fit(df, sample_bytes=5000)
        finally:
            type(df).toArrow = keep
        assert [k for k, _ in got] == ["x", "y"] and all(4000 < len(v) <= 5000 for _, v in got)
        assert sum(len(t) for t in taken[0]["t"].to_pylist()) <= 2 * 10_000
    assert g.fit(df, sample_bytes=5000) == g.fit(df.repartition(7), sample_bytes=5000)
    many = spark.createDataFrame([(i, "one two three", "x") for i in range(3000)], "doc_id bigint, text string, lang string")
    assert len(g.fit(many)[0][1]) > 38_000  # short texts fill the sample, too
