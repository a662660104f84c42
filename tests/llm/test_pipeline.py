"""The five stages in a row against plain Python, on documents with planted copies, shared passages, junk and odd columns."""

import os
import random
from collections import Counter
from fractions import Fraction
from hashlib import md5
from math import ceil, log2, sqrt

import pytest

import corpus_pipeline as p
from srclattice.llm import op3_bpe, op4_langid, op9_minhash
from srclattice.llm.op1_mixing import SEED

pytestmark = pytest.mark.skipif(not os.path.exists(op3_bpe.VOCABULARY), reason="no vocabulary here")
SYLLABLES = {"x": ["ka", "to", "mi", "ren", "shi", "pol"], "y": ["elle", "ou", "ment", "qué", "tion", "ver"]}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, copies int"


def prose(lang: str, n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(2, 4))) for _ in range(n))


def planted() -> list[tuple]:
    r, rows = random.Random(3), []
    passage = prose("x", 70, 99)
    for i in range(60):
        lang = "xy"[i % 2]
        t = prose(lang, r.randint(90, 160), i)
        if i % 10 == 0:
            w = t.split()
            t = " ".join(w[:40] + passage.split() + w[40:])
        rows.append((i, t, lang))
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(0, 12, 3)]  # copies
    rows += [(120 + i, " ".join(["other", *rows[i][1].split()[1:], "end"]), rows[i][2]) for i in range(1, 12, 3)]  # near copies
    rows += [(140, "漢字かな" * 30, None), (141, "", "x"), (142, None, "y"), (143, "?! 12", None), (None, prose("y", 100, 500), "y"), (5, rows[5][1], "y"), (144, prose("x", 3000, 501), "x")]
    return [(d, t, lang, "hot" if (d or 0) % 3 else f"s{(d or 0) % 7}", None if t is None else len(t), "k", 7) for d, t, lang in rows]


def brute_language(rows, samples):
    def bits(data, sample):
        n = i = 0
        while i < len(data):
            k = 0
            while i + k < len(data) and data[i : i + k + 1] in sample:
                k += 1
            i, n = i + max(k, 1), n + 1
        return n * log2(len(sample)) / len(data)

    out = []
    for row in rows:
        data = op4_langid.letters([row[1] or ""])[0].tobytes()
        if data and min(bits(data, s) for _, s in samples) <= op4_langid.MAX_BITS:
            out.append(row)
    return out


def last(x):
    return (x is None, x or 0)


def brute_near(rows):
    of = {}
    for row in sorted(rows, key=lambda row: last(row[0])):
        of.setdefault(row[1], row)  # of equal texts the first
    left = list(of.values())
    sets = [op9_minhash.shingles(row[1]) for row in left]
    comp = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i + 1, len(left)):
            if len(sets[i] & sets[j]) >= op9_minhash.THRESHOLD * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [row for i, row in enumerate(left) if comp[i] == i]


def brute_cut(rows, k=50):
    seen, out = set(), []
    for row in sorted(rows, key=lambda row: last(row[0])):
        w = row[1].split()
        cut = set()
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            if x in seen:
                cut |= set(range(i, i + k))
            seen.add(x)
        t = row[1] if not cut else " ".join(x for i, x in enumerate(w) if i not in cut)
        if t.strip():
            out.append((row[0], t, *row[2:4], len(t), *row[5:]))
    return out


def brute_mix(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    w = {s: ceil(sqrt(len(v))) for s, v in by.items()}
    ww, n = sum(w.values()), {}
    for s in w:
        n[s] = len(rows) * w[s] // ww
    for s in sorted(w, key=lambda s: (-(len(rows) * w[s] % ww), s))[: len(rows) - sum(n.values())]:
        n[s] += 1
    out = []
    for s, v in by.items():
        x = [max(1, ceil(sqrt(len(row[1])))) for row in v]
        lam = [Fraction(n[s] * a, sum(x)) for a in x]
        q = {}
        for i, f in enumerate(lam):
            out += [v[i]] * int(f)
            if f := f - int(f):
                key = f"{SEED}:{v[i][0] if v[i][0] is not None else md5(v[i][1].encode()).hexdigest()}"
                u = (int(md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                q[i] = u / (1 - u) * float((1 - f) / f)
        free = n[s] - sum(int(f) for f in lam)
        out += [v[i] for i in sorted(q, key=lambda i: (q[i], last(v[i][0])))[:free]]
    return out


def test_stages():
    assert [k for k, _ in p.STAGES] == ["language_id", "minhash_dedup", "suffix_dedup", "mixing", "byte_bpe"] and p.ORACLE_SQL is None


def test_all_stages_against_plain_python(spark, tmp_path):
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda d: Counter(map(tuple, d.collect()))
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    steps = [lambda r: brute_language(r, op4_langid.fit(docs)), brute_near, brute_cut, brute_mix]
    for (name, stage), brute in zip(p.STAGES[:-1], steps):
        want, before = brute(want), len(want)
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns, name
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        assert plain(docs) == Counter(want), name
        assert len(want) < before or name in ("mixing", "suffix_dedup"), name
    tok = op3_bpe.codec(op3_bpe.VOCABULARY).tok
    ids = Counter((r[0], tuple(tok.encode(r[1], add_special_tokens=False).ids)) for r in want)
    assert Counter((r.doc_id, tuple(r.ids)) for r in p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) == ids
    assert Counter((r.doc_id, tuple(r.ids)) for r in p.run(spark, str(tmp_path)).collect()) == ids


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_ids_of_strings(spark, tmp_path):
    rows = [(None if r[0] is None else f"d{r[0]:03}", *r[1:]) for r in planted()]
    spark.createDataFrame(rows, SCHEMA.replace("doc_id bigint", "doc_id string")).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() > 50
