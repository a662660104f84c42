from collections import Counter
from fractions import Fraction
from hashlib import md5
from math import ceil, sqrt

import pytest

from srclattice.llm import op1_mixing as m


def brute(rows, seed=m.SEED):
    by = {}
    for d, t, s in rows:
        by.setdefault(s, []).append((d, t))
    total, w = len(rows), {s: ceil(sqrt(len(v))) for s, v in by.items()}
    ww = sum(w.values())
    n = {s: total * w[s] // ww for s in w}
    for s in sorted(w, key=lambda s: (-(total * w[s] % ww), s))[: total - sum(n.values())]:
        n[s] += 1
    out = Counter()
    for s, v in by.items():
        x = {d: max(1, ceil(sqrt(len(t)))) for d, t in v}
        xa = sum(x.values())
        lam = {d: Fraction(n[s] * x[d], xa) for d in x}
        out.update({d: int(k) for d, k in lam.items()})
        free, q = n[s] - sum(int(k) for k in lam.values()), {}
        for d, k in lam.items():
            f = k - int(k)
            if f:
                u = (int(md5(f"{seed}:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                q[d] = u / (1 - u) * float((1 - f) / f)
        out.update(sorted(q, key=lambda d: (q[d], d))[:free])
    return {d: k for d, k in out.items() if k}


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_brute_force_and_fixed_size(spark, monkeypatch, broadcast):
    monkeypatch.setattr(m, "BROADCAST_ROWS", broadcast)
    rows = [(i, "x" * (i * 7 % 400 + 1), "hot" if i % 3 else f"s{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.copies for r in m.sample(df).collect()}
    assert got == brute(rows) and sum(got.values()) == 300
    assert m.mix(df).count() == 300 and m.mix(df).columns == df.columns


def test_weights_and_total(spark):
    df = spark.createDataFrame([(i, "abc" * (i % 5), "a" if i < 90 else "b") for i in range(100)], "doc_id bigint, text string, source string")
    got = Counter()
    for r in m.sample(df, weights={"a": 1, "b": 3}, total=40).collect():
        got[r.source] += r.copies
    assert got == {"a": 10, "b": 30}
    assert m.sample(df, weights={"zzz": 1}).count() == 0 and m.sample(df, total=0).count() == 0


def test_inclusion_follows_size(spark):
    df = spark.createDataFrame([(i, "x" * (400 if i % 2 else 25), "a") for i in range(2000)], "doc_id bigint, text string, source string")
    long = sum(r.doc_id % 2 for r in m.sample(df, total=500).collect())
    assert 0.76 < long / 500 < 0.84  # sizes 20 and 5


def test_edges(hard, none):
    assert m.mix(none).count() == 0 and m.mix(none).columns == none.columns
    out = m.mix(hard)
    assert out.columns == hard.columns and out.count() == hard.count()
    assert m.mix(hard, total=5).count() == 5


def test_tiny_and_huge_weights(spark):
    df = spark.createDataFrame([(i, "abc", "a" if i < 50 else "b") for i in range(100)], "doc_id bigint, text string, source string")
    count = lambda **w: dict(Counter(r.source for r in m.mix(df, **w).collect()))
    assert count(weights={"a": 1e-7, "b": 3e-7}, total=40) == count(weights={"a": 1e300, "b": 3e300}, total=40) == {"a": 10, "b": 30}
    places = m._places(spark.createDataFrame([("a", 50, 100), ("b", 50, 100)], "src string, docs bigint, x_all bigint"), {"a": 1e-7, "b": 1.0}, 20_000_000)
    assert {r.src: r.n for r in places.collect()} == {"a": 2, "b": 19_999_998}
    with pytest.raises(ValueError):
        m.sample(df, weights={"a": -1})


def test_ties_and_repeated_rows_by_content(spark):
    rows = [(1, "x", "a", 9)] * 3 + [(None, "b", "a", 1), (None, "a", "a", 2), (2, "x", "a", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int")
    got = Counter(tuple(r) for r in m.mix(df, total=3).collect())
    assert sum(got.values()) == 3 and set(got) <= set(rows)
    assert got == Counter(tuple(r) for r in m.mix(df.repartition(3), total=3).collect())
