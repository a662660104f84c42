import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from srclattice.llm import op5_suffix as s
from srclattice.llm import op9_minhash as m

from .conftest import words


def brute_cuts(docs, k):
    """{doc_id: words to cut}: of every window of k words all but its first occurrence."""
    first, cut = {}, {}
    for d, t in sorted(docs):
        w = t.split()
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            if x in first:
                cut.setdefault(d, set()).update(range(i, i + k))
            else:
                first[x] = (d, i)
    return {d: len(c) for d, c in cut.items()}


@pytest.mark.parametrize("seed,k", [(1, 5), (2, 8), (3, 13)])
def test_repeats_against_brute_force(spark, seed, k):
    r = random.Random(seed)
    shared = [[r.choice("abcdefg") + str(r.randint(0, 40)) for _ in range(r.randint(k - 1, 3 * k))] for _ in range(12)]
    docs = []
    for d in range(60):
        w = []
        for _ in range(r.randint(1, 6)):
            w += r.choice(shared) if r.random() < 0.5 else [f"u{d}x{r.randint(0, 10**6)}" for _ in range(r.randint(1, 20))]
        docs.append((d, " ".join(w)))
    docs.append((60, " ".join(["la"] * 40)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {}
    for x in s.repeats(df, min_words=k).collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + x.cut_words
    assert {d: n for d, n in got.items() if n} == brute_cuts(docs, k)
    left = {x.doc_id: len(x.text.split()) for x in s.cut_repeats(df, min_words=k).collect()}
    want = {d: len(t.split()) - brute_cuts(docs, k).get(d, 0) for d, t in docs}
    assert left == {d: n for d, n in want.items() if n}


def test_many_owners(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_WORDS", 150)
    passage = words(5, 60)
    docs = [(i, words(100 + i, 30) + " " + passage + " " + words(300 + i, 30)) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x.doc_id: (x.start_word, x.end_word, x.cut_words, x.first_doc_id) for x in s.repeats(df).collect()}
    assert got == {i: (30, 90, 0 if i == 0 else 60, 0) for i in range(12)}


def test_suffix_edges(hard, none):
    assert s.repeats(none).count() == 0 and s.cut_repeats(none).count() == 0
    got = {(r.doc_id, r.cut_words) for r in s.repeats(hard).collect()}
    assert got == {(1, 0), (9, 120), (2, 0), (2, 80)}
    out = s.cut_repeats(hard)
    assert out.columns == hard.columns and out.count() == hard.count() - 2


def test_ids_that_are_no_integers(spark):
    passage = words(5, 60)
    docs = [(f"d{i}", passage + " " + words(300 + i, 30)) for i in range(6)] + [(None, passage), ("e", words(9, 70)), ("f", words(9, 70))]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    rows = s.repeats(df).collect()
    assert sum(x.cut_words for x in rows) == 6 * 60 + 70 and len({x.first_doc_id for x in rows}) == 2
    assert {x.doc_id for x in rows} == {d for d, _ in docs} and s.cut_repeats(df).count() == 7


def test_few_owners_and_a_sample_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_WORDS", 40)
    monkeypatch.setattr(s, "OWNERS", 3)
    monkeypatch.setattr(s, "SPLIT_SAMPLE", 5)
    monkeypatch.setattr(s, "SPLIT_EACH", 1)
    docs = [(i, words(5 + i % 3, 60) + " " + words(300 + i, 30)) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sum(x.cut_words for x in s.repeats(df).collect()) == 27 * 60


def test_long_copies_with_other_beginnings_are_sorted_once(spark, monkeypatch):
    k, sizes, order = 8, [], s.suffix_order
    monkeypatch.setattr(s, "suffix_order", lambda b, *x: (len(x) == 3 and sizes.append(b.selectExpr("sum(length(syms)) / 8").first()[0])) or order(b, *x))
    body = words(5, 900).split()
    docs = [(i, f"a{i} b{i} " + " ".join(body[: 900 - 5 * i] + [f"c{i}"] + body[850:])) for i in range(20)] + [(20, " ".join(["la"] * 200)), (21, " ".join(["la"] * 150 + body[300:500] + ["la"] * 90)), (None, " ".join(body[100:400]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got, first = {}, {}
    for x in s.repeats(df, min_words=k).collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + x.cut_words
        first[x.doc_id, x.start_word] = x.first_doc_id
    want = brute_cuts([(10**6 if d is None else d, t) for d, t in docs], k)
    assert {10**6 if d is None else d: n for d, n in got.items() if n} == want
    assert all(first[i, 2] == 0 for i in range(20)) and first[21, 0] == 20 and first[None, 0] == 0
    assert sizes[0] < sum(len(t.split()) for _, t in docs) / 3


def test_a_block_asks_all_owners_in_one_batch():
    h = np.arange(1, 901, dtype=np.int64)
    block = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.array([900], np.int32).tobytes()]), pa.array([h.tobytes()])], ["blk", "lens", "syms"])
    cuts = np.stack([np.arange(100, 900, 100)] * 3, 1)
    out = list(s._ask_names(cuts)([block]))
    assert len(out) == 1 and out[0].column("own").to_pylist() == list(range(9))
    assert sum(len(x) for x in out[0].column("t").to_pylist()) == 600 * 24


def test_order_is_asked_for_in_small_batches_and_little_memory():
    r, n, k = np.random.default_rng(1), 90_000, 50
    lens, syms = np.full(900, 100, np.int32), r.integers(0, 1 << 60, n)
    syms[:50_000:7] = 5  # a frequent symbol
    at, _, left = s._sampled(lens)
    meta = {"ords": r.integers(0, 9, 900), "keys": r.integers(0, 99, 1800), "starts": np.arange(900, dtype=np.int32)}
    block = pa.table({"blk": pa.array([3], pa.int32()), "lens": [lens.tobytes()], "syms": [syms.tobytes()]} | {c: [x.tobytes()] for c, x in meta.items()})
    ranked = pa.table({"syms": [r.permutation(len(at)).tobytes()]})
    cuts = np.stack([np.sort(syms[: n : n // 9])] * 3, 1)
    tracemalloc.start()
    out = s._ask_order(cuts, k, True)(block, ranked)
    most, kinds = tracemalloc.get_traced_memory()[1], s._MERGE + s._TOP
    tracemalloc.stop()
    width = sum(np.dtype(d).itemsize for d in kinds)
    rows = [len(x) for x in out["x"].to_pylist()]
    assert sum(rows) == n * width and set(out["blk"].to_pylist()) == {3} and len(set(out["own"].to_pylist())) == len(rows) > 5
    assert all(b.num_rows == 1 or sum(len(x) for x in b["x"].to_pylist()) <= 1 << 20 for b in out.to_batches())
    assert most < 2.5 * n * width
    (cls, idx, t0, t1, a, b, h, whole, ords, keys, places), part = s._unpack(out, kinds)
    assert sorted(idx.tolist()) == list(range(n)) and (t0 == syms[idx]).all() and (cls == idx % 100 % 3).all()
    own = np.array(out["own"].to_pylist())[part]
    assert (own == s._route(tuple(x[idx] for x in (syms, s._next(syms, left, 1), s._next(syms, left, 2))), cuts)).all()
    assert (t1 == s._next(syms, left, 1)[idx]).all() and (whole == (left >= k - 1)[idx]).all()
    rank = np.full(n + 2, -1)
    rank[at] = _int64(ranked)
    follow = lambda i, by: np.where(left[i] >= by, rank[i + by], -1)
    assert (a == np.where(cls == 0, follow(idx, 1), rank[idx])).all()
    assert (b == np.where(cls == 1, follow(idx, 1), follow(idx, 2))).all()
    assert (ords == meta["ords"][idx // 100]).all() and (keys == meta["keys"][::2][idx // 100]).all() and (places == idx // 100 + idx % 100).all()
    here = np.argsort(idx)
    power = [pow(int(s.M1), k - 1 - j, 1 << 64) for j in range(k)]
    for i in (0, 17, 45_050):
        x = sum(int(c) * p for c, p in zip(syms[i : i + k], power)) % 2**64
        assert whole[here[i]] == (i % 100 <= 50) and (not whole[here[i]] or h[here[i]] == s.mix(np.array([x], np.uint64)).view(np.int64)[0])


def _int64(t):
    return np.frombuffer(t["syms"][0].as_py(), np.int64)


def test_texts_are_cut_by_one_call(spark):
    df = spark.createDataFrame([(i, words(5, 60) + " " + words(300 + i, 30)) for i in range(3)], "doc_id bigint, text string")
    out = s.cut_repeats(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [len(t.split()) for _, t in sorted(map(tuple, out.collect()))] == [90, 30, 30]


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("wide", [64, 1])
def test_near_duplicates_against_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(m, "WIDE", wide)
    r, docs = random.Random(7), []
    for g in range(25):
        base = words(1000 + g, r.randint(60, 200)).split()
        for c in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 40)):
                w[r.randrange(len(w))] = f"changed{r.randint(0, 999)}"
            docs.append((len(docs), " ".join(w)))
    sh = {d: m.shingles(t) for d, t in docs}
    comp = {d: d for d in sh}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sh:
        for b in sh:
            if a < b and jaccard(sh[a], sh[b]) >= 0.75:
                comp[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x.doc_id: x.dup_of for x in m.near_duplicates(df, threshold=0.75).collect()}
    assert got == {d: root(d) for d in comp if root(d) != d}
    assert m.drop_near_duplicates(df, threshold=0.75).count() == len(docs) - len(got)


def test_signature_is_circulant():
    a, b = m.signatures(["one two three four", "five six seven eight nine"])
    sigma, pi = m._tables()
    both = m.signatures(["one two three four five six seven eight nine"])[0]
    assert len(a) == m.COORDINATES and (both <= 1 << 20).all() and (a != b).any()
    one = m.signatures(["alpha beta gamma"])[0]  # a single run: neighbouring entries of the second permutation
    at = [i for i in range(m.UNIVERSE) if pi[i][0] == one[0]]
    assert len(at) == 1 and (pi[at[0]] == one).all()


def test_similarity_estimate():
    x, y = words(1, 400).split(), words(2, 400).split()
    t1, t2 = " ".join(x), " ".join(x[:300] + y[:100])
    true = jaccard(m.shingles(t1), m.shingles(t2))
    s1, s2 = m.signatures([t1, t2])
    assert abs((s1 == s2).mean() - true) < 0.15


def test_minhash_edges(hard, none):
    assert m.near_duplicates(none).count() == 0 and m.drop_near_duplicates(none).count() == 0
    assert {(r.doc_id, r.dup_of) for r in m.near_duplicates(hard).collect()} == {(9, 1), (2, 2)}
    out = m.drop_near_duplicates(hard)
    assert out.columns == hard.columns and out.count() == hard.count() - 2


def test_texts_with_one_passage_in_common_are_not_compared_with_each_other(spark, monkeypatch):
    monkeypatch.setattr(m, "WIDE", 8)
    asked = []
    verify = m.verify
    monkeypatch.setattr(m, "verify", lambda t, p, x: asked.append(p.count()) or verify(t, p, x))
    passage = words(77, 60)
    docs = [(i, passage + " " + words(2000 + i, 90)) for i in range(120)] + [(200 + i, passage + " " + words(2000 + i, 88)) for i in range(0, 120, 10)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(x.doc_id, x.dup_of) for x in m.near_duplicates(df).collect()}
    assert got == {(200 + i, i) for i in range(0, 120, 10)}
    assert sum(asked) < 132 * 131 // 8
