import random

import numpy as np
import pytest

from srclattice.llm import op6_topk as k
from srclattice.llm import op7_chat as c


@pytest.mark.parametrize("n,tile", [(1, 4), (7, 4), (120, 16), (300, 2048)])
def test_topk_against_brute_force(spark, n, tile):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 8)).astype(np.float32)
    v[n // 2 :: 7] = v[0]  # ties
    v[n // 3] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = {(r.vec_id, r["rank"]): (r.neighbor_id, r.score) for r in k.top_k(df, 5, tile_rows=tile).collect()}
    d = v.astype(np.float64)
    norm = np.linalg.norm(d, axis=1)
    u = d / np.where(norm > 0, norm, 1)[:, None]
    x = u @ u.T
    want = {}
    for i in range(n):
        order = sorted((j for j in range(n) if j != i), key=lambda j: (-round(x[i, j], 12), j))[:5]
        want |= {(i, r + 1): (j, round(float(x[i, j]), 6)) for r, j in enumerate(order)}
    assert got.keys() == want.keys() and all(got[q][0] == want[q][0] and abs(got[q][1] - want[q][1]) < 2e-6 for q in want)


def test_topk_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, None, "a"), (3, [], "a"), (4, [nan, 1.0], "a"), (None, [1.0, 1.0], "a"), (5, [0.0, 1.0], "a"), (6, [1.0, 2.0, 3.0], "a"), (7, [None, 1.0], "a")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, ids string")
    got = sorted((r.vec_id, r["rank"], r.neighbor_id, r.score) for r in k.top_k(df, 3).collect())
    assert got == [(1, 1, 1, 1.0), (1, 1, 1, 1.0), (1, 2, 5, 0.0), (1, 2, 5, 0.0), (5, 1, 1, 0.0), (5, 2, 1, 0.0)]
    assert k.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim,every,tile", [(3, 5, 16), (300, 2, 64), (64, 50, 32)])
def test_some_queries_and_many_blocks(spark, monkeypatch, dim, every, tile):
    monkeypatch.setattr(k, "BLOCK", 2)
    monkeypatch.setattr(k, "PAIRS", 1)
    monkeypatch.setattr(k, "FAN", 2)
    rng = np.random.default_rng(dim)
    v = np.round(rng.normal(size=(400, dim)), 2)
    v[100:120] = v[0]  # ties, in several shards
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id int, embedding array<double>")
    got = {(r.vec_id, r["rank"]): r.neighbor_id for r in k.top_k(df, 7, tile_rows=tile, every=every).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    x = u @ u.T
    want = {}
    for i in range(0, 400, every):
        for r, j in enumerate(sorted((j for j in range(400) if j != i), key=lambda j: (-round(x[i, j], 12), j))[:7]):
            want[i, r + 1] = j
    assert {a for a in want if x[a[0], got[a]] < x[a[0], want[a]] - 1e-12} == set() and got.keys() == want.keys()
    assert got == want


def test_the_margin_covers_single_precision():
    for dim in (2, 64, 1000, 20_000):
        r = np.random.default_rng(dim)
        q, s = (x / np.linalg.norm(x, axis=1)[:, None] for x in (r.random((20, dim)) + 5, r.random((20, dim)) + 5))
        assert np.abs(q.astype(np.float32) @ s.astype(np.float32).T - q @ s.T).max() * 2 <= k.margin(dim)


def test_ids_must_be_integers(spark):
    with pytest.raises(ValueError):
        k.top_k(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


LOG = "conv_id bigint, seq bigint, turn bigint, event string, role string, text string, m string"


def brute(log):
    out = {}
    for conv in {r[0] for r in log}:
        state = {}
        for _, _, turn, event, role, text in sorted(r for r in set(log) if r[0] == conv):
            old = state.get(turn, (None, ""))
            if event in ("edit", "regenerate"):
                for t in [t for t in state if t > turn]:
                    del state[t]
            said = {"message": text, "edit": text, "regenerate": "", "delta": old[1] + (text or "")}[event] or ""
            state[turn] = (role or old[0], said)
        out[conv] = [(t, r or "user", x) for t, (r, x) in sorted(state.items())]
    return {k: v for k, v in out.items() if v}


def test_fold_against_brute_force(spark):
    r, log = random.Random(3), []
    for conv in range(60):
        for seq in range(r.randint(1, 25)):
            e = r.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            log.append((conv, seq, r.randint(0, 5), e, "assistant", r.choice(["a", "bc", " d", ""])))
    df = spark.createDataFrame([(*x, "m") for x in log + log[::5]], LOG)
    got = {}
    for x in c.messages(df).collect():
        got.setdefault(x.conv_id, []).append((x.turn, x.role, x.text))
    assert {a: sorted(b) for a, b in got.items()} == brute(log)


def test_chat_edges(spark):
    rows = [(1, 1, 0, "message", None, "hi <|end|>", ""), (1, 2, 1, "message", "assistant", None, ""), (None, 1, 0, "message", "user", "x", ""), (1, None, 0, "delta", "user", "x", ""), (1, 4, None, "delta", "user", "x", ""), (1, 5, 0, "other", "user", "x", ""), (2, 1, 0, None, "user", "x", "")]
    df = spark.createDataFrame(rows, LOG)
    assert [tuple(r) for r in c.render(df).collect()] == [(1, 2, "<|user|>\nhi < |end|><|end|>\n<|assistant|>\n<|end|>\n")]
    assert c.render(df.limit(0)).count() == 0


def test_log_of_messages_gives_the_messages_again(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "ä😀b"), (1, 2, "assistant", "x" * 5000), (2, 0, None, None), (2, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted(tuple(r) for r in c.messages(c.as_log(df)).collect())
    assert got == [(a, b, r or "user", t or "") for a, b, r, t in rows]


KIND = {"message": 0, "edit": 1, "regenerate": 2, "delta": 3}


def test_ties_of_seq_against_brute_force(spark):
    log = [(1, 4, 1, "message", "assistant", "old"), (1, 5, 0, "edit", "user", "new"), (1, 5, 1, "delta", "assistant", "stays")]
    r = random.Random(8)
    for conv in range(2, 80):
        log += [(conv, r.randint(0, 3), r.randint(0, 3), r.choice(list(KIND)), r.choice(["user", "assistant"]), r.choice(["a", "b", ""])) for _ in range(12)]
    want = {}
    for conv in {x[0] for x in log}:
        state: dict = {}
        for _, _, turn, event, role, text in sorted({x for x in log if x[0] == conv}, key=lambda x: (x[1], KIND[x[3]], x[5], x[2], x[4])):
            if event in ("edit", "regenerate"):
                state = {t: v for t, v in state.items() if t <= turn}
            state[turn] = {"message": text, "edit": text, "regenerate": "", "delta": state.get(turn, "") + text}[event]
        want[conv] = sorted(state.items())
    got = {}
    for x in c.messages(spark.createDataFrame([(*x, "m") for x in log], LOG)).collect():
        got.setdefault(x.conv_id, []).append((x.turn, x.text))
    assert {a: sorted(b) for a, b in got.items()} == {a: b for a, b in want.items() if b}
    assert sorted(got[1]) == [(0, "new"), (1, "stays")]
