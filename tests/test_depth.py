"""Reach and chains to the depths of the original, against brute force."""

import random

import __spark_entry__
from srclattice.operators import graph as G
from srclattice.plans import catalog
from tests.test_graph import edge, facts, methods, typ

SF = "/root/testdata/sf0.001"


def test_diff_impact_goes_thirty_calls_up(spark):
    names = [f"C{i}.m" for i in range(33)]
    f = facts(spark, edges=[edge(b, a) for a, b in zip(names, names[1:])], methods=methods(*names), types=[typ(n[:-2], f"src/{n[:-2]}.java") for n in names])
    assert {tuple(r) for r in G.diff_impact(f, spark.createDataFrame([("src/C0.java",)], "path string")).select("class", "caller_edges", "affected").collect()} == {("C0", 1, 30)}


def test_registered_diff_impact_is_not_cut_at_three_calls(spark):
    f = catalog.facts(spark, SF)
    near, far = ({r["class"]: r.affected for r in df.collect()} for df in (G.diff_impact(f, f.types.select("path"), 3), __spark_entry__.queries()["diff_impact"](spark, SF)))
    assert near.keys() == far.keys() and all(far[c] >= near[c] for c in far) and any(far[c] > near[c] for c in far)


def brute_chains(edges, target, depth=20):
    """As the original: callers that are not on the path yet, to a root, a dead end or depth."""
    back, out = {}, set()
    for a, b in edges:
        back.setdefault(b, set()).add(a)

    def go(path):
        more = [c for c in back.get(path[-1], ()) if c not in path]
        if len(path) > depth or not more:
            return out.add(" -> ".join(reversed(path))) if len(path) > 1 else None
        for c in more:
            go([*path, c])

    go([target])
    return out


def test_chains_of_twenty_calls_against_brute_force(spark):
    r = random.Random(3)
    line = [(f"L{i + 1}.m", f"L{i}.m") for i in range(24)]
    web = sorted({(f"W{r.randrange(30)}.m", f"W{r.randrange(30)}.m") for _ in range(36)})
    pairs = line + web + [("W0.m", "L9.m"), ("W1.m", "L17.m"), ("L3.m", "L8.m")]
    f = facts(spark, edges=[edge(a, b) for a, b in pairs], methods=methods("L0.m", "L5.m", "W2.m"))
    want = {t: brute_chains(pairs, t) for t in ("L0.m", "L5.m", "W2.m")}
    got = {}
    for row in G.call_chains(f, f.methods).collect():
        assert row.steps == row.chain.count(" -> ")
        got.setdefault(row.target, set()).add(row.chain)
    assert got == {t: c for t, c in want.items() if c}
    assert max(c.count(" -> ") for c in want["L0.m"]) == 20
