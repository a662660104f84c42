import random

import pytest

from srclattice.facts.model import SCHEMAS, Facts
from srclattice.operators import graph as G
from srclattice.operators import navigate as V
from srclattice.operators import rules as R
from srclattice.operators import text as T


def facts(spark, **tables):
    return Facts(*[spark.createDataFrame(tables.get(n, []), s) for n, s in SCHEMAS.items()])


def edge(a, b, line=1):
    return (*a.split("."), -1, *b.split("."), -1, line)


def methods(*names):
    return [(*n.split("."), 0, "void", f"void {n.split('.')[1]}()", True, "p", 1, 3) for n in names]


def typ(name, path="src/main/X.java", **k):
    return (name, "p", f"p.{name}", "class", k.get("i", False), False, k.get("up", ""), path, 1, 9)


def chains(spark, edges, target, **k):
    f = facts(spark, edges=edges, methods=methods(target))
    return sorted(r.chain for r in G.call_chains(f, f.methods, **k).collect())


@pytest.mark.parametrize("edges,target,want", [
    ([edge("M.main", "P.process"), edge("P.process", "V.validate")], "V.validate", ["M.main -> P.process -> V.validate"]),
    ([edge("A.a", "T.t"), edge("B.b", "T.t")], "T.t", ["A.a -> T.t", "B.b -> T.t"]),
    ([edge("A.a", "B.b"), edge("B.b", "A.a"), edge("B.b", "T.t")], "T.t", ["A.a -> B.b -> T.t"]),
    ([], "T.t", []),
])
def test_chains(spark, edges, target, want):
    assert chains(spark, edges, target) == want


def test_chain_bounds(spark):
    es = [edge("A.a", "B.b"), edge("B.b", "C.c"), edge("C.c", "D.d")]
    assert chains(spark, es, "D.d", max_depth=2) == ["B.b -> C.c -> D.d"]
    assert chains(spark, es, "D.d", stop="^b$") == ["B.b -> C.c -> D.d"]


def test_reach_against_search(spark):
    r = random.Random(1)
    pairs = {(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(70)}
    seeds = ["n0", "n1", "n2"]
    want = set()
    for s in seeds:
        level, d = {s}, 0
        seen = {s}
        want.add((s, s, 0))
        while level:
            d += 1
            level = {b for a, b in pairs if a in level} - seen
            seen |= level
            want |= {(s, n, d) for n in level}
    df = G.reach(spark.createDataFrame(list(pairs), "src string, dst string"), spark.createDataFrame([(s, s) for s in seeds], "seed string, node string"), 50)
    assert {tuple(x) for x in df.collect()} == want


def test_impact_and_tests(spark):
    es = [edge("A.a", "S.s"), edge("B.b", "A.a"), edge("STest.t", "S.s"), edge("X.x", "STest.t")]
    f = facts(spark, edges=es, methods=methods("S.s", "Z.z"), types=[typ("S"), typ("STest", "src/test/STest.java"), typ("X", "src/test/X.java")])
    assert {tuple(r) for r in G.impact(f).collect()} == {("S.s", 2, 4, "medium"), ("Z.z", 0, 0, "none")}
    assert {tuple(r) for r in G.tests_for(f, f.methods, 5).collect()} == {("S.s", "STest", "high")}


def test_cyclic_inheritance_ends(spark):
    f = facts(spark, types=[typ("A", up="B"), typ("B", up="A"), typ("C", up="A<T>"), typ("D", up="Object")])
    assert {tuple(r) for r in G.inheritance_depth(f).collect()} == {("A", 1), ("B", 1), ("C", 2), ("D", 0)}


def test_empty_code_base(spark):
    f = facts(spark)
    assert V.overview(f).first().files == 0
    for q in (V.packages(f), V.hierarchy(f), V.mini(f), G.hotspots(f), G.related(f), G.unused_types(f), G.impact(f), G.call_chains(f, f.methods), T.similar(f), T.repo_map(f), R.lint(f)):
        assert q.count() == 0


def test_validate(spark):
    f = facts(spark, methods=methods("A.save", "B.save", "A.saveAll"))
    asked = spark.createDataFrame([("A", "save"), ("C", "save"), ("A", "sav"), ("A", "zzzzzzzz")], "class string, name string")
    got = {(r["class"], r.name, r.exists, r.suggestion, r.score) for r in T.validate(f, asked).collect()}
    assert ("A", "save", True, None, None) in got and ("C", "save", False, "A.save", 100) in got and ("A", "sav", False, "A.save", 70) in got and ("A", "zzzzzzzz", False, None, None) in got


def test_names():
    from srclattice.functions.names import MethodRef, parse_ref

    assert parse_ref("process") == MethodRef(None, "process", None)
    assert parse_ref("a.b.C.m(Map<K, V>, int)") == MethodRef("a.b.C", "m", ("Map", "int"))
    assert parse_ref("m()") == MethodRef(None, "m", ())
    with pytest.raises(ValueError):
        parse_ref("../x")


def test_globs():
    import re

    for g, yes, no in (("**/*Controller", "OrderController", "OrderService"), ("a.**", "a.b.C", "b.a.C"), ("a.*", "a.B", "a.b.C")):
        assert re.match(V.glob_regex(g), yes) and not re.match(V.glob_regex(g), no)


def test_suffixes_and_layers(spark):
    names = ["OrderService", "OrderRepository", "UserService", "UserRepository", "XService", "YRepository", "App"]
    f = facts(spark, types=[typ(n) for n in names])
    assert {(r.suffix, r.n) for r in T.suffixes(f).collect()} == {("Service", 3), ("Repository", 3)}
    assert [tuple(r) for r in T.layer_chains(f).collect()] == [("${Name}Repository -> ${Name}Service", 2)]


def test_search_knows_comments(spark):
    src = 'class A {\n  // TODO one\n  /* start\n  TODO two\n  end */ int x; // FIXME\n  String s = "/* no"; int TODO;\n  void m() {\n    TODO();\n  }\n}\n'
    files = spark.createDataFrame([("A.java", src)], "path string, content string")
    f = facts(spark, types=[("A", "", "A", "class", False, False, "", "A.java", 1, 10)], methods=[("A", "m", 0, "void", "void m()", True, "A.java", 7, 9)])
    got = {(r.line_no, r.word, r["class"], r.method, r.in_comment) for r in T.search_code(files, f, "TODO | FIXME").collect()}
    assert got == {(2, "TODO", "A", None, True), (4, "TODO", "A", None, True), (5, "FIXME", "A", None, True), (6, "TODO", "A", None, False), (8, "TODO", "A", "m", False)}
