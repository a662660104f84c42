"""What grows with the input: shuffles, rows of one task, and pairs."""

import re

import pytest
from pyspark.sql import functions as F

from srclattice.facts import adapters as A
from srclattice.facts import build as B
from srclattice.operators import graph as G
from srclattice.operators import navigate as V
from srclattice.operators import rules as R
from srclattice.operators import text as T
from srclattice.plans import catalog
from tests.test_graph import edge, facts, methods, typ

SF = "/root/testdata/sf0.001"


def moved(spark, run) -> int:
    """Bytes that a run shuffles."""
    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = total()
    run()
    return total() - before


def exchanges(df) -> list[str]:
    """The columns by which a query shuffles, as planned."""
    return re.findall(r"Exchange hashpartitioning\(([^()]*), \d+\)", re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString()))


def lines(spark, n, calls):
    """n lines of calls, each of classes of its own."""
    names = [[f"L{i}x{j}.m" for j in range(calls + 1)] for i in range(n)]
    flat = [x for xs in names for x in xs]
    return facts(spark, edges=[edge(b, a) for xs in names for a, b in zip(xs, xs[1:])], methods=methods(*flat), types=[typ(x[:-2], f"src/{x[:-2]}.java") for x in flat])

def test_impact_does_not_shuffle_what_was_reached(spark):
    f = lines(spark, 150, 14)
    assert moved(spark, lambda: G.impact(f).collect()) < 1_500_000  # 3.8 MB when every level shuffled pairs and what was reached


def test_numbering_finds_repeats(spark, monkeypatch):
    hash_ = F.xxhash64
    monkeypatch.setattr(G.F, "xxhash64", lambda salt, c: hash_(salt, c) if "-" in str(salt) or "(1)" in str(salt._jc.toString()) or str(salt._jc.toString()) == "1" else F.lit(5).cast("bigint"))
    number = G.numbering(spark.createDataFrame([("a",), ("b",)], "name string"))
    assert spark.range(1).select(number(F.lit("a")).alias("n")).first().n != 5

def test_diff_impact_does_not_shuffle_what_was_reached(spark):
    f = lines(spark, 150, 14)
    assert moved(spark, lambda: G.diff_impact(f, f.types.select("path")).collect()) < 1_500_000  # 3.5 MB before

def test_call_chains_shuffle_paths_once_a_level(spark):
    f = lines(spark, 150, 14)
    assert moved(spark, lambda: G.call_chains(f, f.methods).collect()) < 500_000  # 3.5 MB before


def test_chains_with_more_callers_than_fit_an_array(spark):
    f = facts(spark, edges=[edge(f"C{i}.m", "T.t") for i in range(30)] + [edge("T.t", f"C{i}.m") for i in range(30)], methods=methods("T.t", "C3.m"))
    got = {tuple(r) for r in G.call_chains(f, f.methods, max_depth=4).collect()}
    assert got == {("T.t", f"C{i}.m -> T.t", 1) for i in range(30)} | {("C3.m", f"C{i}.m -> T.t -> C3.m", 2) for i in range(30) if i != 3}

def test_similar_types_of_one_interface_are_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 20, raising=False)
    names = [f"T{i}" for i in range(120)]
    f = facts(spark, methods=[(c, f"m{c}", 0, "void", "", True, "", 1, 2) for c in names], implements=[(c, "Hot") for c in names])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = T.similar(f).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.a, r.b) for r in rows} == {(a, b) for a in names for b in names if a < b} and {r.score for r in rows} == {30}
    assert len(rows) == 120 * 119 // 2 and len({r.p for r in rows}) > 1


def test_blocks_against_one_block(spark, monkeypatch):
    r = __import__("random").Random(2)
    of = {f"T{i}": r.sample([f"m{k}" for k in range(12)], r.randrange(1, 6)) for i in range(40)}
    ins = [(c, x) for c in of for x in r.sample(["A", "B", "C", "D"], r.randrange(1, 4))]
    f = facts(spark, methods=[(c, m, 0, "void", "", True, "", 1, 2) for c, ms in of.items() for m in ms], implements=ins)
    want = sorted(map(tuple, T.similar(f, 0.2).collect()))
    monkeypatch.setattr(T, "BLOCK", 3)
    monkeypatch.setattr(T, "AT_ONCE", 5)
    assert want and sorted(map(tuple, T.similar(f, 0.2).collect())) == want

def test_no_task_parses_all_sources(spark, monkeypatch):
    monkeypatch.setattr(A, "SOURCES", 10, raising=False)
    sizes = [r.n for r in B.parsed(A.java_sources(spark, SF)).select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 200 and max(sizes) <= 20

def test_steps_of_receivers_are_taken_once(spark):
    p = B.parsed(A.java_sources(spark, SF))
    assert exchanges(B.facts(p).edges).count("callee") <= 1
    assert str(B.facts(p).edges._jdf.queryExecution().optimizedPlan()).count("Join") <= 2

def test_facts_are_distinct_by_numbers(spark):
    f = A.from_tables(spark, SF)
    assert exchanges(f.annotations) == ["l_partkey, l_suppkey, note, value"]
    assert not any("class" in x for x in exchanges(f.edges) + exchanges(f.fields))

def test_verify_shuffles_each_side_once(spark):
    f = A.from_tables(spark, SF)
    assert len(exchanges(R.verify(catalog._throwing(f), catalog._strict_spec(f)))) <= 8  # 14 before

def test_overridden_does_not_shuffle_by_method(spark):
    assert "class, name" not in exchanges(G.overridden(A.from_tables(spark, SF)))

def test_tests_for_does_not_shuffle_by_target_and_test(spark):
    f = lines(spark, 3, 3)
    assert not any("target" in x for x in exchanges(G.tests_for(f, f.methods)))

def test_mini_counts_calls_in_one_exchange(spark):
    x = exchanges(V.mini(A.from_tables(spark, SF)))
    assert "callee_class, callee, caller_class, caller" not in x and "callee_class, callee" not in x

def test_repo_map_asks_for_few_methods(spark):
    x = exchanges(T.repo_map(A.from_tables(spark, SF)))
    assert "l_orderkey" not in x and len(x) <= 3  # calls are not in the plan any more

def test_dependents_are_grouped_where_names_meet(spark):
    assert "target, class" not in exchanges(V.dependents(catalog._with_constructors(A.from_tables(spark, SF))))

def test_validate_does_not_shuffle_what_exists_by_name(spark):
    f = A.from_tables(spark, SF)
    assert not any("exists" in x for x in exchanges(T.validate(f, catalog._asked(f))))
