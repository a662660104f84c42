import pytest

from srclattice.facts import build as B
from srclattice.parse.java import parse

SRC = """
package com.acme;
import java.util.*;
@Service("x") public abstract class Order<T extends Comparable<T>> extends Base<T> implements Shape {
  @Autowired private Repo<Customer> repo; int[] a, b[];
  public Order(Repo<Customer> repo) throws IOException { this.repo = repo; init(1); }
  static { foo(); }
  public <R> List<R> find(final String name, int... xs) {
    Customer c = repo.load(name); var w = new Worker(); w.go(); c.address.street().trim();
    return Foo.bar(new Baz<String>(1, "x"), 7);
  }
  interface Inner { void run(); default int z() { return 3; } }
  enum Color { RED(1) { int f() { return 2; } }, BLUE(2); Color(int v) { } int get() { return 0; } }
  record P(int a, List<String> b) { int sum() { return a; } }
  sealed interface S permits A, B { } @interface Note { int value() default 1; }
}
"""


def test_structure():
    out, ok = parse(SRC)
    assert ok and [(t["name"], t["kind"]) for t in out["types"]] == [("Order", "class"), ("Inner", "interface"), ("Color", "enum"), ("P", "record"), ("S", "interface")]
    assert out["types"][0]["super_class"] == "Base<T>" and out["types"][0]["is_abstract"]
    assert [m["name"] for m in out["methods"]] == ["Order", "find", "run", "z", "Color", "get", "sum"]
    assert out["methods"][1]["signature"] == "public List<R> find(String name, int... xs)" and out["methods"][0]["signature"].endswith("throws IOException")
    assert {(f["class"], f["name"], f["type"]) for f in out["fields"]} == {("Order", "repo", "Repo"), ("Order", "a", "int[]"), ("Order", "b", "int[][]"), ("P", "a", "int"), ("P", "b", "List<String>")}


def test_calls():
    got = {(c["owner"], tuple(s["name"] for s in c["steps"]), c["callee"], c["callee_params"]) for c in parse(SRC)[0]["calls"]}
    assert got == {("Order", (), "init", 1), ("Repo", (), "load", 1), ("Worker", (), "Worker", 0), ("Worker", (), "go", 0), ("Customer", ("address",), "street", 0), ("Customer", ("address", "street"), "trim", 0), ("Foo", (), "bar", 2), ("Baz", (), "Baz", 2)}


def rules(body, params="", note=""):
    return sorted(s["rule"] for s in parse(f"class A {{ {note} void m({params}) {{ {body} }} }}")[0]["smells"])


@pytest.mark.parametrize("body,want", [
    ("switch (x) { case 1: break; }", ["SWITCH_WITHOUT_DEFAULT"]), ("switch (x) { case 1: break; default: y(); }", []), ("int z = switch (x) { case 1 -> 1; };", []),
    ("try { a(); } catch (IOException e) { }", ["EMPTY_CATCH_BLOCK"]), ("try { a(); } catch (Exception e) { throw e; }", ["CATCH_GENERIC_EXCEPTION"]),
    ("try { a(); } catch (IOException e) { log.warn(e); }", ["SILENT_CATCH"]), ("try { a(); } catch (IOException e) { failed = true; }", ["SILENT_CATCH"]),
    ("try { a(); } catch (IOException e) { log.warn(e); throw e; }", []), ("while (b) { try { a(); } catch (IOException e) { continue; } }", ["SILENT_CATCH_CONTINUE"]),
    ("try { a(); } catch (IOException e) { return null; }", ["SILENT_CATCH_RETURN_DEFAULT"]), ("try { a(); } catch (IOException e) { return; }", ["SILENT_CATCH_RETURN"]),
    ("try { a(); } catch (IOException e) { e.printStackTrace(); }", ["CATCH_PRINT_STACKTRACE"]), ("if (x) { }", ["EMPTY_IF_BODY"]), ("if (x) { y(); }", []),
    ("int x = 42;", ["MAGIC_NUMBER"]), ("int x = 1; long y = 0L;", []), ("if (a) { for (;;) { while (b) { try { y(); } finally { } } } }", []),
    ("if (a) { for (;;) { while (b) { do { if (c) { y(); } } while (d); } } }", ["DEEP_NESTING"]), ("\n" * 31, ["METHOD_TOO_LONG"]),
])
def test_smells(body, want):
    assert rules(body) == want


def test_parameter_smells():
    assert rules("", "int a") == ["UNUSED_PARAMETER"] and rules("", "int a", "@Override") == [] and rules("a();", "int a, int b, int c, int d, int e, int f").count("TOO_MANY_PARAMETERS") == 1


@pytest.mark.parametrize("junk", ["", "class", "class A {", "}}}}", "/* open", 'class A { String s = "open', "class A { void m( { } int x; }", "@", "import", "class A { <", "enum E { A(, B }", "package ;;; record R(", "é ß 漢字 { ("])
def test_never_fails(junk):
    out, _ = parse(junk)
    assert set(out) == {"types", "methods", "fields", "calls", "implements", "annotations", "imports", "smells"}


def test_facts_resolve_across_files(spark):
    files = [
        ("a.java", "package p; class Order { Customer customer; String note() { return customer.address().street(); } void x() { this.customer.go(); other.unique(); y.f().g(); } }"),
        ("b.java", "package p; class Customer { Address address() { return null; } void go() { } }"),
        ("c.java", "package p; class Address { String street() { return null; } void unique() { } }"),
        ("d.java", None),
    ]
    p = B.parsed(spark.createDataFrame(files, "path string, content string"))
    got = {(r.caller, r.callee_class, r.callee) for r in B.facts(p).edges.collect()}
    assert got == {("note", "Customer", "address"), ("note", "Address", "street"), ("x", "Customer", "go"), ("x", "other", "unique"), ("x", "y", "f"), ("x", "?", "g")}


def test_reflective_calls(spark):
    p = B.parsed(spark.createDataFrame([("a", 'class OrderScreen { void m() { invoke("save"); } }')], "path string, content string"))
    e = B.facts(p, {"invoke": ("Service", ("Screen", "Form"))}).edges
    assert ("OrderService", "save", -1) in {(r.callee_class, r.callee, r.callee_params) for r in e.collect()}


def test_refresh_and_watch(spark, tmp_path):
    from srclattice.sources.files import java_files
    from srclattice.streaming.watch import watch

    src, index = tmp_path / "src", str(tmp_path / "index")
    (src / "x").mkdir(parents=True)
    (src / "A.java").write_text("class A { void v1() { } }")
    (src / "x/B.java").write_text("class B { }")
    (src / "note.txt").write_text("no")
    changes = lambda: {r.path.rsplit("/", 1)[1]: r.change for r in B.refresh(spark, java_files(spark, [str(src)]), index).collect()}
    assert changes() == {"A.java": "added", "B.java": "added"} and changes() == {}
    (src / "A.java").write_text("class A { void v1() { } void v2() { } }")
    (src / "x/B.java").unlink()
    (src / "C.java").write_text("class C { }")
    assert changes() == {"A.java": "modified", "B.java": "deleted", "C.java": "added"}
    assert {r.name for r in B.facts(spark.read.parquet(index)).methods.collect()} == {"v1", "v2"}
    watched, mark = str(tmp_path / "watched"), str(tmp_path / "mark")
    watch(spark, str(src), watched, mark).awaitTermination()
    assert spark.read.parquet(watched).count() == 2
    (src / "D.java").write_text("class D { }")
    watch(spark, str(src), watched, mark).awaitTermination()
    assert spark.read.parquet(watched).count() == 3
    assert java_files(spark, [str(src)], ("**/A.java",)).count() == 2 and java_files(spark, [str(tmp_path / "none")]).count() == 0
