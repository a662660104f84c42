"""python -m srclattice.cli: index a tree of Java sources and ask about it.

Exit codes: 0 found, 1 nothing found, 2 wrong usage, 3 failure. Commands that look for
problems exit with 0 when there are none.
"""

from __future__ import annotations

import argparse
import difflib
import json
import re
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import build as B
from .functions import render
from .functions.names import parse_ref
from .operators import documents as D
from .operators import graph as G
from .operators import navigate as V
from .operators import rules as R
from .operators import text as T
from .session import session, ship
from .sources import files as S


def _targets(f, ref: str) -> DataFrame:
    r = parse_ref(ref)
    m = f.methods.where(F.col("name") == r.name)
    m = m if r.cls is None else m.where(F.col("class") == r.cls.rsplit(".", 1)[-1])
    return m if r.types is None else m.where(F.col("params") == len(r.types))


def _simple(ref: str) -> tuple[str, str | None]:
    r = parse_ref(ref)
    return r.name, r.cls and r.cls.rsplit(".", 1)[-1]


def _stop(globs: list[str]) -> str | None:
    """A regular expression of the names at which chains stop; * stands for any letters."""
    return f"^(?:{'|'.join('.*'.join(re.escape(x) for x in g.split('*')) for g in globs)})$" if globs else None


#: command: (what it needs, what it does, query of (facts, context, argument))
COMMANDS = {
    "overview": ("", "counts", lambda f, c, a: V.overview(f)),
    "classes": ("", "types by callers", lambda f, c, a: V.classes_ranked(f, None if c["full"] else 50)),
    "packages": ("", "packages and their dependencies", lambda f, c, a: V.packages(f)),
    "search": ("pattern", "lines with a|b, in comments or not", lambda f, c, a: T.search_code(c["files"], f, a)),
    "find": ("text", "types by concept", lambda f, c, a: T.find(f, T.tokens(a))),
    "scope": ("words", "types by keywords", lambda f, c, a: T.scope(f, T.tokens(a, 3))),
    "map": ("", "the most called types", lambda f, c, a: T.repo_map(f)),
    "method": ("method", "methods by name", lambda f, c, a: _targets(f, a)),
    "summary": ("class", "a type and its methods", lambda f, c, a: V.summary(f).where(F.substring_index("qualified", ".", -1) == a.rsplit(".", 1)[-1])),
    "mini": ("class", "a type in a line", lambda f, c, a: V.mini(f).where(F.substring_index("qualified", ".", -1) == a.rsplit(".", 1)[-1])),
    "deps": ("class", "what a type depends on", lambda f, c, a: V.named(V.dependencies(f), a)),
    "imports": ("class", "who depends on a type", lambda f, c, a: V.named(V.dependents(f), a, "target")),
    "hierarchy": ("class", "super and sub types", lambda f, c, a: V.hierarchy(f).where(F.substring_index("qualified", ".", -1) == a.rsplit(".", 1)[-1])),
    "implements": ("interface", "implementors", lambda f, c, a: V.named(V.implementors(f), a, "interface")),
    "annotations": ("name", "what carries an annotation", lambda f, c, a: V.annotated(f, a)),
    "related": ("class", "related types", lambda f, c, a: V.named(G.related(f), a)),
    "smells": ("[class]", "findings", lambda f, c, a: B.smells(c["parsed"]).where(F.lit(True) if not a else (F.col("class") == a) | (F.col("method") == a))),
    "stats": ("class", "size, complexity, coupling, depth", lambda f, c, a: V.named(V.class_complexity(f).join(G.inheritance_depth(f), "class", "left"), a)),
    "similar": ("class", "similar types", lambda f, c, a: T.similar(f).where((F.col("a") == a) | (F.col("b") == a))),
    "unused": ("", "methods that nobody calls", lambda f, c, a: G.unused_methods(f)),
    "unused-types": ("", "types that nobody uses", lambda f, c, a: G.unused_types(f)),
    "hotspots": ("", "most called types", lambda f, c, a: G.hotspots(f)),
    "callers": ("method", "direct callers", lambda f, c, a: G.callers(f, *_simple(a))),
    "callees": ("method", "direct callees", lambda f, c, a: G.callees(f, *_simple(a))),
    "call-chain": ("method", "all paths to a method", lambda f, c, a: G.call_chains(f, _targets(f, a), stop=c["stop"])),
    "mermaid": ("method", "diagrams of the paths", lambda f, c, a: G.mermaid(G.call_chains(f, _targets(f, a), stop=c["stop"]))),
    "impact": ("method", "classes that a change reaches", lambda f, c, a: G.impact(f, _targets(f, a))),
    "test-for": ("method", "tests to run", lambda f, c, a: G.tests_for(f, _targets(f, a))),
    "validate": ("method", "does it exist, else the closest", lambda f, c, a: T.validate(f, c["spark"].createDataFrame([(_simple(a)[1] or "", _simple(a)[0])], "class string, name string"))),
    "type-check": ("method", "return type", lambda f, c, a: T.type_check(f, c["spark"].createDataFrame([(_simple(a)[1] or "", _simple(a)[0])], "class string, name string"))),
    "lint": ("[class]", "unknown types, dead methods", lambda f, c, a: R.lint(f) if not a else V.named(R.lint(f), a)),
    "style": ("", "conventions", lambda f, c, a: T.style(f)),
    "patterns": ("", "layers of names", lambda f, c, a: T.layer_chains(f)),
    "check": ("", "constructor injection and internal imports", lambda f, c, a: R.constructor_injection(f).unionByName(R.internal_import(f))),
    "layer": ("glob", "types of a layer", lambda f, c, a: V.layer(f, a)),
    "endpoints": ("", "REST endpoints", lambda f, c, a: V.endpoints(f)),
    "entry-points": ("", "where calls begin", lambda f, c, a: V.entry_points(f)),
    "verify": ("spec.md", "against a specification", lambda f, c, a: R.verify(f, S.spec(c["spark"], a))),
    "breaking-changes": ("class", "who extends or implements", lambda f, c, a: V.named(G.breaking_changes(f), a)),
    "complexity": ("class", "per method", lambda f, c, a: V.named(V.method_complexity(f), a)),
    "complexity-all": ("", "the most complex methods", lambda f, c, a: V.complexity_top(f)),
    "explain": ("class", "a type in a sentence", lambda f, c, a: D.explain(f).where(F.substring_index("qualified", ".", -1) == a.rsplit(".", 1)[-1])),
    "context": ("class", "everything about a type", lambda f, c, a: D.context(f, B.smells(c["parsed"])).where((F.col("name") == a) | (F.col("qualified") == a))),
    "contract": ("class", "the signatures of a type", lambda f, c, a: V.named(f.methods, a).select("name", "signature", "start_line")),
    "read": ("class[.method]", "source lines", lambda f, c, a: D.read(f, c["files"], *a.split("#", 1))),
    "checklist": ("method", "steps of a change", lambda f, c, a: D.checklist(f, _targets(f, a))),
    "context-for": ("task", "which commands to run", lambda f, c, a: c["spark"].createDataFrame(D.plan(a) or [("", 0)], "command string, tokens int")),
    "resolve": ("Class.var.method", "through a field to a method", lambda f, c, a: R.resolve(f, c["spark"].createDataFrame([tuple(a.split(".")[-3:])], "class string, var string, name string"))),
    "drift": ("", "violations, and files that changed since the index", lambda f, c, a: R.constructor_injection(f).unionByName(R.internal_import(f)).unionByName(c["changes"].select(F.lit("changed").alias("rule"), F.col("path").alias("class"), F.col("change").alias("what")))),
    "diff": ("", "files that changed since the index", lambda f, c, a: c["changes"]),
    "snippet": ("suffix", "the class to imitate", lambda f, c, a: T.snippet_pick(f, a, a)),
    "changed": ("[ref]", "changed files", lambda f, c, a: S.git_changed(c["spark"], c["root"], a or "HEAD")),
    "diff-impact": ("[ref]", "what the changed files reach", lambda f, c, a: G.diff_impact(f, S.git_changed(c["spark"], c["root"], a or "HEAD"))),
    "history": ("file", "commits of a file", lambda f, c, a: R.history(S.git_log(c["spark"], c["root"], a))),
    "index": ("", "bring the index up to date", lambda f, c, a: c["changes"]),
}
PROBLEMS = {"verify", "check", "drift", "diff", "lint", "smells", "index"}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="srclattice", description=__doc__)
    p.add_argument("command")
    p.add_argument("argument", nargs="?", default="")
    p.add_argument("--root", default=".")
    p.add_argument("--index", default=None, help="folder of the index; default ROOT/.srclattice/index")
    p.add_argument("--config", default=None)
    for flag in ("json", "md", "full", "no-test", "metrics"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--fields", default="")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if a.command == "describe":
        print("\n".join(f"{k} {n}".ljust(28) + d for k, (n, d, _) in COMMANDS.items()))
        return 0
    if a.command not in COMMANDS:
        near = difflib.get_close_matches(a.command, COMMANDS, 1)
        print(f"unknown command {a.command}" + (f"; {near[0]}?" if near else ""), file=sys.stderr)
        return 2
    need, _, run = COMMANDS[a.command]
    if need and not need.startswith("[") and not a.argument:
        print(f"{a.command} needs {need}", file=sys.stderr)
        return 2
    began = time.time()
    try:
        spark = ship(session())
        cfg = S.config(a.config or f"{a.root}/.srclattice.yaml")
        files = S.java_files(spark, [f"{a.root}/{r}" for r in cfg["source_roots"]], tuple(cfg["excludes"]))
        index = a.index or f"{a.root}/.srclattice/index"
        changes = B.refresh(spark, files, index)
        parsed = spark.read.schema(B.PARSED).parquet(index)
        invokers = {i["method"]: (i.get("resolveClass", "").capitalize(), tuple(i.get("callerSuffixes") or [""])) for i in cfg["invokers"]}
        f = B.facts(parsed, invokers)
        f = f.without_tests() if a.no_test else f
        out = run(f, {"spark": spark, "files": files, "parsed": parsed, "changes": changes, "root": a.root, "full": a.full, "stop": _stop(cfg["chain_stop_methods"])}, a.argument)
        out = render.fields(out, a.fields.split(",")) if a.fields else out
        if a.md:
            print(render.markdown(out))
            n = out.limit(1).count()
        else:
            rows = [r[0] for r in (render.json_rows(out) if a.full else render.json_rows(out.limit(51))).collect()]
            if not a.full and len(rows) > 50:
                rows = rows[:50]
                print(f"50 of {out.count()} rows; --full prints all", file=sys.stderr)
            print("\n".join(rows) if a.json or rows else "nothing found")
            n = len(rows)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001 - the boundary of the program
        print(f"failed: {e}", file=sys.stderr)
        return 3
    if a.metrics:
        print(json.dumps({"command": a.command, "seconds": round(time.time() - began, 3), "results": n}), file=sys.stderr)
    return 0 if n or a.command in PROBLEMS else 1


if __name__ == "__main__":
    sys.exit(main())
