"""The call graph: neighbours, reach, chains and what a change would touch.

Reach is found level by level for all seeds at once; every level is a join and a table in the
shared folder, so lineage stays short and a lost executor costs one level at most. Only nodes
with several ways in are looked up among what was reached before. Methods are numbers
there: hashes, of which it is checked first that no two names have the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts.model import Facts, is_test, joined
from ..session import Levels
from .navigate import constructor_types

UTILITY = ("String", "List", "Map", "Set", "Optional", "Integer", "Long", "Boolean", "Object", "Logger", "Collection", "StringBuilder")
#: So many rows, counted first, go to all executors for a join.
FEW = 100_000
OBJECT_METHODS = ("toString", "equals", "hashCode", "getClass", "notify", "notifyAll", "wait", "clone", "finalize")


def calls(f: Facts) -> DataFrame:
    """Distinct (caller_class, caller, callee_class, callee)."""
    return f.edges.select("caller_class", "caller", "callee_class", "callee").distinct()


def callers(f: Facts, name: str, in_class: str | None = None) -> DataFrame:
    e = f.edges.where(F.col("callee") == name)
    e = e if in_class is None else e.where(F.col("callee_class") == in_class)
    return e.select("caller_class", "caller", "callee_class", "line").distinct()


def callees(f: Facts, name: str, in_class: str | None = None) -> DataFrame:
    e = f.edges.where(F.col("caller") == name)
    e = e if in_class is None else e.where(F.col("caller_class") == in_class)
    return e.select("caller_class", "callee_class", "callee", "line").distinct()


def degrees(f: Facts) -> DataFrame:
    """(class, method, fan_in, fan_out) of every method that calls or is called."""
    both = calls(f)
    a = both.select(F.col("callee_class").alias("class"), F.col("callee").alias("method"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    b = both.select(F.col("caller_class").alias("class"), F.col("caller").alias("method"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    return a.unionByName(b).groupBy("class", "method").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def roots(f: Facts) -> DataFrame:
    """Methods that call and are not called."""
    return degrees(f).where("fan_in = 0").select("class", "method")


def hotspots(f: Facts, k: int = 30) -> DataFrame:
    """The k types whose methods have the most callers."""
    return calls(f).where("callee_class != '?'").groupBy(F.col("callee_class").alias("class")).agg(F.count("*").alias("callers")).orderBy(F.desc("callers"), "class").limit(k)


def unused_methods(f: Facts, ignore: tuple[str, ...] = ("main", "<init>")) -> DataFrame:
    used = f.edges.select(F.col("callee_class").alias("class"), F.col("callee").alias("name"))
    return f.methods.where(~F.col("name").isin(*ignore)).select("class", "name").distinct().join(used, ["class", "name"], "left_anti")


def unused_types(f: Facts) -> DataFrame:
    """Types that nobody imports, has a field of or takes in a constructor, and interfaces that nobody implements: (name, why)."""
    seen = f.imports.select(F.substring_index("import", ".", -1).alias("name")).unionByName(f.fields.select(F.col("type").alias("name"))).unionByName(constructor_types(f).select(F.col("type").alias("name")))
    lone = f.types.where("not is_interface and name != 'App'").select("name").join(seen, "name", "left_anti").withColumn("why", F.lit("unreferenced"))
    have = f.implements.select(F.substring_index(F.regexp_replace("interface", "<.*$", ""), ".", -1).alias("name"))
    bare = f.types.where("is_interface").select("name").join(have, "name", "left_anti").withColumn("why", F.lit("unimplemented"))
    return lone.unionByName(bare)


def related(f: Facts, k: int = 15) -> DataFrame:
    """For each type the k others with the highest score: field 3, each method called or calling 2, same package 1."""
    fld = f.fields.select("class", F.col("type").alias("other"), F.lit(3).alias("s")).distinct()
    e = calls(f).where("caller_class != callee_class")
    out = e.select(F.col("caller_class").alias("class"), F.col("callee_class").alias("other"), "callee").distinct().select("class", "other", F.lit(2).alias("s"))
    into = e.select(F.col("callee_class").alias("class"), F.col("caller_class").alias("other"), "caller").distinct().select("class", "other", F.lit(2).alias("s"))
    s = fld.unionByName(out).unionByName(into).where((F.col("class") != F.col("other")) & ~F.col("other").isin(*UTILITY) & (F.col("other") != "?")).groupBy("class", "other").agg(F.sum("s").alias("score"))
    of = f.types.select("name", "package").distinct()
    s = s.join(of.toDF("class", "cp"), "class", "left").join(of.toDF("other", "op"), "other", "left").withColumn("score", F.col("score") + F.coalesce((F.col("cp") == F.col("op")).cast("int"), F.lit(0))).groupBy("class", "other").agg(F.max("score").alias("score"))
    # types that have only the package in common come after all others, so of each package no more than the first k + 1 by name can be among the k
    first = of.where(~F.col("name").isin(*UTILITY)).withColumn("r", F.row_number().over(Window.partitionBy("package").orderBy("name"))).where(F.col("r") <= k + 1).select(F.col("name").alias("other"), "package")
    beside = of.withColumnRenamed("name", "class").join(first, "package").where("class != other").select("class", "other").distinct().join(s, ["class", "other"], "left_anti").withColumn("score", F.lit(1).cast("bigint"))
    order = Window.partitionBy("class").orderBy(F.desc("score"), "other")
    return s.unionByName(beside).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reach(pairs: DataFrame, seeds: DataFrame, max_depth: int, own=None) -> DataFrame:
    """(seed, node, depth): what each seed reaches over pairs (src, dst), by its least depth; seeds has (seed, node).

    Further columns of pairs, which must follow from dst, come along (NULL at depth 0). own: a condition on them, seed and node
    that holds where a node is among those that the seed begins with; without it they are looked up.
    A node with one way in is reached once if the node before it is, so only those with several
    ways are made distinct and compared with what was reached before.
    """
    more = [c for c in pairs.columns if c not in ("src", "dst")]
    levels = Levels(pairs.sparkSession, "reach")
    nothing = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in more]
    frontier = levels.add(seeds.select("seed", "node").distinct().select("seed", "node", *nothing, F.lit(0).alias("depth"), F.lit(False).alias("again")))
    seen, n = [] if own is not None else levels.paths[:1], frontier.count()
    p = pairs.where("src != dst").repartition("dst").distinct().withColumn("again", F.count("*").over(Window.partitionBy("dst")) > 1)
    if own is None:
        p = p.join(frontier.select(F.col("node").alias("dst"), F.lit(True).alias("start")).distinct(), "dst", "left").withColumn("again", F.col("again") | F.coalesce("start", F.lit(False)))
    p = Levels(pairs.sparkSession, "pairs").add(p.select("src", "dst", *more, "again"))
    for depth in range(1, max_depth + 1):
        near = frontier.select("seed", F.col("node").alias("src"))
        step = p.join(F.broadcast(near) if n <= FEW else near, "src").select("seed", F.col("dst").alias("node"), *more, F.lit(depth).alias("depth"), "again")
        step = levels.add(step if own is None else step.where(~own))
        n, several = step.where("not again").count(), step.where("again")
        frontier = step.where("not again")
        if not several.isEmpty():
            fresh = several.distinct().withColumn("again", F.lit(False))
            fresh = levels.add(fresh.join(levels.read(seen).select("seed", "node"), ["seed", "node"], "left_anti") if seen else fresh)
            seen = seen + levels.paths[-1:]
            frontier, n = frontier.unionByName(fresh), n + fresh.count()
        if n == 0:
            break
    return levels.read(levels.paths).where("not again").select("seed", "node", "depth", *more)


def numbering(*names: DataFrame):
    """A function that makes a number of a name, another one for each name of these tables of one column."""
    all_ = names[0].toDF("name")
    for x in names[1:]:
        all_ = all_.unionByName(x.toDF("name"))
    for salt in range(64):
        number = lambda c, salt=salt: F.xxhash64(F.lit(salt), c)
        twice = all_.select(number(F.col("name")).alias("n"), F.xxhash64(F.lit(-1 - salt), "name").alias("other")).groupBy("n").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
        if twice.where("lo != hi").isEmpty():
            return number
    raise ArithmeticError("no numbering without repeats found")


def _method(c: str, m: str):
    return F.concat_ws(".", F.col(c), F.col(m))


def back_edges(f: Facts) -> DataFrame:
    """(src, dst): from each method to its callers, as class.method."""
    return f.edges.select(_method("callee_class", "callee").alias("src"), _method("caller_class", "caller").alias("dst")).distinct()


def risk(n, low: int, medium: int):
    return F.when(n == 0, "none").when(n <= low, "low").when(n <= medium, "medium").otherwise("high")


def _class(node):
    return F.substring_index(node, ".", 1)


def _numbered(f: Facts, *names: DataFrame):
    """The numbering of all methods in calls and of the names, and the pairs of back_edges in it with c, the number of the class of dst (NULL if unknown), and sc, that of src."""
    back = f.edges.select(_method("callee_class", "callee").alias("src"), _method("caller_class", "caller").alias("dst"))
    number = numbering(back.select("src"), back.select("dst"), back.select(_class("src")), back.select(_class("dst")), *names)
    c = _class(F.col("dst"))
    return number, back.select(number(F.col("src")).alias("src"), number(F.col("dst")).alias("dst"), F.when(c != "?", number(c)).alias("c"), number(_class(F.col("src"))).alias("sc"))


def impact(f: Facts, targets: DataFrame | None = None, max_depth: int = 30) -> DataFrame:
    """(target, direct, transitive, risk): classes that call each method, directly and through others; targets has (class, name)."""
    targets = f.methods if targets is None else targets
    t = targets.select(_method("class", "name").alias("target"))
    number, pairs = _numbered(f, t)
    t = t.withColumn("seed", number(F.col("target"))).repartition("seed").distinct()
    found = reach(pairs.drop("sc"), t.select("seed", F.col("seed").alias("node")), max_depth, own=F.col("seed") == F.col("node")).where("depth > 0 and c is not null")
    counts = found.select("seed", "c", "depth").repartition("seed").groupBy("seed", "c").agg(F.min("depth").alias("depth")).groupBy("seed").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("transitive"))
    return t.join(counts, "seed", "left").fillna(0, ["direct", "transitive"]).select("target", "direct", "transitive", risk(F.col("transitive"), 3, 10).alias("risk"))


def tests_for(f: Facts, targets: DataFrame, max_depth: int = 1) -> DataFrame:
    """(target, test, confidence): by name (high), by calls (high, medium, low with distance), by import (medium); the best of each.

    What imports say of a class holds for all its methods, so it is joined to them as an array, and nothing is shuffled by target and test.
    """
    tests = f.types.where(is_test(F.col("path"))).select(F.col("name").alias("test")).distinct()
    t = targets.select(_method("class", "name").alias("target"), F.col("class").alias("tc"))
    number, pairs = _numbered(f, t.select("target"), tests)
    t = t.withColumn("seed", number(F.col("target"))).repartition("seed").distinct()
    known = tests.withColumn("c", number(F.col("test")))
    ends = known.withColumn("tc", F.regexp_extract("test", "^(.*?)(?:Tests?|IT)$", 1)).where("test rlike '(Tests?|IT)$'").select("tc", "test")
    byname = t.join(ends, "tc").select("seed", "test", F.lit(0).alias("level"))
    through = pairs.join(known.select(F.col("c").alias("sc")), "sc", "left_anti").select("src", "dst", "c")  # not beyond tests
    near = reach(through, t.select("seed", F.col("seed").alias("node")), max_depth + 1, own=F.col("seed") == F.col("node")).where("depth > 0")
    bycall = near.join(known, "c").select("seed", "test", F.least(F.col("depth") - 1, F.lit(2)).alias("level"))
    found = bycall.unionByName(byname).repartition("seed").groupBy("seed", "test").agg(F.min("level").alias("level")).groupBy("seed").agg(F.collect_list(F.struct("test", "level")).alias("xs"))
    imp = f.imports.select(F.substring_index("import", ".", -1).alias("tc"), F.col("class").alias("test")).join(tests, "test", "left_semi").groupBy("tc").agg(F.collect_set("test").alias("ts"))
    both = t.join(found, "seed", "left").join(imp, "tc", "left").where("xs is not null or ts is not null")
    xs, ts = F.coalesce("xs", F.array().cast("array<struct<test:string,level:int>>")), F.coalesce("ts", F.array().cast("array<string>"))
    kept = F.filter(xs, lambda x: (x["level"] <= 1) | ~F.array_contains(F.col("ts"), x["test"]))
    both = both.select("target", xs.alias("xs"), ts.alias("ts")).select("target", kept.alias("xs"), "ts")
    beside = F.filter("ts", lambda x: ~F.exists("xs", lambda y: y["test"] == x))
    each = F.concat("xs", F.transform(beside, lambda x: F.struct(x.alias("test"), F.lit(1).alias("level"))))
    each = both.select("target", F.explode(each).alias("x")).select("target", "x.test", "x.level")
    return each.select("target", "test", F.when(F.col("level") == 0, "high").when(F.col("level") == 1, "medium").otherwise("low").alias("confidence"))


def call_chains(f: Facts, targets: DataFrame, max_depth: int = 20, stop: str | None = None) -> DataFrame:
    """(target, chain, steps): all simple paths of calls from where they begin down to each target.

    A path grows by callers that are not on it yet; it ends where there is none, after max_depth
    steps, or at a method whose name matches the regular expression stop. Callers come as arrays of no more than a path is
    long, each with whether it has callers itself: so a level is one join, and a path whose end is known is not taken on.
    """
    most = max_depth + 1
    back = f.edges.select(_method("callee_class", "callee").alias("src"), _method("caller_class", "caller").alias("dst"))
    back = back.repartition("src").distinct()
    called = back.select(F.col("src").alias("dst"), F.lit(True).alias("more")).distinct()
    by = Window.partitionBy("src")
    back = back.join(called, "dst", "left").withColumns({"i": F.floor((F.row_number().over(by.orderBy("dst")) - 1) / most), "deg": F.count("*").over(by)})
    to = F.struct(F.col("dst").alias("m"), F.coalesce("more", F.lit(False)).alias("more"))
    back = Levels(f.edges.sparkSession, "callers").add(back.groupBy("src", "i").agg(F.collect_list(to).alias("tos"), F.max("deg").alias("deg")).drop("i"))
    levels = Levels(f.edges.sparkSession, "chains")
    paths = levels.add(targets.select(_method("class", "name").alias("m")).distinct().select(F.array("m").alias("path"), F.lit(False).alias("over")))
    for depth in range(1, max_depth + 1):
        n = paths.count()
        if n == 0:
            break
        last = paths.select("path", F.element_at("path", -1).alias("src"))
        grown = back.join(F.broadcast(last) if n <= FEW else last, "src")
        fresh = F.filter("tos", lambda x: ~F.array_contains(F.col("path"), x["m"]))
        grown = grown.select("path", "deg", F.explode_outer(fresh).alias("to")).where(F.col("to").isNotNull() | (F.col("deg") <= most))
        halted = ~F.col("to.more") if stop is None else ~F.col("to.more") | F.substring_index("to.m", ".", -1).rlike(stop)
        ended = F.col("to").isNull() | F.lit(depth == max_depth) | halted
        grown = grown.select(F.when(F.col("to").isNull(), F.col("path")).otherwise(F.concat("path", F.array("to.m"))).alias("path"), ended.alias("over"))
        paths = levels.add(grown).where("not over")
    done = levels.read(levels.paths).where(F.col("over") & (F.size("path") > 1))
    return done.select(F.col("path")[0].alias("target"), F.array_join(F.reverse("path"), " -> ").alias("chain"), (F.size("path") - 1).alias("steps"))


def chain_stats(chains: DataFrame) -> DataFrame:
    return chains.groupBy("target").agg(F.count("*").alias("chains"), F.max("steps").alias("deepest"), F.countDistinct(F.substring_index("chain", " -> ", 1)).alias("roots"))


def mermaid(chains: DataFrame) -> DataFrame:
    """(target, chain, diagram): a sequence diagram for each chain."""
    hops = F.split("chain", " -> ")
    cls, fn = lambda x: F.substring_index(x, ".", 1), lambda x: F.substring_index(x, ".", -1)
    seen = F.array_distinct(F.transform(hops, cls))
    who = F.transform(seen, lambda c: F.concat(F.lit("  participant "), c))
    arrows = F.transform(F.slice(hops, 2, F.size(hops)), lambda x, i: F.concat(F.lit("  "), cls(hops[i]), F.lit("->>"), cls(x), F.lit(": "), fn(x), F.lit("()")))
    return chains.select("target", "chain", F.array_join(F.concat(F.array(F.lit("sequenceDiagram")), who, arrows), "\n").alias("diagram"))


def inheritance_depth(f: Facts, bound: int = 64) -> DataFrame:
    """(class, depth): how many known super classes are above each type; a cycle ends at bound."""
    up = f.types.select(F.col("name").alias("src"), F.substring_index(F.regexp_replace("super_class", "<.*$", ""), ".", -1).alias("dst"))
    up = up.where("dst not in ('', 'Object')").join(f.types.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").distinct()
    names = f.types.select("name").distinct()
    return reach(up, names.select(F.col("name").alias("seed"), F.col("name").alias("node")), bound).groupBy(F.col("seed").alias("class")).agg(F.max("depth").alias("depth"))


def overridden(f: Facts) -> DataFrame:
    """(parent, child, methods): methods of a type that a direct subtype declares again; each type's names travel as one array, not once for each of its subtypes."""
    kin = f.types.select(F.substring_index(F.regexp_replace("super_class", "<.*$", ""), ".", -1).alias("parent"), F.col("name").alias("child")).where("parent != ''")
    kin = kin.unionByName(f.implements.select(F.substring_index(F.regexp_replace("interface", "<.*$", ""), ".", -1).alias("parent"), F.col("class").alias("child"))).distinct()
    m = f.methods.where("class is not null").groupBy("class").agg(F.collect_set("name").alias("names"))
    both = kin.join(m.toDF("parent", "up"), "parent").join(m.toDF("child", "down"), "child").where(F.arrays_overlap("up", "down"))
    return both.select("parent", "child", F.array_join(F.sort_array(F.array_intersect("up", "down")), ",").alias("methods"))


def breaking_changes(f: Facts) -> DataFrame:
    """(class, subclasses, implementors, overriding, conditions, risk) of each type that others extend or implement; conditions: what would break."""
    sub = f.types.where("super_class != ''").groupBy(F.substring_index(F.regexp_replace("super_class", "<.*$", ""), ".", -1).alias("class")).agg(F.countDistinct("name").alias("subclasses"))
    imp = f.implements.groupBy(F.substring_index(F.regexp_replace("interface", "<.*$", ""), ".", -1).alias("class")).agg(F.countDistinct("class").alias("implementors"))
    over = overridden(f).groupBy(F.col("parent").alias("class")).agg(F.count("*").alias("overriding"))
    kinds = f.types.groupBy(F.col("name").alias("class")).agg(F.max(F.col("is_interface") | F.col("is_abstract")).alias("open"))
    all_ = sub.join(imp, "class", "full").join(over, "class", "left").fillna(0).join(kinds, "class")
    what = F.concat_ws(
        "; ", F.when(F.col("subclasses") > 0, "signature changes break subclasses"), F.when(F.col("implementors") > 0, "added or removed methods break implementors"),
        F.when(F.col("open"), "a new abstract method must be written by all below"), F.when(F.col("overriding") > 0, "overridden signatures must change together"),
    )
    return all_.withColumn("conditions", what).drop("open").withColumn("risk", risk(F.col("subclasses") + F.col("implementors"), 3, 10))


def diff_impact(f: Facts, changed: DataFrame, max_depth: int = 30) -> DataFrame:
    """(class, caller_edges, affected, risk) of each changed file; changed has (path), the class is the file's stem."""
    stem = F.regexp_extract("path", r"([^/]+)\.java$", 1)
    c = changed.select(stem.alias("class")).where("class != ''").distinct()
    direct = f.edges.where("caller_class != callee_class").groupBy(F.col("callee_class").alias("class")).agg(F.count("*").alias("caller_edges"))
    members = c.join(f.methods, "class").select("class", _method("class", "name").alias("m"))
    number, pairs = _numbered(f, c, members.select("m"))
    c = c.withColumn("seed", number(F.col("class")))
    seeds = members.select(number(F.col("class")).alias("seed"), number(F.col("m")).alias("node")).distinct()
    pairs = pairs.drop("sc").join(seeds.groupBy(F.col("node").alias("dst")).agg(F.min("seed").alias("of")), "dst", "left")
    far = reach(pairs, seeds, max_depth, own=F.coalesce(F.col("of") == F.col("seed"), F.lit(False))).where("depth > 0 and c != seed")
    far = far.select("seed", "c").repartition("seed").distinct().groupBy("seed").agg(F.count("*").alias("affected"))
    return c.join(direct, "class", "left").join(far, "seed", "left").drop("seed").fillna(0).withColumn("risk", risk(F.col("caller_edges"), 5, 20))
