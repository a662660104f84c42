"""Architecture rules, lint, specifications, differences between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts.model import Facts, joined
from .navigate import constructor_types, glob_regex

JDK = "String Integer Long Short Byte Boolean Character Double Float Object int long short byte boolean char double float void List Map Set Collection Optional Date BigDecimal BigInteger UUID Instant LocalDate LocalDateTime Duration Class Thread Runnable".split()


def _in(f: Facts, layer: str | dict | None) -> DataFrame:
    """The types of a layer: a glob, or {pattern, annotations} of which either will do; None is all of them."""
    if layer is None:
        return f.types
    layer = {"pattern": layer} if isinstance(layer, str) else layer
    found = f.types.where(F.lit(False))
    if layer.get("pattern"):
        r = glob_regex(layer["pattern"])
        found = f.types.where(F.col("qualified").rlike(r) | F.col("name").rlike(r))
    if layer.get("annotations"):
        has = f.annotations.where(F.col("method").isNull() & F.col("name").isin(*layer["annotations"])).select(F.col("class").alias("name"))
        found = found.unionByName(f.types.join(has, "name", "left_semi").select(*f.types.columns)).distinct()
    return found


def deny_import(f: Facts, rule: str, source: str | dict, target: str | dict) -> DataFrame:
    """(rule, class, what): types of layer source that import, or have a field of, a type of layer target."""
    of = _in(f, source).select(F.col("name").alias("class"))
    no = _in(f, target).select("qualified", F.col("name").alias("denied"))
    imp = f.imports.join(no, F.col("import") == F.col("qualified")).select("class", F.concat(F.lit("import "), "denied").alias("what"))
    fld = f.fields.join(no, F.col("type") == F.col("denied")).select("class", F.concat(F.lit("field "), "denied").alias("what"))
    return imp.unionByName(fld).distinct().join(of, "class", "left_semi").select(F.lit(rule).alias("rule"), "class", "what")


def constructor_injection(f: Facts, rule: str = "constructor-injection", layer: str | dict | None = None) -> DataFrame:
    """Classes (of a layer) with fields whose constructor takes nothing."""
    t = _in(f, layer).where("not is_interface").select(F.col("name").alias("class"))
    return t.join(f.fields, "class", "left_semi").join(constructor_types(f), "class", "left_anti").select(F.lit(rule).alias("rule"), "class", F.lit("fields without constructor parameters").alias("what"))


def deny_annotation(f: Facts, rule: str, source: str | dict, annotation: str) -> DataFrame:
    of = _in(f, source).select(F.col("name").alias("class"))
    a = f.annotations.where(F.col("name") == annotation).select("class", F.concat(F.lit("@"), "name", F.lit(" on "), F.coalesce("method", "class")).alias("what")).distinct()
    return a.join(of, "class", "left_semi").select(F.lit(rule).alias("rule"), "class", "what")


def configured(f: Facts, config: dict, only: str | None = None) -> DataFrame:
    """(rule, class, what) of the configured rules, or of one; a layer that is not configured has no types."""
    layers = {x.get("name"): x for x in config.get("layers") or []}
    of = lambda name: layers.get(name, {})
    out = f.types.where(F.lit(False)).select(F.lit("").alias("rule"), F.col("name").alias("class"), F.lit("").alias("what"))
    for r in config.get("rules") or []:
        name, layer = r.get("id") or "", r.get("layer") or r.get("from")
        if only not in (None, name):
            continue
        if r.get("denyImport"):
            out = out.unionByName(deny_import(f, name, of(r.get("from")), of(r["denyImport"])))
        if r.get("require") == "constructor-injection" and layer:
            out = out.unionByName(constructor_injection(f, name, of(layer)))
        if r.get("denyAnnotation") and layer:
            out = out.unionByName(deny_annotation(f, name, of(layer), r["denyAnnotation"]))
    return out


def layers(f: Facts, config: dict, only: str | None = None) -> DataFrame:
    """(layer, qualified): the types of each configured layer, or of one."""
    out = f.types.where(F.lit(False)).select(F.lit("").alias("layer"), "qualified")
    for x in config.get("layers") or []:
        if only in (None, x.get("name")):
            out = out.unionByName(_in(f, x).select(F.lit(x.get("name")).alias("layer"), "qualified"))
    return out


def internal_import(f: Facts, marker: str = ".internal.") -> DataFrame:
    """Imports of another package's internals."""
    own = f.types.select(F.col("name").alias("class"), "package")
    i = f.imports.where(F.contains("import", F.lit(marker))).join(own, "class")
    outside = ~F.startswith(F.col("import"), F.concat(F.substring_index(F.col("package"), ".internal", 1), F.lit(".")))
    return i.where(outside).select(F.lit("internal-import").alias("rule"), "class", F.concat(F.lit("import "), "import").alias("what")).distinct()


def lint(f: Facts) -> DataFrame:
    """(class, problem, what): field types that are unknown or, where the class has imports, may not be imported; and methods that are not public and never called."""
    known = f.types.select(F.col("name").alias("type")).unionByName(f.imports.select(F.substring_index("import", ".", -1).alias("type"))).distinct()
    bare = f.fields.select("class", F.regexp_replace(F.regexp_replace("type", "<.*$", ""), r"\[\]", "").alias("type")).where(~F.col("type").isin(*JDK)).distinct()
    odd = bare.join(known, "type", "left_anti").select("class", F.lit("unknown type").alias("problem"), F.col("type").alias("what"))
    used = f.edges.select(F.col("callee_class").alias("class"), F.col("callee").alias("name"))
    dead = f.methods.where("not is_public").select("class", "name").distinct().join(used, ["class", "name"], "left_anti").select("class", F.lit("never called").alias("problem"), F.col("name").alias("what"))
    here = bare.join(f.types.select(F.col("name").alias("class"), "package").distinct(), "class").join(f.imports.select("class").distinct(), "class", "left_semi")
    own = f.imports.select("class", F.substring_index("import", ".", -1).alias("type"))
    beside = f.types.select("package", F.col("name").alias("type")).distinct()
    maybe = here.join(own, ["class", "type"], "left_anti").join(beside, ["package", "type"], "left_anti").join(known, "type", "left_anti")
    return odd.unionByName(maybe.select("class", F.lit("maybe not imported").alias("problem"), F.col("type").alias("what")).distinct()).unionByName(dead)


def _shape(signature):
    """A signature's parameters as they stand, and how many they are; commas between < and > do not count."""
    inside = F.regexp_extract(signature, r"\((.*)\)", 1)
    flat = inside
    for _ in range(4):
        flat = F.regexp_replace(flat, "<[^<>]*>", "")
    return F.regexp_replace(inside, r"\s+", " "), F.when(F.trim(flat) == "", 0).otherwise(F.size(F.split(flat, ",")))


def verify(f: Facts, spec: DataFrame) -> DataFrame:
    """(class, name, problem): methods that spec has and the code lacks, or the other way round; spec has (class, name).

    Where spec also has (signature, throws, annotations), the result has the column expected too, and a row for each
    exception or annotation that a method lacks. Of overloads, the one with the specification's parameters counts, else one with
    as many, else the first. Annotations are facts by name, so for them all overloads are one method.
    """
    detailed = {"signature", "throws", "annotations"} <= set(spec.columns)
    if not detailed:
        have = f.methods.select("class", "name").distinct()
        want = spec.select("class", "name").distinct()
        gone = want.join(have, ["class", "name"], "left_anti").withColumn("problem", F.lit("missing_method"))
        extra = have.join(want.select("class").distinct(), "class", "left_semi").join(want, ["class", "name"], "left_anti").withColumn("problem", F.lit("undocumented_method"))
        return gone.unionByName(extra)
    # the code, the specification and the annotations of a method meet in one row: each is shuffled once
    by = ["class", "name"]
    code = f.methods.groupBy(*by).agg(F.collect_list(F.struct("start_line", F.col("signature").alias("has"))).alias("code"))
    asked = spec.select(*by, F.struct(F.coalesce("signature", F.lit("")).alias("signature"), "throws", "annotations").alias("s")).groupBy(*by).agg(F.collect_set("s").alias("specs"))
    on = f.annotations.where("method is not null").select("class", F.col("method").alias("name"), F.col("name").alias("on")).groupBy(*by).agg(F.collect_set("on").alias("on"))
    met = asked.join(on, by, "left").join(code, by, "full")
    none = F.array().cast("array<string>")
    lacking = lambda s, has: F.coalesce(F.array_except(s["throws"], F.split(F.regexp_extract(has, r"\) throws (.*)$", 1), ", ")), none)

    def best(s):
        text, n = _shape(s["signature"])
        rated = F.transform("code", lambda c: F.struct((_shape(c["has"])[0] != text).alias("t"), (_shape(c["has"])[1] != n).alias("n"), c["start_line"].alias("l"), c["has"].alias("has")))
        return F.array_min(rated)["has"]

    single = (F.size("specs") == 1) & (F.size("code") == 1)
    throws = F.when(single, lacking(F.get("specs", F.lit(0)), F.get("code", F.lit(0))["has"])).otherwise(F.flatten(F.transform("specs", lambda s: lacking(s, best(s)))))
    notes = F.array_except(F.flatten(F.transform("specs", lambda s: F.coalesce(s["annotations"], none))), F.coalesce("on", none))
    problem = lambda what, xs: F.transform(xs, lambda x: F.struct(F.lit(what).alias("problem"), x.alias("expected")))
    gone = problem("missing_method", F.array(F.lit(None).cast("string")))
    of = F.when(F.col("code").isNull(), gone).otherwise(F.concat(problem("missing_throws", F.array_distinct(throws)), problem("missing_annotation", notes)))
    found = met.where("specs is not null").select(*by, F.explode(of).alias("x")).select(*by, "x.problem", "x.expected")
    extra = met.where("specs is null").select(*by).join(spec.select("class").distinct(), "class", "left_semi")
    return found.unionByName(extra.select(*by, F.lit("undocumented_method").alias("problem"), F.lit(None).cast("string").alias("expected")))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, deleted or modified, by content hash; both have (path, hash)."""
    both = old.select("path", F.col("hash").alias("h0")).join(new.select("path", F.col("hash").alias("h1")), "path", "full")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when(F.col("h0") != F.col("h1"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def history(commits: DataFrame, subjects: int = 5) -> DataFrame:
    """(path, commits, authors, last, subjects); commits has (path, sha, author, at, subject)."""
    newest = F.slice(F.sort_array(F.collect_list(F.struct("at", "sha", "subject")), False), 1, subjects)
    return commits.groupBy("path").agg(F.count("*").alias("commits"), joined("author").alias("authors"), F.max("at").alias("last"), F.array_join(F.transform(newest, lambda x: x["subject"]), ",").alias("subjects"))


def resolve(f: Facts, asked: DataFrame) -> DataFrame:
    """(class, var, name) to the method's signature and return type, through the type of the field var ('this' is the class)."""
    fld = f.fields.groupBy("class", F.col("name").alias("var")).agg(F.min("type").alias("type"))
    t = asked.join(fld, ["class", "var"], "left").withColumn("owner", F.when(F.col("var") == "this", F.col("class")).otherwise(F.col("type")))
    m = f.methods.groupBy(F.col("class").alias("owner"), "name").agg(F.min_by("signature", F.struct("start_line", "signature")).alias("signature"), F.min_by("return_type", F.struct("start_line", "signature")).alias("return_type"))
    return t.join(m, ["owner", "name"], "left").select("class", "var", "name", "owner", "signature", "return_type")
