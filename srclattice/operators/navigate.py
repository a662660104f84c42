"""Overview, listings and everything about a class, for all classes in one job.

Each operator answers for the whole code base; a single class is a filter on the result,
which Catalyst pushes down to the facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts.model import Facts, complexity, joined, loc
from ..functions.names import parameter_types

VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "ALL", "Path": "ALL", "GET": "GET", "POST": "POST", "PUT": "PUT", "DELETE": "DELETE"}
SCHEDULED, LISTENERS = ("Scheduled",), ("EventListener", "KafkaListener", "RabbitListener", "JmsListener", "SqsListener")


def named(df: DataFrame, name: str, column: str = "class") -> DataFrame:
    return df.where(F.col(column) == name)


def overview(f: Facts) -> DataFrame:
    """One row: files, classes, interfaces, methods, packages."""
    t = f.types.agg(F.countDistinct("path").alias("files"), F.count_if(~F.col("is_interface")).alias("classes"), F.count_if("is_interface").alias("interfaces"), F.countDistinct(F.when(F.col("package") != "", F.col("package"))).alias("packages"))
    return t.crossJoin(f.methods.agg(F.count("*").alias("methods")))  # two rows of one line each


def classes_ranked(f: Facts, k: int | None = 50) -> DataFrame:
    """Types by how many different methods call their members; the k first, all if k is None."""
    calls = f.edges.groupBy("callee_class").agg(F.countDistinct("caller_class", "caller").alias("callers"))
    t = f.types.join(calls, F.col("name") == F.col("callee_class"), "left").select("qualified", "kind", "start_line", "end_line", F.coalesce("callers", F.lit(0)).alias("callers"))
    return t if k is None else t.orderBy(F.desc("callers"), "qualified").limit(k)


def packages(f: Facts) -> DataFrame:
    """Classes, methods and the number of other packages used, by package."""
    of = f.types.select(F.col("name").alias("class"), F.coalesce(F.nullif("package", F.lit("")), F.lit("(default)")).alias("package"))
    m = f.methods.join(of, "class").groupBy("package").agg(F.count("*").alias("methods"))
    used = package_deps(f).groupBy("package").agg(F.count("*").alias("depends_on"))
    c = of.groupBy("package").agg(F.count("*").alias("classes"))
    return c.join(m, "package", "left").join(used, "package", "left").fillna(0, ["methods", "depends_on"])


def package_deps(f: Facts) -> DataFrame:
    """(package, target, imports): imports of one known package by another."""
    of = f.types.select(F.col("name").alias("class"), "package")
    known = f.types.select(F.col("package").alias("target")).distinct()
    to = F.regexp_replace("import", r"\.[^.]*$", "")
    return f.imports.join(of, "class").select("package", to.alias("target")).join(known, "target").where("package != target").groupBy("package", "target").agg(F.count("*").alias("imports"))


def summary(f: Facts, top: int = 20) -> DataFrame:
    """Of each type the methods that most others call (name:callers, in order)."""
    calls = f.edges.groupBy(F.col("callee_class").alias("class"), F.col("callee").alias("name")).agg(F.countDistinct("caller_class", "caller").alias("n"))
    order = Window.partitionBy("class").orderBy(F.desc("n"), "name")
    m = f.methods.select("class", "name").distinct().join(calls, ["class", "name"], "left").fillna(0, ["n"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    listed = m.groupBy("class").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name", "n"))), lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), ",").alias("methods"))
    return f.types.join(listed, F.col("name") == F.col("class"), "left").select("qualified", "kind", "super_class", F.coalesce("methods", F.lit("")).alias("methods"))


def mini(f: Facts, fields: int = 3, deps: int = 5, methods: int = 5) -> DataFrame:
    """A type in one row: how many members, the signatures that most others call (then the longest), first fields, first types it calls, callers from other types."""
    out = f.edges.where("caller_class != callee_class")
    by = out.select(F.col("callee_class").alias("c"), "caller_class").repartition("c").distinct().groupBy("c").agg(F.count("caller_class").alias("called_by"))
    uses = out.groupBy(F.col("caller_class").alias("c")).agg(F.array_join(F.slice(F.sort_array(F.collect_set("callee_class")), 1, deps), ",").alias("deps"))
    fld = f.fields.groupBy(F.col("class").alias("c")).agg(F.array_join(F.slice(F.sort_array(F.collect_set(F.concat("name", F.lit(":"), "type"))), 1, fields), ",").alias("fields"))
    cnt = f.methods.groupBy(F.col("class").alias("c")).agg(F.count("*").alias("methods"))
    # calls are counted by class and come to the class's methods as one map, so methods are shuffled once
    calls = f.edges.select(F.col("callee_class").alias("class"), F.col("callee").alias("name"), "caller_class", "caller").where("name is not null and caller_class is not null and caller is not null")
    calls = calls.repartition("class").distinct().groupBy("class", "name").agg(F.count("*").alias("n")).groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("of"))
    order = Window.partitionBy("class").orderBy(F.desc("n"), F.desc(F.col("end_line") - F.col("start_line")), "name", "signature")
    key = f.methods.join(calls, "class", "left").withColumn("n", F.coalesce(F.col("of")[F.col("name")], F.lit(0))).drop("of").withColumn("r", F.row_number().over(order)).where(F.col("r") <= methods)
    key = key.groupBy(F.col("class").alias("c")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "signature"))), lambda x: x["signature"]), "; ").alias("key_methods"))
    t = f.types.select(F.col("name").alias("c"), "qualified")
    for x in (cnt, key, fld, uses, by):
        t = t.join(x, "c", "left")
    return t.fillna(0, ["methods", "called_by"]).fillna("", ["key_methods", "fields", "deps"]).drop("c")


def hierarchy(f: Facts) -> DataFrame:
    """Super class, interfaces, direct subclasses and implementors of each type."""
    bare = F.regexp_replace("super_class", "<.*$", "")
    subs = f.types.where("super_class != ''").groupBy(F.substring_index(bare, ".", -1).alias("name")).agg(joined("name").alias("subclasses"))
    ifs = f.implements.groupBy(F.col("class").alias("name")).agg(joined("interface").alias("interfaces"))
    impl = implementors(f).groupBy(F.col("interface").alias("name")).agg(joined("class").alias("implementors"))
    t = f.types.select("name", "qualified", "super_class", "is_interface")
    for x in (ifs, subs, impl):
        t = t.join(x, "name", "left")
    return t.select("qualified", "super_class", *[F.coalesce(c, F.lit("")).alias(c) for c in ("interfaces", "subclasses")], F.when(F.col("is_interface"), F.coalesce("implementors", F.lit(""))).otherwise("").alias("implementors"))


def implementors(f: Facts) -> DataFrame:
    """(interface, class); the interface by simple name, without generics; it need not be in the code base."""
    return f.implements.select(F.substring_index(F.regexp_replace("interface", "<.*$", ""), ".", -1).alias("interface"), "class").distinct()


def constructor_types(f: Facts) -> DataFrame:
    """(class, type): what the constructors of each class take."""
    made = f.methods.where(F.col("name").isin("<init>") | (F.col("name") == F.col("class")))
    return made.select("class", F.explode(parameter_types(F.col("signature"))).alias("type")).select("class", F.substring_index("type", ".", -1).alias("type")).distinct()


def dependencies(f: Facts) -> DataFrame:
    """Imports, field types and constructor parameter types of each class, libraries of the platform left out."""
    platform = F.col("import").rlike(r"^(java|javax|jakarta|org\.slf4j|org\.apache\.commons)\.")
    imp = f.imports.where(~platform).groupBy("class").agg(joined("import").alias("imports"))
    fld = f.fields.groupBy("class").agg(joined("type").alias("field_types"))
    made = constructor_types(f).groupBy("class").agg(joined("type").alias("ctor_types"))
    return imp.join(fld, "class", "full").join(made, "class", "full").fillna("", ["imports", "field_types", "ctor_types"])


def dependents(f: Facts) -> DataFrame:
    """(target, class, how): who imports a type, or else has a field of it, or else takes it in a constructor."""
    names = f.types.select(F.col("name").alias("target"))
    imp = f.imports.select(F.substring_index("import", ".", -1).alias("target"), "class", F.lit(1).alias("o"))
    fld = f.fields.select(F.col("type").alias("target"), "class", F.lit(2).alias("o"))
    made = constructor_types(f).select(F.col("type").alias("target"), "class", F.lit(3).alias("o"))
    how = F.element_at(F.array(*map(F.lit, ("import", "field", "constructor"))), F.min("o"))
    return imp.unionByName(fld).unionByName(made).where("target != class").repartition("target").groupBy("target", "class").agg(how.alias("how")).join(names, "target", "left_semi")


def annotated(f: Facts, name: str) -> DataFrame:
    """Methods and types that carry the annotation."""
    return f.annotations.where(F.col("name") == name).select("class", F.coalesce("method", F.lit("")).alias("method"), "value").distinct()


def find_methods(f: Facts, name: str, in_class: str | None = None, params: int | None = None) -> DataFrame:
    """Methods by name, of a class (simple or qualified name), with that many parameters."""
    m = f.methods.where(F.col("name") == name)
    if in_class:
        m = m.where(F.col("class") == in_class.rsplit(".", 1)[-1])
    return (m if params is None else m.where(F.col("params") == params)).select("class", "name", "signature", "start_line").distinct()


def endpoints(f: Facts, annotations: tuple[str, ...] = ()) -> DataFrame:
    """(controller, method, verb, path) of each method with a mapping annotation; of the given ones only, if any, whose verb is their own name where it is not known."""
    known = {a: VERBS.get(a, a) for a in annotations} or VERBS
    verb = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    base = f.annotations.where("method is null and name in ('RequestMapping', 'Path')").groupBy("class").agg(F.min("value").alias("base"))
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), '^"|"$|^/+|/+$', "")
    path = F.concat(F.lit("/"), F.concat_ws("/", F.nullif(plain("base"), F.lit("")), F.nullif(plain("value"), F.lit(""))))
    return f.annotations.where(F.col("method").isNotNull() & verb[F.col("name")].isNotNull()).join(base, "class", "left").select(F.col("class").alias("controller"), "method", verb[F.col("name")].alias("verb"), path.alias("path"))


def entry_points(f: Facts) -> DataFrame:
    """(kind, class, method): rest, scheduled, listener, main."""
    a = f.annotations.where("method is not null")
    rest = endpoints(f).select(F.lit("rest").alias("kind"), F.col("controller").alias("class"), "method")
    sched = a.where(F.col("name").isin(*SCHEDULED)).select(F.lit("scheduled").alias("kind"), "class", "method")
    listen = a.where(F.col("name").isin(*LISTENERS)).select(F.lit("listener").alias("kind"), "class", "method")
    by_interface = f.methods.join(f.implements.where("interface rlike 'Listener(<.*)?$'"), "class").where(F.col("name").startswith("on")).select(F.lit("listener").alias("kind"), "class", F.col("name").alias("method"))
    main = f.methods.where("name = 'main' and params = 1").select(F.lit("main").alias("kind"), "class", F.col("name").alias("method"))
    return rest.unionByName(sched).unionByName(listen).unionByName(by_interface).unionByName(main).distinct()


def glob_regex(glob: str) -> str:
    """A layer's glob as a regular expression over names: ** is anything, * anything within a segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*[./])?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^.]*", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".$+()[]{}^|?\\" else glob[i]), i + 1
    return f"^(?:{out})$"


def layer(f: Facts, glob: str) -> DataFrame:
    r = glob_regex(glob)
    return f.types.where(F.col("qualified").rlike(r) | F.col("name").rlike(r)).select("qualified", "kind")


def method_complexity(f: Facts) -> DataFrame:
    """Length, complexity and fan-in and fan-out of each method."""
    out = f.edges.groupBy(F.col("caller_class").alias("class"), F.col("caller").alias("name")).agg(F.countDistinct("callee_class", "callee").alias("fan_out"))
    into = f.edges.groupBy(F.col("callee_class").alias("class"), F.col("callee").alias("name")).agg(F.countDistinct("caller_class", "caller").alias("fan_in"))
    m = f.methods.select("class", "name", loc().alias("loc"), complexity().alias("complexity"))
    return m.join(out, ["class", "name"], "left").join(into, ["class", "name"], "left").fillna(0, ["fan_out", "fan_in"])


def complexity_top(f: Facts, k: int = 30) -> DataFrame:
    return f.methods.select("class", "name", loc().alias("loc"), complexity().alias("complexity")).orderBy(F.desc("complexity"), F.desc("loc"), "class", "name").limit(k)


def class_complexity(f: Facts) -> DataFrame:
    """Sums by class; coupling and the effort of a change as low, medium or high."""
    c = method_complexity(f).groupBy("class").agg(F.sum("complexity").alias("complexity"), F.sum("fan_out").alias("fan_out"), F.count("*").alias("methods"))
    mean = F.col("complexity") / F.col("methods")
    bucket = lambda hi, mid: F.when(hi, "high").when(mid, "medium").otherwise("low")
    return c.select("class", "complexity", "fan_out", "methods", bucket(F.col("fan_out") > 30, F.col("fan_out") > 10).alias("coupling"), bucket((mean > 10) | (F.col("fan_out") > 30), (mean > 5) | (F.col("fan_out") > 10)).alias("effort"))
