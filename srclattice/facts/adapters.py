"""Facts from relational tables: parts are types, line items calls between them.

It gives every operator a large code base to run on, and the same facts in SQL (FACTS_SQL).
"""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .model import Facts

#: Sources that one task makes, at most.
SOURCES = 5_000
_VERB = {0: "get", 1: "set", 2: "find", 3: "save", 4: "delete", 5: "is"}
_VERB_SQL = "case " + " ".join(f"when {{0}} % 6 = {k} then '{v}'" for k, v in _VERB.items()) + " end"
_NOTE = {"1-URGENT": "GetMapping", "2-HIGH": "PostMapping", "3-MEDIUM": "Scheduled", "4-NOT SPECIFIED": "Autowired", "5-LOW": "Deprecated"}


def from_tables(spark: SparkSession, sf_dir: str) -> Facts:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    P = lambda c: F.concat(F.lit("P"), c.cast("string"))
    key = F.col("p_partkey")
    package = F.concat(F.lower("p_type"), F.lit("."), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    part = t("part")
    types = part.select(
        P(key).alias("name"), package.alias("package"), F.concat(package, F.lit("."), P(key)).alias("qualified"), F.when(F.col("p_size") % 10 == 0, "interface").otherwise("class").alias("kind"),
        (F.col("p_size") % 10 == 0).alias("is_interface"), (F.col("p_size") % 10 == 1).alias("is_abstract"), F.when(key > 0, P(F.floor(key / 10))).otherwise("").alias("super_class"),
        F.concat(F.when(F.col("p_size") % 7 == 0, "src/test/").otherwise("src/main/"), F.replace(package, F.lit("."), F.lit("/")), F.lit("/"), P(key), F.lit(".java")).alias("path"),
        F.lit(1).alias("start_line"), (F.col("p_size") + 1).cast("int").alias("end_line"),
    )
    item = t("lineitem")
    # what must be distinct or meet is so by numbers; names are made of them at the end. A lookup in an array is code
    # small enough for the JVM to compile, which a chain of conditions for each name is not
    name = lambda c: F.concat(F.get(F.array(*map(F.lit, _VERB.values())), (F.col(c) % 6).cast("int")), F.lit("S"), F.col(c).cast("string"))
    named = lambda c: F.when(c % 6 >= 0, c)  # noqa: E731 - NULL where the name is
    result = F.when(F.col("l_suppkey") % 6 == 1, "void").otherwise(P(F.col("l_suppkey")))
    start = F.min("l_linenumber").cast("int") * 3
    methods = (
        item.groupBy("l_partkey", "l_suppkey")
        .agg(F.min("l_linenumber").cast("int").alias("params"), start.alias("start_line"), (start + F.max("l_quantity").cast("int")).alias("end_line"))
        .select(
            P(F.col("l_partkey")).alias("class"), name("l_suppkey").alias("name"), "params", result.alias("return_type"), F.concat(F.lit("public "), result, F.lit(" "), name("l_suppkey"), F.lit("()")).alias("signature"),
            (F.col("l_suppkey") % 4 != 0).alias("is_public"), F.concat(F.lit("src/"), P(F.col("l_partkey")), F.lit(".java")).alias("path"), "start_line", "end_line",
        )
    )
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    calls = item.select("l_partkey", "l_suppkey", F.lead("l_partkey").over(order).alias("to_part"), F.lead("l_suppkey").over(order).alias("to_supp"), F.row_number().over(order).alias("line")).where("to_part is not null")
    edges = calls.select("l_partkey", named(F.col("l_suppkey")).alias("l_suppkey"), "to_part", named(F.col("to_supp")).alias("to_supp"), "line").distinct()
    edges = edges.select(P(F.col("l_partkey")).alias("caller_class"), name("l_suppkey").alias("caller"), F.lit(-1).alias("caller_params"), P(F.col("to_part")).alias("callee_class"), name("to_supp").alias("callee"), F.lit(-1).alias("callee_params"), "line")
    nations = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("n_name").alias("name")).distinct()
    fields = item.select("l_partkey", "l_suppkey").distinct().join(nations, F.col("l_suppkey") == F.col("s_suppkey")).select(P(F.col("l_partkey")).alias("class"), "name", P(F.col("l_suppkey") * 3).alias("type"))
    implements = part.select(P(key).alias("class"), P((key * 7) % 1000).alias("interface")).where("class != interface")
    note = F.create_map(*[F.lit(x) for kv in _NOTE.items() for x in kv])[F.col("o_orderpriority")]
    orders = t("orders").select("o_orderkey", note.alias("note"), F.concat(F.lit("/"), F.lower("o_orderstatus")).alias("value"))
    touched = item.where("l_suppkey % 3 = 0").select("l_orderkey", "l_partkey", named(F.col("l_suppkey")).alias("l_suppkey"))
    touched = touched.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "l_suppkey", "note", "value").distinct()
    annotations = touched.select(P(F.col("l_partkey")).alias("class"), name("l_suppkey").alias("method"), F.col("note").alias("name"), "value")
    annotations = annotations.unionByName(part.where("p_size % 5 = 0").select(P(key).alias("class"), F.lit(None).cast("string").alias("method"), F.lit("Service").alias("name"), F.lit("").alias("value")))
    # one exchange, by the type that is called, serves for distinct pairs and for the join
    used = calls.where("l_partkey != to_part").select("l_partkey", "to_part").repartition("to_part").distinct()
    imports = used.join(part.select(F.col("p_partkey").alias("to_part"), F.concat(package, F.lit("."), P(key)).alias("import")), "to_part").select(P(F.col("l_partkey")).alias("class"), "import")
    return Facts(types, methods, fields, edges, implements, annotations, imports)


_P = "'P' || cast({} as varchar)".format
FACTS_SQL = f"""
types as (select {_P('p_partkey')} as name, lower(p_type) || '.' || lower(replace(p_brand, '#', '')) as package, lower(p_type) || '.' || lower(replace(p_brand, '#', '')) || '.P' || p_partkey as qualified,
  case when p_size % 10 = 0 then 'interface' else 'class' end kind, p_size % 10 = 0 as is_interface, p_size % 10 = 1 as is_abstract, case when p_partkey > 0 then {_P('cast(floor(p_partkey / 10) as bigint)')} else '' end super_class,
  case when p_size % 7 = 0 then 'src/test/' else 'src/main/' end || replace(lower(p_type) || '.' || lower(replace(p_brand, '#', '')), '.', '/') || '/P' || p_partkey || '.java' as path, 1 as start_line, p_size + 1 as end_line from part),
items as (select *, {_VERB_SQL.format('l_suppkey')} || 'S' || l_suppkey as sname from lineitem),
methods as (select {_P('l_partkey')} as class, sname as name, min(l_linenumber)::int params, case when l_suppkey % 6 = 1 then 'void' else {_P('l_suppkey')} end return_type,
  'public ' || case when l_suppkey % 6 = 1 then 'void' else {_P('l_suppkey')} end || ' ' || sname || '()' as signature, l_suppkey % 4 <> 0 as is_public, min(l_linenumber)::int * 3 as start_line, min(l_linenumber)::int * 3 + trunc(max(l_quantity))::int as end_line from items group by l_partkey, l_suppkey, sname),
edges as (select distinct * from (select {_P('l_partkey')} as caller_class, sname as caller, {_P('lead(l_partkey) over w')} as callee_class, lead(sname) over w as callee, (row_number() over w)::int as line
  from items window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice)) where callee_class is not null),
fields as (select distinct {_P('l_partkey')} as class, lower(n_name) as name, {_P('l_suppkey * 3')} as type from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
implements as (select {_P('p_partkey')} as class, {_P('(p_partkey * 7) % 1000')} as interface from part where p_partkey <> (p_partkey * 7) % 1000),
annotations as (select distinct {_P('l_partkey')} as class, sname as method, case o_orderpriority {' '.join(f"when '{k}' then '{v}'" for k, v in _NOTE.items())} end as name, '/' || lower(o_orderstatus) as value
  from items join orders on l_orderkey = o_orderkey where l_suppkey % 3 = 0 union all select {_P('p_partkey')}, null, 'Service', '' from part where p_size % 5 = 0),
imports as (select distinct caller_class as class, qualified as import from edges join types on types.name = callee_class where caller_class <> callee_class)
"""


def java_sources(spark: SparkSession, sf_dir: str):
    """(path, content): a Java source for each part, whose contents follow from the part's columns.

    The parts of many sources fit one split of a file, so they are dealt out first: no task makes, and parses, more than a few thousand.
    """
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    p = p.repartition(max(spark.sparkContext.defaultParallelism, -(-p.count() // SOURCES)))
    p = p.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"), F.lower(F.replace("p_type", F.lit(" "), F.lit(""))).alias("t"))
    k, z = F.col("k").cast("string"), F.col("z")
    when = lambda c, s: F.when(c, s).otherwise(F.lit(""))
    up = F.concat(F.lit(" extends P"), F.floor(F.col("k") / 10).cast("string"))
    text = F.concat(
        F.lit("package a."), "t", F.lit(";\n// class Hidden { }\n@Service\npublic class P"), k, when(F.col("k") > 0, up), F.lit(" implements Runnable {\n  private P"), F.floor(F.col("k") / 10).cast("string"), F.lit(" up;\n"),
        F.lit("  public P"), F.floor(F.col("k") / 10).cast("string"), F.lit(" parent() { return up; }\n  @Override public void run() { String s = \"class X {\"; up.parent().run(); go("), z.cast("string"), F.lit("); }\n"),
        F.lit("  void go(int n) {\n    try { up.run(); } catch (Exception e) {"), when(z % 3 == 0, F.lit(" return; ")), when(z % 3 == 1, F.lit(" throw e; ")), F.lit("}\n"),
        when(z % 4 == 0, F.lit("    switch (n) { case 1: break; }\n")), when(z % 5 == 0, F.lit("    if (n > 1) { }\n")), F.lit("  }\n}\n"),
    )
    return p.select(F.concat(F.lit("src/P"), k, F.lit(".java")).alias("path"), text.alias("content"))
