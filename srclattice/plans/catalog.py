"""Every query by name: how it runs on the facts of the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..facts import build as B
from ..facts.adapters import FACTS_SQL, from_tables, java_sources
from ..facts.model import Facts, Saved
from ..functions import names as N
from ..operators import documents as D
from ..operators import graph as G
from ..operators import navigate as V
from ..operators import rules as R
from ..operators import text as T
from ..session import own_folder, ship

_BACK = "back as (select distinct callee_class || '.' || callee as src, caller_class || '.' || caller as dst from edges)"
_CALLS = "calls as (select distinct caller_class, caller, callee_class, callee from edges)"
_ENDS = """ends as (select class as controller, method, case name when 'GetMapping' then 'GET' else 'POST' end verb, value as path from annotations where name in ('GetMapping', 'PostMapping') and method is not null)"""


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _snapshots(spark, sf_dir):
    """An index and what is on disk now: parts by name and brand against their sizes' parity."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    old = p.where("p_size % 9 != 0").select(path.alias("path"), F.sha2(F.concat("p_name", F.when(F.col("p_size") % 4 == 0, "x").otherwise("")), 256).alias("hash"))
    return old, p.where("p_size % 11 != 0").select(path.alias("path"), F.sha2("p_name", 256).alias("hash"))


def _commits(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("path"), F.format_string("%012d", F.col("o_orderkey")).alias("sha"), F.lower("o_orderpriority").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string")).alias("subject"))


def _with_constructors(f):
    """The facts, and for each class a constructor that takes a generic and an annotated parameter."""
    made = F.concat(F.lit("public "), "name", F.lit("(@Named(\"a, b\") final List<Map<String, "), F.nullif("super_class", F.lit("")), F.lit(">> all, "), "super_class", F.lit("... more)"))
    of = f.types.where("not is_interface and super_class != ''").select(F.col("name").alias("class"), "name", F.lit(2).alias("params"), F.lit("").alias("return_type"), made.alias("signature"), F.lit(True).alias("is_public"), "path", "start_line", F.col("start_line").alias("end_line"))
    return Facts(f.types, f.methods.unionByName(of), f.fields, f.edges, f.implements, f.annotations, f.imports)


def _throwing(f):
    """The facts, with exceptions that some methods throw."""
    m = f.methods.withColumn("signature", F.when(F.col("start_line") % 2 == 1, F.concat("signature", F.lit(" throws IOException, java.sql.SQLException"))).otherwise(F.col("signature")))
    return Facts(f.types, m, f.fields, f.edges, f.implements, f.annotations, f.imports)


def _strict_spec(f):
    return f.methods.select("class", "name", "signature", F.array(F.lit("IOException"), F.lit("TimeoutException")).alias("throws"), F.array(F.lit("Scheduled")).alias("annotations"))


#: A configuration as the command line reads it.
CONFIG = {
    "layers": [{"name": "economy", "pattern": "economy.**"}, {"name": "promo", "pattern": "promo.**"}, {"name": "services", "annotations": ["Service"]}],
    "rules": [{"id": "no-promo", "from": "economy", "denyImport": "promo"}, {"id": "inject", "require": "constructor-injection", "layer": "services"}, {"id": "no-scheduled", "from": "economy", "denyAnnotation": "Scheduled"}],
}


def _spec(f):
    return f.methods.where("start_line % 2 = 1").select("class", "name").unionByName(f.types.where("end_line % 5 = 0").select(F.col("name").alias("class"), F.lit("close").alias("name")))


def _asked(f):
    """Every method there is, and for each type one that is not."""
    return f.methods.select("class", "name").distinct().unionByName(f.types.select(F.col("name").alias("class"), F.lit("getS1x").alias("name")))


#: What was made of a folder of tables, by application and folder: facts and parsed files are built once and asked often.
_made: dict = {}


def _once(spark, sf_dir, kind, make):
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _made:
        _made[key] = make(own_folder(spark, kind))
    return _made[key]


def facts(spark, sf_dir):
    return _once(spark, sf_dir, "facts", lambda path: Saved(from_tables(ship(spark), sf_dir), path))


def _parsed(spark, sf_dir):
    def make(path):
        B.parsed(java_sources(spark, sf_dir)).write.parquet(path)
        return spark.read.schema(B.PARSED).parquet(path)

    return _once(spark, sf_dir, "parsed", make)


def _parsed_facts(spark, sf_dir):
    return _once(spark, sf_dir, "parsed-facts", lambda path: Saved(B.facts(_parsed(spark, sf_dir)), path))


_JAVA = "j as (select p_partkey k, p_size z, 'P' || p_partkey c, 'P' || cast(floor(p_partkey / 10) as bigint) u, 'a.' || lower(replace(p_type, ' ', '')) t from part)"


#: name: (query of (facts, spark, sf_dir), SQL after the facts)
CATALOG = {
    "overview": (lambda f, s, d: V.overview(f), "select (select count(distinct path) from types)::bigint files, (select count(*) from types where not is_interface)::bigint classes, (select count(*) from types where is_interface)::bigint interfaces, (select count(distinct package) from types)::bigint packages, (select count(*) from methods)::bigint methods"),
    "classes_ranked": (lambda f, s, d: V.classes_ranked(f), "select qualified, kind, start_line, end_line, coalesce(n, 0)::bigint callers from types left join (select callee_class c, count(distinct (caller_class, caller)) n from edges group by 1) on c = name order by callers desc, qualified limit 50"),
    "packages": (lambda f, s, d: V.packages(f), """of_ as (select name c, package p from types), dep as (select p, regexp_replace(import, '\\.[^.]*$', '') t from imports join of_ on c = class), d as (select p, count(distinct t) n from dep where p <> t group by p)
        select of_.p as package, count(*)::bigint classes, coalesce((select count(*) from methods join of_ o on o.c = class where o.p = of_.p), 0)::bigint methods, coalesce(max(d.n), 0)::bigint depends_on from of_ left join d on d.p = of_.p group by of_.p"""),
    "package_deps": (lambda f, s, d: V.package_deps(f), "select package, regexp_replace(import, '\\.[^.]*$', '') target, count(*)::bigint imports from imports join types on name = class where regexp_replace(import, '\\.[^.]*$', '') <> package group by 1, 2"),
    "class_summary": (lambda f, s, d: V.summary(f), """c as (select callee_class class, callee name, count(distinct (caller_class, caller)) n from edges group by 1, 2), m as (select class, name, coalesce(n, 0) n from (select distinct class, name from methods) left join c using (class, name)),
        r as (select *, row_number() over (partition by class order by n desc, name) r from m), g as (select class, string_agg(name || ':' || n, ',' order by r) methods from r where r <= 20 group by class)
        select qualified, kind, super_class, coalesce(methods, '') methods from types left join g on class = name"""),
    "mini": (lambda f, s, d: V.mini(f), """o as (select * from edges where caller_class <> callee_class), b as (select callee_class c, count(distinct caller_class) n from o group by 1),
        u as (select caller_class c, array_to_string(list_sort(list_distinct(list(callee_class)))[1:5], ',') deps from o group by 1), fl as (select class c, array_to_string(list_sort(list_distinct(list(name || ':' || type)))[1:3], ',') fields from fields group by 1), m as (select class c, count(*) n from methods group by 1)
        , cc as (select callee_class c, callee as name, count(distinct (caller_class, caller)) n from edges group by 1, 2), km as (select class c, signature, row_number() over (partition by class order by coalesce(n, 0) desc, end_line - start_line desc, methods.name, signature) r from methods left join cc on cc.c = class and cc.name = methods.name), kk as (select c, string_agg(signature, '; ' order by r) x from km where r <= 5 group by 1)
        select qualified, coalesce(m.n, 0)::bigint methods, coalesce(kk.x, '') key_methods, coalesce(fl.fields, '') fields, coalesce(u.deps, '') deps, coalesce(b.n, 0)::bigint called_by from types t left join b on b.c = t.name left join u on u.c = t.name left join fl on fl.c = t.name left join m on m.c = t.name left join kk on kk.c = t.name"""),
    "hierarchy": (lambda f, s, d: V.hierarchy(f), """su as (select super_class n, array_to_string(list_sort(list_distinct(list(name))), ',') x from types where super_class <> '' group by 1), i as (select class n, array_to_string(list_sort(list_distinct(list(interface))), ',') x from implements group by 1), m as (select interface n, array_to_string(list_sort(list_distinct(list(class))), ',') x from implements group by 1)
        select qualified, super_class, coalesce(i.x, '') interfaces, coalesce(su.x, '') subclasses, case when is_interface then coalesce(m.x, '') else '' end implementors from types t left join su on su.n = t.name left join i on i.n = t.name left join m on m.n = t.name"""),
    "implementors": (lambda f, s, d: V.implementors(f), "select distinct interface, class from implements"),
    "deps": (lambda f, s, d: V.dependencies(_with_constructors(f)), """i as (select class, string_agg(distinct import, ',' order by import) imports from imports group by 1), g as (select class, string_agg(distinct type, ',' order by type) field_types from fields group by 1), k as (select name as class, 'List,' || super_class ctor_types from types where not is_interface and super_class <> '')
        select class, coalesce(imports, '') imports, coalesce(field_types, '') field_types, coalesce(ctor_types, '') ctor_types from i full join g using (class) full join k using (class)"""),
    "imports_of": (lambda f, s, d: V.dependents(_with_constructors(f)), """x as (select split_part(import, '.', 3) target, class, 1 o, 'import' how from imports union all select type, class, 2, 'field' from fields union all select super_class, name, 3, 'constructor' from types where not is_interface and super_class <> '')
        select target, class, arg_min(how, o) how from x where target <> class and target in (select name from types) group by 1, 2"""),
    "annotations_of": (lambda f, s, d: V.annotated(f, "Autowired"), "select distinct class, coalesce(method, '') as method, value from annotations where name = 'Autowired'"),
    "method_search": (lambda f, s, d: V.find_methods(f, "setS1"), "select distinct class, name, signature, start_line from methods where name = 'setS1'"),
    "endpoints": (lambda f, s, d: V.endpoints(f), f"{_ENDS} select * from ends"),
    "entry_points": (lambda f, s, d: V.entry_points(f), f"{_ENDS} select distinct 'rest' kind, controller as class, method from ends union select 'scheduled', class, method from annotations where name = 'Scheduled' and method is not null"),
    "layer": (lambda f, s, d: V.layer(f, "economy.**"), "select qualified, kind from types where starts_with(qualified, 'economy.')"),
    "fan_in_out": (lambda f, s, d: V.method_complexity(f), """o as (select caller_class class, caller name, count(distinct (callee_class, callee)) n from edges group by 1, 2), i as (select callee_class class, callee name, count(distinct (caller_class, caller)) n from edges group by 1, 2)
        select m.class, m.name, end_line - start_line + 1 as loc, greatest(1, (end_line - start_line + 1) // 5)::int complexity, coalesce(o.n, 0)::bigint fan_out, coalesce(i.n, 0)::bigint fan_in from methods m left join o using (class, name) left join i using (class, name)"""),
    "complexity_top": (lambda f, s, d: V.complexity_top(f), "select class, name, end_line - start_line + 1 as loc, greatest(1, (end_line - start_line + 1) // 5)::int complexity from methods order by complexity desc, loc desc, class, name limit 30"),
    "class_stats": (lambda f, s, d: V.class_complexity(f), """o as (select caller_class class, caller name, count(distinct (callee_class, callee)) n from edges group by 1, 2), c as (select m.class, sum(greatest(1, (end_line - start_line + 1) // 5))::bigint complexity, coalesce(sum(o.n), 0)::bigint fan_out, count(*)::bigint methods from methods m left join o using (class, name) group by 1)
        select *, case when fan_out > 30 then 'high' when fan_out > 10 then 'medium' else 'low' end coupling, case when complexity / methods > 10 or fan_out > 30 then 'high' when complexity / methods > 5 or fan_out > 10 then 'medium' else 'low' end effort from c"""),
    "callers": (lambda f, s, d: G.callers(f, "setS1"), "select distinct caller_class, caller, callee_class, line from edges where callee = 'setS1'"),
    "callees": (lambda f, s, d: G.callees(f, "setS1"), "select distinct caller_class, callee_class, callee, line from edges where caller = 'setS1'"),
    "degrees": (lambda f, s, d: G.degrees(f), f"{_CALLS}, x as (select callee_class class, callee as method, 1 i, 0 o from calls union all select caller_class, caller, 0, 1 from calls) select class, method, sum(i)::bigint fan_in, sum(o)::bigint fan_out from x group by 1, 2"),
    "roots": (lambda f, s, d: G.roots(f), "select distinct caller_class as class, caller as method from edges e where not exists (select 1 from edges x where x.callee_class = e.caller_class and x.callee = e.caller)"),
    "hotspots": (lambda f, s, d: G.hotspots(f), f"{_CALLS} select callee_class class, count(*)::bigint callers from calls group by 1 order by callers desc, class limit 30"),
    "unused_methods": (lambda f, s, d: G.unused_methods(f), "select distinct class, name from methods m where not exists (select 1 from edges where callee_class = m.class and callee = m.name)"),
    "unused_types": (lambda f, s, d: G.unused_types(_with_constructors(f)), """select name, 'unreferenced' why from types where not is_interface and name not in (select split_part(import, '.', 3) from imports) and name not in (select type from fields) and name not in (select super_class from types where not is_interface)
        union all select name, 'unimplemented' from types where is_interface and name not in (select interface from implements)"""),
    "related": (lambda f, s, d: G.related(f), f"""{_CALLS}, e as (select * from calls where caller_class <> callee_class), x as (select distinct class, type as other, 3 s from fields union all select * from (select caller_class, callee_class, 2 from (select distinct caller_class, callee_class, callee from e)) union all select * from (select callee_class, caller_class, 2 from (select distinct callee_class, caller_class, caller from e))
            union all select a.name, b.name, 1 from types a join types b on a.package = b.package),
        g as (select class, other, sum(s)::bigint score from x where class <> other group by 1, 2), r as (select *, row_number() over (partition by class order by score desc, other)::int rank from g) select class, other, score, rank from r where rank <= 15"""),
    "impact": (lambda f, s, d: G.impact(f, None, 1000), f"""{_BACK}, r as (with recursive r(seed, node) as (select distinct class || '.' || name, class || '.' || name from methods union select seed, dst from r join back on src = node) select * from r),
        t as (select seed, count(distinct split_part(node, '.', 1)) n from r where seed <> node group by 1), q as (select src, count(distinct split_part(dst, '.', 1)) n from back where src <> dst group by 1)
        select class || '.' || name as target, coalesce(q.n, 0)::bigint direct, coalesce(t.n, 0)::bigint transitive, case when coalesce(t.n, 0) = 0 then 'none' when t.n <= 3 then 'low' when t.n <= 10 then 'medium' else 'high' end risk from methods left join t on seed = class || '.' || name left join q on src = class || '.' || name"""),
    "call_chains": (lambda f, s, d: G.call_chains(f, f.methods), f"""{_BACK}, p as (with recursive p(target, path, top) as (select distinct class || '.' || name, [class || '.' || name], class || '.' || name from methods union all select target, list_append(path, dst), dst from p join back on src = top and not list_contains(path, dst) where len(path) <= 20) select * from p)
        select target, array_to_string(list_reverse(path), ' -> ') chain, (len(path) - 1)::int steps from p where len(path) > 1 and (len(path) = 21 or not exists (select 1 from back where src = top and not list_contains(path, dst)))"""),
    "breaking_changes": (lambda f, s, d: G.breaking_changes(f), """su as (select super_class class, count(distinct name) n from types where super_class <> '' group by 1), im as (select interface class, count(distinct class) n from implements group by 1), k as (select super_class parent, name child from types where super_class <> '' union select interface, class from implements),
        o as (select parent class, count(distinct child) n from k join methods a on a.class = parent join methods b on b.class = child and b.name = a.name group by 1), x as (select class, coalesce(su.n, 0)::bigint subclasses, coalesce(im.n, 0)::bigint implementors from su full join im using (class))
        select x.class, subclasses, implementors, coalesce(o.n, 0)::bigint overriding, concat_ws('; ', case when subclasses > 0 then 'signature changes break subclasses' end, case when implementors > 0 then 'added or removed methods break implementors' end, case when is_interface or is_abstract then 'a new abstract method must be written by all below' end, case when o.n > 0 then 'overridden signatures must change together' end) conditions, case when subclasses + implementors = 0 then 'none' when subclasses + implementors <= 3 then 'low' when subclasses + implementors <= 10 then 'medium' else 'high' end risk from x left join o using (class) join types t on t.name = x.class"""),
    "overridden": (lambda f, s, d: G.overridden(f), """k as (select super_class parent, name child from types where super_class <> '' union select interface, class from implements)
        select parent, child, string_agg(distinct a.name, ',' order by a.name) methods from k join methods a on a.class = parent join methods b on b.class = child and b.name = a.name group by 1, 2"""),
    "inheritance_depth": (lambda f, s, d: G.inheritance_depth(f), """r as (with recursive r(class, node, depth) as (select name, name, 0 from types union all select class, super_class, depth + 1 from r join types on name = node where super_class in (select name from types) and depth < 64 and super_class <> node) select * from r) select class, max(depth)::int as depth from r group by 1"""),
    "tests_for": (lambda f, s, d: G.tests_for(f, f.methods), f"""{_BACK}, tests as (select name from types where contains(path, '/test/')), t as (select distinct class || '.' || name seed, class tc from methods),
        s1 as (select seed, dst node from t join back on src = seed where split_part(src, '.', 1) not in (select name from tests)), s2 as (select seed, dst from s1 join back on src = node where split_part(src, '.', 1) not in (select name from tests) and dst <> seed and (seed, dst) not in (select (seed, node) from s1)),
        x as (select seed, split_part(node, '.', 1) test, 0 lv from s1 where node <> seed union all select seed, split_part(dst, '.', 1), 1 from s2 union all select seed, class, 1 from t join imports on split_part(import, '.', 3) = tc),
        g as (select seed, test, min(lv) lv from x where test in (select name from tests) group by 1, 2) select seed as target, test, case lv when 0 then 'high' when 1 then 'medium' else 'low' end confidence from g"""),
    "diff_impact": (lambda f, s, d: G.diff_impact(f, f.types.select("path")), f"""{_BACK}, d as (select callee_class class, count(*) n from edges where caller_class <> callee_class group by 1), r as (with recursive r(seed, node, depth) as (select class, class || '.' || name, 0 from methods union select seed, dst, depth + 1 from r join back on src = node where depth < 30) select * from r),
        a as (select seed, count(distinct split_part(node, '.', 1)) n from r where depth > 0 and split_part(node, '.', 1) <> seed group by 1)
        select name as class, coalesce(d.n, 0)::bigint caller_edges, coalesce(a.n, 0)::bigint affected, case when coalesce(d.n, 0) = 0 then 'none' when d.n <= 5 then 'low' when d.n <= 20 then 'medium' else 'high' end risk from types left join d on d.class = name left join a on seed = name"""),
    "search_lines": (lambda f, s, d: T.search(T.source_lines(_documents(s, d).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))), "License|idiot").select("path", "line_no", "col", "word"), """l as (select doc_id::varchar as path, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), 1) as line_no from documents where length(text) > 0), x as (select *, instr(line, 'License') a, instr(line, 'idiot') b from l)
        select path, line_no::int as line_no, (case when a > 0 and (b = 0 or a < b) then a else b end)::int as col, case when a > 0 and (b = 0 or a < b) then 'License' else 'idiot' end word from x where a > 0 or b > 0"""),
    "find_concepts": (lambda f, s, d: T.find(f, ["delete", "economy"]), """m as (select class, list(lower(name)) ms from methods group by 1), x as (select qualified, case when contains(lower(qualified), 'delete') then 5 when len(list_filter(coalesce(ms, []), lambda n: contains(n, 'delete'))) > 0 then 3 else 0 end a, case when contains(lower(qualified), 'economy') then 5 when len(list_filter(coalesce(ms, []), lambda n: contains(n, 'economy'))) > 0 then 3 else 0 end b from types left join m on class = name)
        select qualified, (a + b)::int score from x where a > 0 and b > 0 order by score desc, qualified limit 15"""),
    "scope_keywords": (lambda f, s, d: T.scope(f, ["save", "germany", "brand1"]), """k as (select unnest(['save', 'germany', 'brand1']) w), t as (select name, qualified, sum(5 * contains(lower(name), w)::int + contains(lower(package), w)::int) s from types, k group by all), m as (select class, sum(3 * contains(lower(name), w)::int) s from methods, k group by 1), g as (select class, sum(2 * contains(lower(name), w)::int) s from fields, k group by 1)
        select qualified, (t.s + coalesce(m.s, 0) + coalesce(g.s, 0))::bigint score from t left join m on m.class = t.name left join g on g.class = t.name where t.s + coalesce(m.s, 0) + coalesce(g.s, 0) > 0 order by score desc, qualified limit 15"""),
    "repo_map_budget": (lambda f, s, d: T.repo_map(f), """e as (select callee_class class, count(distinct caller_class) n from edges where caller_class <> callee_class group by 1), m as (select class, signature, row_number() over (partition by class order by length(signature), signature) r from (select distinct class, signature from methods)), g as (select class, sum(length(signature) + 5) size, string_agg(signature, '; ' order by r) signatures from m where r <= 3 group by 1),
        t as (select name as class, coalesce(e.n, 0)::bigint callers, floor((20 + length(name) + length(package) + coalesce(size, 0)) / 4)::bigint tokens, coalesce(signatures, '') signatures from types left join e on e.class = name left join g on g.class = name), u as (select *, sum(tokens) over w as used, row_number() over w as r from t window w as (order by callers desc, class rows unbounded preceding))
        select class, callers, tokens, signatures from u where used <= 2000 or r = 1"""),
    "similar": (lambda f, s, d: T.similar(f), """m as (select distinct class, name from methods), i as (select distinct class, interface name from implements), mm as (select a.class a, b.class b, count(*) c from m a join m b on a.name = b.name and a.class < b.class group by 1, 2), ii as (select a.class a, b.class b, count(*) c from i a join i b on a.name = b.name and a.class < b.class group by 1, 2),
        ms as (select class, count(*) n from m group by 1), si as (select class, count(*) n from i group by 1), p as (select a, b, coalesce(mm.c, 0) cm, coalesce(ii.c, 0) ci from mm full join ii using (a, b)),
        q as (select a, b, 0.7::double * coalesce(cm::double / nullif(coalesce(x.n, 0) + coalesce(y.n, 0) - cm, 0), 0) + 0.3::double * coalesce(ci::double / nullif(greatest(coalesce(u.n, 0), coalesce(v.n, 0)), 0), 0) s from p left join ms x on x.class = a left join ms y on y.class = b left join si u on u.class = a left join si v on v.class = b)
        select a, b, floor(s * 100 + 0.5)::bigint score from q where s >= 0.3::double"""),
    "validate": (lambda f, s, d: T.validate(f, _asked(f), 5), """k as (select distinct class, name from methods), asked as (select * from k union all select name, 'getS1x' from types), no as (select distinct * from asked where (class, name) not in (select (class, name) from k)), nn as (select distinct name n2 from k), ask as (select distinct name from no),
        sc as (select name, n2, greatest(case when name = n2 then 100 else 0 end, case when levenshtein(lower(name), lower(n2)) <= 3 then 80 - 10 * levenshtein(lower(name), lower(n2)) else 0 end, case when starts_with(lower(name), lower(n2)) or starts_with(lower(n2), lower(name)) then 60 else 0 end, case when contains(lower(name), lower(n2)) or contains(lower(n2), lower(name)) then 40 else 0 end) score from ask, nn),
        best as (select sc.name, k.class || '.' || n2 suggestion, score, row_number() over (partition by sc.name order by score desc, k.class || '.' || n2) rank from sc join k on k.name = n2 where score > 0)
        select asked.class, asked.name, no.name is null as "exists", rank::int rank, suggestion, score::int score from asked left join no on no.class = asked.class and no.name = asked.name left join (select * from best where rank <= 5) b on b.name = no.name"""),
    "type_check": (lambda f, s, d: T.type_check(f, _asked(f)), """k as (select distinct class, name from methods), asked as (select * from k union all select name, 'getS1x' from types), m as (select class, name, arg_min(return_type, (start_line, signature)) return_type from methods group by 1, 2) select asked.class, asked.name, return_type, return_type = 'void' as is_void from asked left join m on m.class = asked.class and m.name = asked.name"""),
    "prefix_top": (lambda f, s, d: T.prefixes(f), "x as (select regexp_extract(name, '^(get|set|is|find|save|delete|create|update|has|build)[A-Z]', 1) prefix from methods) select prefix, count(*)::bigint n from x where prefix <> '' group by 1 order by n desc, prefix limit 5"),
    "annotation_top": (lambda f, s, d: T.annotation_counts(f), "select name, count(*)::bigint n from annotations group by 1 order by n desc, name limit 10"),
    "style_counts": (lambda f, s, d: T.style(f), """select 0::bigint slf4j, 0::bigint log4j, 0::bigint jul, 0::bigint optional_imports, (select count(*) from types) as types, (select count(*) from types where is_interface) interfaces, (select count(*) from types where is_abstract) abstract, 0::bigint exceptions, (select count(*) from methods) as methods, 0::bigint optional_returns,
        (select count(*) from methods where return_type = 'void') void, (select count(*) from methods where not is_public) not_public, (select count(*) from fields) as fields, 0::bigint collections, 0::bigint field_injection"""),
    "snippet_pick": (lambda f, s, d: T.snippet_pick(f, "7", "Service"), """t as (select name as class, (select count(*) from annotations a where a.class = t.name and a.name = 'Service' and method is null) > 0 as h, (select count(distinct caller_class) from edges e where e.callee_class = t.name and caller_class <> t.name) callers, (select count(*) from methods m where m.class = t.name) as methods from types t where name like '%7')
        select class, h::int as has, callers::bigint callers, methods::bigint methods from t order by has desc, callers desc, methods desc, class limit 1"""),
    "check_deny_import": (lambda f, s, d: R.deny_import(f, "no-promo", "economy.**", "promo.**"), """o as (select name from types where starts_with(qualified, 'economy.')), n as (select qualified, name from types where starts_with(qualified, 'promo.'))
        select 'no-promo' as rule, class, 'import ' || n.name what from imports join n on import = n.qualified where class in (select name from o) union select 'no-promo', class, 'field ' || n.name from fields join n on type = n.name where class in (select name from o)"""),
    "check_ctor_injection": (lambda f, s, d: R.constructor_injection(f), "select 'constructor-injection' as rule, name as class, 'fields without constructor parameters' what from types where not is_interface and name in (select class from fields)"),
    "check_deny_annotation": (lambda f, s, d: R.deny_annotation(f, "no-scheduled", "economy.**", "Scheduled"), "select distinct 'no-scheduled' as rule, class, '@Scheduled on ' || coalesce(method, class) what from annotations where name = 'Scheduled' and class in (select name from types where starts_with(qualified, 'economy.'))"),
    "check_configured": (lambda f, s, d: R.configured(f, CONFIG), """o as (select name from types where starts_with(qualified, 'economy.')), n as (select qualified, name from types where starts_with(qualified, 'promo.')), v as (select name from types where name in (select class from annotations where name = 'Service' and method is null))
        select 'no-promo' as rule, class, 'import ' || n.name what from imports join n on import = n.qualified where class in (select name from o) union select 'no-promo', class, 'field ' || n.name from fields join n on type = n.name where class in (select name from o)
        union select 'inject', name, 'fields without constructor parameters' from types where not is_interface and name in (select class from fields) and name in (select name from v)
        union select 'no-scheduled', class, '@Scheduled on ' || coalesce(method, class) from annotations where name = 'Scheduled' and class in (select name from o)"""),
    "layers": (lambda f, s, d: R.layers(f, CONFIG), """select 'economy' as layer, qualified from types where starts_with(qualified, 'economy.') union all select 'promo', qualified from types where starts_with(qualified, 'promo.') union all select 'services', qualified from types where name in (select class from annotations where name = 'Service' and method is null)"""),
    "verify_strict": (lambda f, s, d: R.verify(_throwing(f), _strict_spec(f)), """e as (select distinct class, name, start_line % 2 = 1 as t from methods), h as (select distinct class, name from methods)
        select class, name, 'missing_throws' problem, unnest(case when t then ['TimeoutException'] else ['IOException', 'TimeoutException'] end) expected from e
        union all select class, name, 'missing_annotation', 'Scheduled' from h where (class, name) not in (select (class, method) from annotations where name = 'Scheduled' and method is not null)"""),
    "internal_import": (lambda f, s, d: R.internal_import(f, ".brand3"), """select distinct 'internal-import' as rule, class, 'import ' || import what from imports join types on name = class where contains(import, '.brand3') and not starts_with(import, package || '.')"""),
    "lint": (lambda f, s, d: R.lint(f), """select distinct class, 'unknown type' problem, type what from fields where type not in (select name from types) and type not in (select split_part(import, '.', 3) from imports)
        union all select distinct class, 'maybe not imported', type from fields join types on types.name = class where class in (select class from imports) and type not in (select name from types) and type not in (select split_part(import, '.', 3) from imports)
        union all select distinct class, 'never called', name from methods m where not is_public and not exists (select 1 from edges where callee_class = m.class and callee = m.name)"""),
    "verify_spec": (lambda f, s, d: R.verify(f, _spec(f)), """h as (select distinct class, name from methods), w as (select class, name from methods where start_line % 2 = 1 union select name, 'close' from types where end_line % 5 = 0)
        select class, name, 'missing_method' problem from w where (class, name) not in (select (class, name) from h) union all select class, name, 'undocumented_method' from h where class in (select class from w) and (class, name) not in (select (class, name) from w)"""),
    "diff_files": (lambda f, s, d: R.diff(*_snapshots(s, d)), """o as (select 'P' || p_partkey as path, p_name || case when p_size % 4 = 0 then 'x' else '' end h0 from part where p_size % 9 <> 0), n as (select 'P' || p_partkey as path, p_name h1 from part where p_size % 11 <> 0), x as (select path, case when h0 is null then 'added' when h1 is null then 'deleted' when h0 <> h1 then 'modified' end change from o full join n using (path)) select path, change from x where change is not null"""),
    "history": (lambda f, s, d: R.history(_commits(s, d)), """c as (select 'C' || o_custkey as path, lpad(o_orderkey::varchar, 12, '0') sha, lower(o_orderpriority) author, strftime(o_orderdate, '%Y-%m-%d') as day, 'order ' || o_orderkey subject from orders), r as (select *, row_number() over (partition by path order by day desc, sha desc) r from c)
        select path, count(*)::bigint commits, string_agg(distinct author, ',' order by author) authors, max(day) as last, string_agg(case when r <= 5 then subject end, ',' order by r) subjects from r group by 1"""),
    "resolve_receiver": (lambda f, s, d: R.resolve(f, f.fields.select("class", F.col("name").alias("var")).withColumn("name", F.lit("setS1")).unionByName(f.types.select(F.col("name").alias("class"), F.lit("this").alias("var"), F.lit("setS1").alias("name")))), """a as (select class, name as var, 'setS1' as name from fields union all select name, 'this', 'setS1' from types), fl as (select class, name as var, min(type) as type from fields group by 1, 2), m as (select class as owner, name, min(signature) signature, min(return_type) return_type from methods group by 1, 2), x as (select a.class, a.var, a.name, case when a.var = 'this' then a.class else type end as owner from a left join fl on fl.class = a.class and fl.var = a.var)
        select x.class, x.var, x.name, x.owner, signature, return_type from x left join m on m.owner = x.owner and m.name = x.name"""),
    "explain": (lambda f, s, d: D.explain(f), """m as (select class c, count(*) n from methods group by 1), i as (select class c, string_agg(distinct interface, ', ' order by interface) x from implements group by 1), e as (select * from edges where caller_class <> callee_class), b as (select callee_class c, count(distinct caller_class) n from e group by 1), u as (select caller_class c, count(distinct callee_class) n from e group by 1)
        select qualified, name || ' is ' || case when kind = 'interface' then 'an interface' when is_abstract then 'an abstract class' else 'a ' || kind end || ' in ' || package || ' with ' || coalesce(m.n, 0) || ' methods' || case when super_class <> '' then ', extends ' || super_class else '' end || coalesce(', implements ' || i.x, '') || '; uses ' || coalesce(u.n, 0) || ' types, used by ' || coalesce(b.n, 0) || '.' as text
        from types t left join m on m.c = t.name left join i on i.c = t.name left join b on b.c = t.name left join u on u.c = t.name"""),
    "context": (lambda f, s, d: D.context(f).select("qualified", F.size("methods").alias("methods"), F.size("fields").alias("fields"), F.size("imports").alias("imports"), F.array_join(F.flatten(F.transform("methods", lambda m: F.coalesce(m["callers"], F.array().cast("array<string>")))), ",").alias("callers")), """m as (select class, name, start_line, signature, (select string_agg(distinct caller_class || '.' || caller, ',' order by caller_class || '.' || caller) from edges where callee_class = class and callee = name) cs from methods), g as (select class, count(*)::int n, coalesce(string_agg(cs, ',' order by start_line, name, signature), '') cs from m group by 1), fl as (select class, count(*)::int n from fields group by 1), im as (select class, count(*)::int n from imports group by 1)
        select qualified, g.n as methods, fl.n as fields, im.n as imports, g.cs as callers from types t left join g on g.class = t.name left join fl on fl.class = t.name left join im on im.class = t.name"""),
    "checklist": (lambda f, s, d: D.checklist(f, f.methods), """t as (select distinct class, name from methods), c as (select distinct class, name, caller_class, caller from edges join t on callee_class = class and callee = name), n as (select *, count(*) over (partition by class, name) n from c),
        s as (select class, name, 'change the method' as text, 0 o from t union all select class, name, 'check call in ' || caller_class || '.' || caller, 1 from n where n <= 10 union all select class, name, 'check ' || count(*) || ' calls in ' || caller_class, 1 from n where n > 10 group by class, name, caller_class union all select class, name, 'run the tests', 2 from t)
        select class || '.' || name as target, row_number() over (partition by class, name order by o, text)::int as step, text from s"""),
    "parsed_types": (lambda f, s, d: _parsed_facts(s, d).types.select("qualified", "kind", "super_class", "path", "start_line", "end_line"), f"{_JAVA} select t || '.' || c as qualified, 'class' kind, case when k > 0 then u else '' end super_class, 'src/' || c || '.java' as path, 4 as start_line, 11 + (z % 4 = 0)::int + (z % 5 = 0)::int as end_line from j"),
    "parsed_methods": (lambda f, s, d: _parsed_facts(s, d).methods.drop("path"), f"""{_JAVA} select c as class, 'parent' as name, 0 as params, u as return_type, 'public ' || u || ' parent()' as signature, true as is_public, 6 as start_line, 6 as end_line from j union all select c, 'run', 0, 'void', 'public void run()', true, 7, 7 from j union all select c, 'go', 1, 'void', 'void go(int n)', false, 8, 10 + (z % 4 = 0)::int + (z % 5 = 0)::int from j"""),
    "parsed_edges": (lambda f, s, d: _parsed_facts(s, d).edges.select("caller_class", "caller", "callee_class", "callee", "callee_params", "line"), f"""{_JAVA} select c as caller_class, 'run' as caller, v.u as callee_class, 'run' as callee, 0 as callee_params, 7 as line from j join (select c pc, u from j) v on v.pc = j.u union all select c, 'go', u, 'run', 0, 9 from j union all select c, 'run', u, 'parent', 0, 7 from j union all select c, 'run', c, 'go', 1, 7 from j"""),
    "smells": (lambda f, s, d: B.smells(_parsed(s, d)).select("class", "method", "rule", "severity", "line"), f"""{_JAVA}, a as (select * from j), b as (select c as class, 'go' as method, 'CATCH_GENERIC_EXCEPTION' as rule, 'WARNING' severity, 9 as line from a union all select c, 'go', 'EMPTY_CATCH_BLOCK', 'WARNING', 9 from a where z % 3 = 2 union all select c, 'go', 'SILENT_CATCH_RETURN', 'INFO', 9 from a where z % 3 = 0 union all select c, 'run', 'MAGIC_NUMBER', 'INFO', 7 from a where z not in (0, 1) union all select c, 'go', 'SWITCH_WITHOUT_DEFAULT', 'WARNING', 10 from a where z % 4 = 0 union all select c, 'go', 'EMPTY_IF_BODY', 'WARNING', 10 + (z % 4 = 0)::int from a where z % 5 = 0
        union all select c, 'go', 'UNUSED_PARAMETER', 'INFO', 8 from a where z % 4 <> 0 and z % 5 <> 0) select * from b"""),
    "smells_by_rule": (lambda f, s, d: B.smells(_parsed(s, d)).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.countDistinct("class").alias("classes")), f"""{_JAVA}, r as (select 'CATCH_GENERIC_EXCEPTION' as rule, 'WARNING' severity from j union all select 'EMPTY_CATCH_BLOCK', 'WARNING' from j where z % 3 = 2 union all select 'SILENT_CATCH_RETURN', 'INFO' from j where z % 3 = 0 union all select 'MAGIC_NUMBER', 'INFO' from j where z not in (0, 1) union all select 'SWITCH_WITHOUT_DEFAULT', 'WARNING' from j where z % 4 = 0 union all select 'EMPTY_IF_BODY', 'WARNING' from j where z % 5 = 0 union all select 'UNUSED_PARAMETER', 'INFO' from j where z % 4 <> 0 and z % 5 <> 0)
        select rule, severity, count(*)::bigint n, count(*)::bigint classes from r group by all"""),
    "display_names": (lambda f, s, d: f.methods.select("class", "name", N.display("class", "name", "params").alias("shown"), N.abbreviated(F.concat_ws(".", F.lit("com.acme"), F.lower("return_type"))).alias("short")), """select class, name, class || '.' || name || case when params <= 0 then '()' when params = 1 then '(1 param)' else '(' || params || ' params)' end shown, 'c.a.' || lower(return_type) short from methods"""),
}


def query(name: str):
    run = CATALOG[name][0]

    def f(spark, sf_dir):
        return run(facts(spark, sf_dir), spark, sf_dir)

    f.__name__ = name
    return f


def queries() -> dict:
    return {name: query(name) for name in CATALOG}


def sql() -> dict[str, str]:
    return {name: f"with {FACTS_SQL.strip()}{'' if body.lstrip().startswith('select') else ','} {body}" for name, (_, body) in CATALOG.items() if body}
