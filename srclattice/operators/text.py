"""Search in lines, search by concept, fuzzy names, similar types, the map of a code base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..facts.model import Facts, joined
from ..session import Levels, checkpointed

#: What a concept is called in code, the likeliest words first.
CONCEPTS = {
    k: v.split()
    for k, v in {
        "async": "async future completable executor thread parallel reactive flux mono",
        "auth": "security authentication authorization token credential principal login oauth",
        "cache": "cache caffeine redis ehcache caching evict",
        "config": "configuration properties settings preference profile environment yaml",
        "database": "database datasource jdbc jpa repository sql persistence hibernate entity db",
        "error": "error exception failureanalyzer handler fallback catch throw fault",
        "file": "file path resource stream reader writer io nio",
        "handle": "handle handler process catch on listener intercept",
        "http": "controller servlet request response endpoint mapping rest web filter",
        "log": "logger log logging slf4j logback log4j",
        "message": "message queue kafka rabbit jms event listener publisher consumer",
        "schedule": "schedule cron timer periodic trigger taskscheduler",
        "serial": "serializ jackson json xml marshal objectmapper gson",
        "ssl": "ssl tls certificate keystore truststore pem jks",
        "test": "test mock stub fixture assert verify testcontainers",
        "valid": "valid constraint validator bindingresult error reject",
    }.items()
}
STOP_WORDS = tuple("a an and are at be do does for how in is it of on or that the this to was were where with".split())


def concept(word: str) -> list[str]:
    """The words of a concept that is, or has, the word, also without its ending; else the word itself. Of several concepts the first by name counts."""
    for w in (word, *(word[: -len(e)] for e in ("s", "es", "ing", "ed") if word.endswith(e))):
        found = CONCEPTS.get(w) or next((v for v in CONCEPTS.values() if w in v), None)
        if found:
            return found
    return [word]


def source_lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line_no, line) of every line; a last line end makes no line of its own."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n", "\n")
    body = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return files.where(F.length(content) > 0).select(path, F.posexplode(F.split(body, "\n")).alias("i", "line")).select(F.col(path).alias("path"), (F.col("i") + 1).alias("line_no"), "line")


def search(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines with one of the words of pattern (a|b), the column of the first and which it is."""
    words = [w for w in (w.strip() for w in pattern.split("|")) if w]
    at = [F.instr("line", w) for w in words]
    first = F.array_min(F.filter(F.array(*at), lambda x: x > 0))
    return lines.withColumn("col", first).where("col is not null").withColumn("word", F.coalesce(*[F.when(a == F.col("col"), w) for a, w in zip(at, words)]))


def _bare(line: Column) -> Column:
    """Without what is in string literals."""
    return F.regexp_replace(line, r'"(?:\\.|[^"\\])*"', '""')


def in_comment(text: Column) -> Column:
    """Of each line of a file (an array) whether it begins in a block comment, by a fold over the lines."""
    def step(acc, line):
        opens, closes = F.length(F.substring_index(_bare(line), "/*", -1)), F.length(F.substring_index(_bare(line), "*/", -1))
        has_open, has_close = F.contains(_bare(line), F.lit("/*")), F.contains(_bare(line), F.lit("*/"))
        after = F.when(has_open & (~has_close | (opens < closes)), True).when(has_close, False).otherwise(acc["open"])
        return F.struct(F.concat(acc["marks"], F.array(acc["open"])).alias("marks"), after.alias("open"))

    start = F.struct(F.array().cast("array<boolean>").alias("marks"), F.lit(False).alias("open"))
    return F.aggregate(text, start, step, lambda acc: acc["marks"])


def search_code(files: DataFrame, facts: Facts, pattern: str) -> DataFrame:
    """Matches with the enclosing type and method, and whether they are in a comment."""
    arr = files.select("path", F.split(F.regexp_replace("content", "\r\n", "\n"), "\n").alias("ls"))
    marked = arr.select("path", F.posexplode(F.arrays_zip("ls", in_comment(F.col("ls")).alias("open"))).alias("i", "x")).select("path", (F.col("i") + 1).alias("line_no"), F.col("x.ls").alias("line"), F.col("x.open").alias("open"))
    hit = search(marked, pattern)
    before = _bare(F.substring("line", F.lit(1), F.col("col") - 1))
    opened = F.contains(before, F.lit("/*")) & ~F.contains(F.substring_index(before, "/*", -1), F.lit("*/"))
    hit = hit.withColumn("in_comment", opened | F.contains(before, F.lit("//")) | (F.col("open") & ~F.contains(before, F.lit("*/"))))
    t = facts.types.select("path", F.col("name").alias("class"), F.col("start_line").alias("ts"), F.col("end_line").alias("te"))
    m = facts.methods.select("path", F.col("name").alias("method"), F.col("start_line").alias("ms"), F.col("end_line").alias("me"))
    hit = hit.join(t, (hit.path == t.path) & F.col("line_no").between(F.col("ts"), F.col("te")), "left").drop(t.path)
    hit = hit.join(m, (hit.path == m.path) & F.col("line_no").between(F.col("ms"), F.col("me")), "left").drop(m.path)
    first = Window.partitionBy("path", "line_no").orderBy(F.desc_nulls_last("ts"), F.desc_nulls_last("ms"), "class", "method")
    return hit.withColumn("r", F.row_number().over(first)).where("r = 1").select("path", "line_no", "line", "word", "class", "method", "in_comment")


def tokens(text: str, least: int = 2) -> list[str]:
    import re

    return [w for w in re.split(r"[\s,.:;!?]+", text.lower()) if len(w) >= least and w not in STOP_WORDS]


def find(f: Facts, words: list[str], k: int = 15) -> DataFrame:
    """Types by concept: of a word's concept the first name that hits counts, 5 in the type's name, else 3 in a method's; min(2, words) must hit."""
    lists = [concept(w) for w in dict.fromkeys(words)]
    m = f.methods.groupBy(F.col("class").alias("mc")).agg(F.collect_set(F.lower("name")).alias("ms"))
    t = f.types.join(m, F.col("name") == F.col("mc"), "left")
    own, names = F.lower("qualified"), F.coalesce("ms", F.array().cast("array<string>"))

    def hit(synonyms):
        among = lambda x: F.exists(names, lambda c: c.contains(x))
        return F.coalesce(*[F.when(own.contains(x), 5).when(among(x), 3) for x in synonyms], F.lit(0))

    hits = [hit(x) for x in lists]
    scored = t.select("qualified", sum(hits, F.lit(0)).alias("score"), sum([(h > 0).cast("int") for h in hits], F.lit(0)).alias("concepts"))
    return scored.where((F.col("concepts") >= min(2, len(lists))) & (F.col("score") > 0)).select("qualified", "score").orderBy(F.desc("score"), "qualified").limit(k)


def scope(f: Facts, words: list[str], k: int = 15) -> DataFrame:
    """Types by keywords: class 5, package 1, 3 for each method and 2 for each field that has the word."""
    has = lambda c: sum([F.lower(c).contains(w).cast("int") for w in words], F.lit(0))
    t = f.types.select(F.col("name").alias("class"), "qualified", (5 * has(F.col("name")) + has(F.col("package"))).alias("s"))
    m = f.methods.groupBy("class").agg((3 * F.sum(has(F.col("name")))).alias("sm"))
    d = f.fields.groupBy("class").agg((2 * F.sum(has(F.col("name")))).alias("sf"))
    total = t.join(m, "class", "left").join(d, "class", "left").fillna(0, ["sm", "sf"]).select("qualified", (F.col("s") + F.col("sm") + F.col("sf")).alias("score"))
    return total.where("score > 0").orderBy(F.desc("score"), "qualified").limit(k)


def repo_map(f: Facts, budget: int = 2000, signatures: int = 3) -> DataFrame:
    """The most called types with their shortest signatures, as many as fit the token budget (at least one)."""
    ext = f.edges.where("caller_class != callee_class").select(F.col("callee_class").alias("class"), "caller_class").repartition("class").distinct().groupBy("class").agg(F.count("caller_class").alias("callers"))
    t = f.types.select(F.col("name").alias("class"), "package").join(ext, "class", "left").fillna(0, ["callers"])
    # as each costs five tokens at least, no more than budget / 5 + 1 can fit: a top-k first, so that only its methods are asked for, then a running sum over few rows
    t = Levels(f.types.sparkSession, "map").add(t.orderBy(F.desc("callers"), "class").limit(budget // 5 + 1))
    short = Window.partitionBy("class").orderBy(F.length("signature"), "signature")
    m = f.methods.join(F.broadcast(t.select("class").distinct()), "class", "left_semi").select("class", "signature").distinct().withColumn("r", F.row_number().over(short)).where(F.col("r") <= signatures)
    m = m.groupBy("class").agg(F.sum(F.length("signature") + 5).alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "signature"))), lambda x: x["signature"]), "; ").alias("signatures"))
    t = t.join(m, "class", "left").fillna(0, ["size"]).fillna("", ["signatures"])
    t = t.withColumn("tokens", F.floor((20 + F.length("class") + F.length("package") + F.col("size")) / 4))
    order = Window.orderBy(F.desc("callers"), "class")
    t = t.withColumn("r", F.row_number().over(order)).withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.where((F.col("used") <= budget) | (F.col("r") == 1)).select("class", "callers", "tokens", "signatures")


def similar(f: Facts, least: float = 0.3) -> DataFrame:
    """(a, b, score): types whose similarity is least or more, in percent.

    0.7 times the Jaccard similarity of method names and 0.3 times the share of common interfaces.
    Pairs with an interface in common meet there. All others need a Jaccard similarity of t = least / 0.7, so an exact
    prefix filter finds them: with names in the order of their rarity, the first common one is among the
    first n - ceil(t * n) + 1 of both, and enough names follow it. A name that every type has is
    in hardly any prefix. Types carry their names to where they meet; nothing is shuffled by pairs.
    """
    m = f.methods.select("class", "name").distinct()
    rarity = m.groupBy("name").agg(F.count("*").alias("often")).orderBy("often", "name")
    ids = checkpointed(rarity.select("name", F.monotonically_increasing_id().alias("t")))
    at = F.pmod(F.xxhash64("t"), F.lit(256)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at % 64)
    bits = F.struct(*[F.bit_or(F.when(F.floor(at / 64) == k, bit).otherwise(0)).alias(f"w{k}") for k in range(4)])
    ms = m.join(ids, "name").groupBy("class").agg(F.sort_array(F.collect_list("t")).alias("m"), bits.alias("w"))
    ins = f.implements.groupBy("class").agg(F.sort_array(F.collect_set("interface")).alias("i"))
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    sets = Levels(m.sparkSession, "sets").add(ms.join(ins, "class", "full").select("class", none("m", "bigint").alias("m"), none("i", "string").alias("i"), "w"))
    found = _of_interfaces(sets, least)
    t = least / 0.7
    if t > 1:
        return found
    # where they meet, types are their sizes and bits; what may be similar then gets the names and is compared
    n = F.size("m")
    head = F.slice("m", 1, F.least(n, n - F.ceil(n * t - 1e-9).cast("int") + 1))
    x = sets.select("class", n.alias("n"), "w.*", F.posexplode(head).alias("pos", "t")).select("t", "class", "n", "pos", "w0", "w1", "w2", "w3")
    need = (F.col("na") + F.col("nb")) * (t / (1 + t)) - 1e-9  # names in common, at least
    apart = sum((F.bit_count(F.col(f"wa{k}").bitwiseXOR(F.col(f"wb{k}"))) for k in range(4)), F.lit(0))
    near = (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need) & ((F.col("na") + F.col("nb") - apart) / 2 >= need)
    side = lambda s: x.toDF("t", s, f"n{s}", f"p{s}", *[f"w{s}{k}" for k in range(4)])
    met = side("a").join(side("b"), "t").where(F.col("a") < F.col("b")).where(near).select("a", "b", "t")
    of = sets.select("class", "m", "i")
    met = met.join(of.toDF("a", "ma", "ia"), "a").join(of.toDF("b", "mb", "ib"), "b").where(~F.arrays_overlap("ia", "ib"))
    both = F.array_intersect("ma", "mb")
    met = met.withColumn("both", both).where(F.get("both", F.lit(0)) == F.col("t"))
    score = F.lit(0.7) * (F.size("both") / (F.size("ma") + F.size("mb") - F.size("both"))) + F.lit(0.3) * F.lit(0.0)
    return found.unionByName(met.withColumn("s", score).where(F.col("s") >= least).select("a", "b", F.floor(F.col("s") * 100 + 0.5).cast("bigint").alias("score")))


#: Types of an interface that are compared at once with as many others; pairs and common values that are in memory at once follow from it.
BLOCK, AT_ONCE = 1_000, 4_000_000


def _of_interfaces(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of the similar types with an interface in common, each at the first one.

    There can be as many as pairs of types of an interface. They are compared block by block, so memory has a bound, and all cores share the work.
    """
    x = sets.select("class", "m", "i", F.explode("i").alias("t"))
    x = x.join(x.groupBy("t").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "t").withColumn("k", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("k", j).alias("p"), F.greatest("k", j).alias("q"))))
    x = x.select("t", "class", "m", "i", "k", cell.alias("cell")).select("t", "cell.*", "class", "m", "i", "k")

    def compare(key, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        t, p, q = (v.as_py() for v in key)
        names = table["class"].combine_chunks()
        rank = np.empty(len(names), "int64")
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        k = table["k"].to_numpy()
        of_a, of_b = np.flatnonzero(k == p), np.flatnonzero(k == q)
        na, nb = len(of_a), len(of_b)
        place = np.zeros((2, len(names)), "int64")
        place[0, of_a], place[1, of_b] = np.arange(na), np.arange(nb)

        def common(rows, values):
            """How many values each of a shares with each of b."""
            out = np.zeros(na * nb, "int64")
            in_a, in_b = k[rows] == p, k[rows] == q
            order = np.argsort(values[in_b], kind="stable")
            b_values, b_at = values[in_b][order], place[1, rows[in_b]][order]
            a_at, lo, hi = place[0, rows[in_a]], np.searchsorted(b_values, values[in_a], "left"), np.searchsorted(b_values, values[in_a], "right")
            ends = np.cumsum(hi - lo)
            start = 0
            while start < len(ends):  # as many values of a at once as AT_ONCE allows, one at least
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
                n = (hi - lo)[start:stop]
                at = np.repeat(lo[start:stop] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                out += np.bincount(np.repeat(a_at[start:stop], n) * nb + b_at[at], minlength=na * nb)
                start = stop
            return out.reshape(na, nb)

        def flat(column):
            lists = table[column].combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy()
            return sizes, np.repeat(np.arange(len(names)), sizes), pc.list_flatten(lists)

        m_size, m_rows, m = flat("m")
        i_size, i_rows, i = flat("i")
        codes = pc.dictionary_encode(i).indices.to_numpy()
        before = pc.less(i, t).to_numpy(zero_copy_only=False)
        cm, ci = common(m_rows, m.to_numpy()), common(i_rows, codes)
        union = m_size[of_a][:, None] + m_size[of_b][None, :] - cm
        jac = np.divide(cm, union, out=np.zeros(union.shape), where=union != 0)
        s = 0.7 * jac + 0.3 * (ci / np.maximum(i_size[of_a][:, None], i_size[of_b][None, :]))
        ok = s >= least
        if before.any():
            ok &= common(i_rows[before], codes[before]) == 0
        if p == q:
            ok &= rank[of_a][:, None] < rank[of_b][None, :]
        y, z = np.nonzero(ok)
        one, two = of_a[y], of_b[z]
        swap = rank[one] > rank[two]
        a, b = np.where(swap, two, one), np.where(swap, one, two)
        return pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "score": np.floor(s[y, z] * 100 + 0.5).astype("int64")})

    return x.groupBy("t", "p", "q").applyInArrow(compare, "a string, b string, score bigint")


def _near_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(name, n2): names within three edits of each other, or of which one contains the other, in lower case; asked has (name), names (n2).

    Of four pieces of a name three edits leave one as it is, at most three places from where it was; so the pieces
    of each name meet the same stretches of those that are asked. What contains a name has it among its substrings.
    """
    a = asked.select("name", F.lower("name").alias("a")).distinct()
    b = names.select("n2", F.lower("n2").alias("b")).distinct()
    start = lambda k, n: F.floor(n * k / 4).cast("int")
    key = lambda n, k, piece: F.struct(n.alias("n"), F.lit(k).alias("k"), piece.alias("p"))
    n = F.length("b")
    pieces = F.array(*[key(n, k, F.substring("b", start(k, n) + 1, start(k + 1, n) - start(k, n))) for k in range(4)])
    fits = F.sequence(F.greatest(F.length("a") - 3, F.lit(0)), F.length("a") + 3)

    def stretches(n, k):
        size = start(k + 1, n) - start(k, n)
        at = F.filter(F.transform(F.array(*[F.lit(d) for d in range(-3, 4)]), lambda d: start(k, n) + d), lambda p: (p >= 0) & (p + size <= F.length("a")))
        return F.transform(at, lambda p: key(n, k, F.substring(F.col("a"), p + 1, size)))

    asks = F.flatten(F.transform(fits, lambda n: F.flatten(F.array(*[stretches(n, k) for k in range(4)]))))
    edits = a.select("name", F.explode(F.array_distinct(asks)).alias("x")).join(b.select("n2", F.explode(pieces).alias("x")), "x").select("name", "n2")
    within = lambda s, sizes: F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda z: (z > 0) & (z <= F.length(s))), lambda z: F.transform(F.sequence(F.lit(1), F.length(s) - z + 1), lambda p: F.substring(s, p, z)))))
    inner = a.where("a != ''").select("name", F.explode(within(F.col("a"), F.sequence(F.lit(1), F.length("a")))).alias("b")).join(b, "b").select("name", "n2")
    sizes = F.broadcast(a.agg(F.collect_set(F.length("a")).alias("sizes")))  # one row, of as many numbers as names have lengths
    outer = b.where("b != ''").crossJoin(sizes).select("n2", F.explode(within(F.col("b"), F.col("sizes"))).alias("a")).join(a, "a").select("name", "n2")
    return edits.unionByName(inner).unionByName(outer).distinct()


def validate(f: Facts, asked: DataFrame, k: int = 5) -> DataFrame:
    """(class, name, exists, suggestion, score): for methods that do not exist the k closest ones.

    The same name in another class 100; at most three edits away 80 - 10 * edits; a common prefix 60; contained 40.
    """
    known = f.methods.select("class", "name").distinct()
    there = asked.join(known.withColumn("exists", F.lit(True)), ["class", "name"], "left").fillna(False, ["exists"])
    a, b = F.lower("name"), F.lower("n2")
    d = F.levenshtein(a, b)
    score = F.greatest(F.when(F.col("name") == F.col("n2"), 100).otherwise(0), F.when(d <= 3, 80 - 10 * d).otherwise(0), F.when(a.startswith(b) | b.startswith(a), 60).otherwise(0), F.when(a.contains(b) | b.contains(a), 40).otherwise(0))
    names = known.select(F.col("name").alias("n2")).distinct()
    near = _near_names(there.where("not exists").select("name").distinct(), names).withColumn("score", score).where("score > 0")
    of_name = Window.partitionBy("n2").orderBy("c2")
    near = Levels(known.sparkSession, "near").add(near)
    few = known.toDF("c2", "n2").join(near.select("n2").distinct(), "n2", "left_semi").withColumn("r", F.row_number().over(of_name)).where(F.col("r") <= k)  # of one name no more can be among the best
    near = near.join(few, "n2").withColumn("suggestion", F.concat_ws(".", "c2", "n2"))
    order = Window.partitionBy("name").orderBy(F.desc("score"), "suggestion")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("name", F.lit(False).alias("exists"), "rank", "suggestion", "score")
    near = Levels(known.sparkSession, "best").add(near)  # where it is small, what is asked need not be shuffled by name
    return there.join(near, ["name", "exists"], "left").select("class", "name", "exists", "rank", "suggestion", "score")


def type_check(f: Facts, asked: DataFrame) -> DataFrame:
    """(class, name, return_type, is_void) of the first such method; NULL where there is none."""
    m = f.methods.groupBy("class", "name").agg(F.min_by("return_type", F.struct("start_line", "signature")).alias("return_type"))
    return asked.join(m, ["class", "name"], "left").withColumn("is_void", F.col("return_type") == "void")


PREFIXES = ("get", "set", "is", "find", "save", "delete", "create", "update", "has", "build")


def prefixes(f: Facts, k: int = 5) -> DataFrame:
    p = F.regexp_extract("name", f"^({'|'.join(PREFIXES)})[A-Z]", 1)
    return f.methods.select(p.alias("prefix")).where("prefix != ''").groupBy("prefix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(k)


def suffix(name: Column) -> Column:
    """The last word of a camel-case name; '' if it has only one."""
    words = F.regexp_extract_all(name, F.lit(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+[0-9]*|[A-Z]+[0-9]*|[0-9]+"), 0)
    return F.when(F.size(words) > 1, F.element_at(words, -1)).otherwise("")


def suffixes(f: Facts, k: int = 5) -> DataFrame:
    return f.types.select(suffix(F.col("name")).alias("suffix")).where("suffix != ''").groupBy("suffix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(k)


def layer_chains(f: Facts, least: int = 2) -> DataFrame:
    """(pattern, n): sets of suffixes that several base names have (OrderService, OrderRepository)."""
    s = f.types.select("name", suffix(F.col("name")).alias("suffix")).where("suffix != ''")
    often = s.groupBy("suffix").agg(F.count("*").alias("c")).where("c >= 3").select("suffix")
    s = s.join(often, "suffix").select(F.expr("substring(name, 1, length(name) - length(suffix))").alias("base"), "suffix").distinct()
    sets = s.groupBy("base").agg(F.sort_array(F.collect_set("suffix")).alias("x")).where(F.size("x") >= 2)
    return sets.select(F.array_join(F.transform("x", lambda v: F.concat(F.lit("${Name}"), v)), " -> ").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def annotation_counts(f: Facts, k: int = 10) -> DataFrame:
    return f.annotations.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def style(f: Facts) -> DataFrame:
    """One row of counts on the conventions of the code base."""
    imp = f.imports.agg(
        F.count_if(F.col("import").startswith("org.slf4j")).alias("slf4j"), F.count_if(F.col("import").startswith("org.apache.logging") | F.col("import").startswith("org.apache.log4j")).alias("log4j"),
        F.count_if(F.col("import").startswith("java.util.logging")).alias("jul"), F.count_if(F.col("import") == "java.util.Optional").alias("optional_imports"),
    )
    typ = f.types.agg(F.count("*").alias("types"), F.count_if("is_interface").alias("interfaces"), F.count_if("is_abstract").alias("abstract"), F.count_if(F.col("name").rlike("(Exception|Error)$")).alias("exceptions"))
    met = f.methods.agg(F.count("*").alias("methods"), F.count_if(F.col("return_type").startswith("Optional")).alias("optional_returns"), F.count_if(F.col("return_type") == "void").alias("void"), F.count_if(~F.col("is_public")).alias("not_public"))
    fld = f.fields.agg(F.count("*").alias("fields"), F.count_if(F.col("type").rlike("^(List|Set|Map|Collection)$")).alias("collections"))
    ann = f.annotations.agg(F.count_if((F.col("name") == "Autowired") & F.col("method").isNull()).alias("field_injection"))
    return imp.crossJoin(typ).crossJoin(met).crossJoin(fld).crossJoin(ann)  # one row each


def snippet_pick(f: Facts, suffix_: str, annotation: str) -> DataFrame:
    """The class to imitate: with the annotation first, then by outside callers, then by methods."""
    of = F.col("class").endswith(suffix_)
    a = f.annotations.where(of & (F.col("name") == annotation) & F.col("method").isNull()).select("class").distinct().withColumn("has", F.lit(1))
    e = f.edges.where("caller_class != callee_class").select(F.col("callee_class").alias("class"), "caller_class").where(of).repartition("class").distinct().groupBy("class").agg(F.count("caller_class").alias("callers"))
    m = f.methods.where(of).groupBy("class").agg(F.count("*").alias("methods"))
    t = f.types.where(F.col("name").endswith(suffix_)).select(F.col("name").alias("class"))
    for x in (a, e, m):
        t = t.join(x, "class", "left")
    return t.fillna(0).orderBy(F.desc("has"), F.desc("callers"), F.desc("methods"), "class").limit(1)
