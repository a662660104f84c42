"""Mixing sources to target weights by Pareto order sampling.

Every source gets a fixed number of places: the total times its weight, by largest
remainders. A document's expected copies are the places of its source times its size
measure over that of the source. Their whole part is certain; the fraction f that is left
is an inclusion probability. With a uniform u from a hash of the id, documents are ranked
by their random odds u/(1-u) divided by their inclusion odds f/(1-f), and the smallest
ratios fill the source's places that are left (Rosen's Pareto sampling of fixed size).

The size measure is the square root of the length, rounded up: long documents are drawn
more often, but not in proportion. Default weights are tempered: a source's weight is the
square root of its number of documents. Sizes, weights, places and fractions are integers
or ratios of integers, so the sample does not depend on the order of summation.

No source is sorted as a whole: the ratio is mapped to one of BUCKETS ordered buckets,
counts by bucket tell where a source's last place falls, and only that bucket is ranked.
Texts are not shuffled for it but those of that bucket, as long as there are no more than
BROADCAST_ROWS sources.

Defined cases: a NULL source is a source of its own. A NULL or empty text has size 1. A
NULL id takes its uniform from the text's digest. Ties of the ratio go by id (NULL last),
then by the text's digest; equal rows are as many candidates. A source without weight gets no
place; any weight above 0 counts, taken in proportion to the largest one. Other columns are carried untouched whatever their names. An empty table, or a
total of 0, gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, beside

BUCKETS, SEED, BROADCAST_ROWS, WEIGHT = 1 << 16, 20, 50_000, 10**18


def _uniform(doc_id: Column, text: Column, seed: int) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit("")))
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def _whole(weights: dict[str, float]) -> dict[str, int]:
    """Weights as whole numbers, the largest WEIGHT; none that is above 0 becomes 0."""
    if any(not isfinite(v) or v < 0 for v in weights.values()):
        raise ValueError("weights must be numbers from 0 on")
    most = max(weights.values(), default=0)
    return {k: max(1, round(Fraction(v) / Fraction(most) * WEIGHT)) if v else 0 for k, v in weights.items()}


def _places(sources: DataFrame, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """n: how many places each source gets."""
    if weights is None:
        w = F.ceil(F.sqrt("docs"))
    else:
        pairs = [F.lit(x) for k, v in _whole(weights).items() for x in (k, v)]
        w = F.coalesce(F.create_map(*pairs)[F.col("src")], F.lit(0)) if pairs else F.lit(0)
    everything = Window.partitionBy()  # over sources, which are counted already
    s = sources.withColumn("w", w.cast("decimal(19,0)")).withColumn("ww", F.sum("w").over(everything)).where("ww > 0")
    s = s.withColumn("total", (F.sum("docs").over(everything) if total is None else F.lit(total)).cast("decimal(18,0)"))
    s = s.withColumn("whole", F.expr("total * w div ww")).withColumn("rem", F.expr("total * w % ww"))
    s = s.withColumn("over", F.col("total") - F.sum("whole").over(everything))
    r = F.row_number().over(everything.orderBy(F.desc("rem"), F.col("src").asc_nulls_last()))
    return s.withColumn("n", F.col("whole") + F.when((r <= F.col("over")) & (F.col("rem") > 0), 1).otherwise(0)).select("src", "x_all", "n")


def _beside(sources: DataFrame) -> DataFrame:
    """A table with a row for each source goes to every executor if it has BROADCAST_ROWS rows at most; else the join shuffles."""
    return beside(sources, BROADCAST_ROWS)


def copies(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, copies): each sampled row, as a struct, and how often it is in the mixture."""
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("src"),
        F.col(doc_id).alias("id"),
        F.greatest(F.coalesce(F.ceil(F.sqrt(F.length(F.col(text)))), F.lit(1)), F.lit(1)).cast("bigint").alias("x"),
        _uniform(F.col(doc_id), F.col(text), seed).alias("u"),
    )
    places = _places(base.groupBy("src").agg(F.count("*").alias("docs"), F.sum("x").alias("x_all")), weights, total)
    scratch = Scratch(docs.sparkSession)
    p = _beside(scratch.save(places.withColumnRenamed("src", "psrc"), "places"))
    each = base.join(p, F.col("src").eqNullSafe(F.col("psrc"))).drop("psrc")
    each = each.withColumn("sure", F.expr("n * x div x_all")).withColumn("left", F.expr("n * x % x_all"))
    each = each.withColumn("q", F.when(F.col("left") > 0, (F.col("u") / (1 - F.col("u"))) * ((F.col("x_all") - F.col("left")) / F.col("left"))))
    each = each.withColumn("b", F.when(F.col("left") > 0, F.least(F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(-1))
    tally = each.groupBy("src", "b").agg(F.count("*").alias("c"), F.sum("sure").alias("s"), F.first("n").alias("n"))
    of = Window.partitionBy("src")
    tally = tally.withColumn("free", F.col("n") - F.sum("s").over(of)).where("b >= 0")
    tally = tally.withColumn("before", F.sum("c").over(of.orderBy("b")) - F.col("c"))
    cut = tally.where("before < free and before + c >= free").select(F.col("src").alias("csrc"), F.col("b").alias("cut"), (F.col("free") - F.col("before")).alias("room"))
    each = each.join(_beside(scratch.save(cut, "cuts")), F.col("src").eqNullSafe(F.col("csrc")), "left").drop("csrc")
    clear = each.where("b < 0 or cut is null or b != cut").select("row", (F.col("sure") + F.when((F.col("b") >= 0) & (F.col("b") < F.col("cut")), 1).otherwise(0)).alias("copies"))
    order = of.orderBy("q", F.col("id").asc_nulls_last(), F.md5(F.col(f"row.`{text}`").cast("binary")))
    edge = each.where("b = cut").withColumn("r", F.row_number().over(order)).select("row", (F.col("sure") + F.when(F.col("r") <= F.col("room"), 1).otherwise(0)).alias("copies"))
    return clear.unionByName(edge).where("copies > 0")


def sample(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, copies) of the documents in the mixture."""
    c = copies(docs, **how)
    return c.select(F.col(f"row.`{how.get('doc_id', 'doc_id')}`").alias("doc_id"), F.col(f"row.`{how.get('source', 'source')}`").alias("source"), "copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: rows as they came, each as often as it was drawn."""
    return copies(docs, **how).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


SQL = f"""
with d as (select doc_id, source, greatest(ceil(sqrt(length(text))), 1)::bigint x,
    (('0x' || substr(md5('{SEED}:' || doc_id::varchar), 1, 13))::bigint + 0.5::double) / {float(1 << 52)}::double u from documents),
s as (select source, count(*) docs, sum(x)::bigint x_all, ceil(sqrt(count(*)))::bigint w from d group by source),
t as (select *, sum(docs) over ()::bigint * w // sum(w) over ()::bigint whole, sum(docs) over ()::bigint * w % sum(w) over ()::bigint rem, sum(docs) over ()::bigint total from s),
p as (select source, x_all, whole + case when rem > 0 and row_number() over (order by rem desc, source) <= total - sum(whole) over () then 1 else 0 end n from t),
e as (select doc_id, source, x_all, n, u, (n * x // x_all)::bigint sure, (n * x % x_all)::bigint l from d join p using (source)),
q as (select *, case when l > 0 then (u / (1 - u)) * ((x_all - l)::double / l::double) end q, n - sum(sure) over (partition by source) free from e),
r as (select *, row_number() over (partition by source order by (l > 0) desc, q, doc_id) r from q)
select doc_id, source, (sure + case when l > 0 and r <= free then 1 else 0 end)::bigint copies from r
where sure + case when l > 0 and r <= free then 1 else 0 end > 0
"""
