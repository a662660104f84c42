"""MinHash near-dedup with circulant permutations.

A document is the set of its runs of three lower-case words (of all its words, if it
has one or two). Runs are hashed into a universe of 2**20; one permutation (sigma)
scatters them, a second (pi), shifted circularly by k, gives coordinate k of the
signature, so two tables replace 128 permutations: the coordinates of one element are
128 neighbouring entries of pi. Documents that share a band of four coordinates are
candidates. Every candidate link is verified by exact Jaccard similarity of the runs
themselves, read from the texts, never estimated from signatures.

Groups of thousands of copies do not make millions of pairs: in each bucket all members
are first held against the bucket's smallest member; connected components follow; only
where a bucket still holds several components are their members compared across
components. Where that bucket has more than WIDE members (as texts with one passage in common
may, which are not near copies), pairs do not come from the bucket but from an exact prefix filter over
its texts: of two texts that are similar enough the rarest runs, |x| - ceil(t|x|) + 1 of each, have one in common, so only texts that share
such a rare run, and whose sizes allow it, are compared. The result has every link that verifying every pair of every bucket would give.

Defined cases: a NULL text, or one without letters and digits, is never a duplicate and
stays. Of equal rows, or rows with equal ids, one stays like of any other copies. The
document that stays is the one with the smallest id (NULL last; then in order of the text's digest).
Other columns are carried untouched whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, M1, M2, M3, Scratch, mix, slices, text_key, tidied, word_hashes, word_spans

UNIVERSE, COORDINATES, BANDS, THRESHOLD, RUN, WIDE = 1 << 20, 128, 32, 0.6, 3, 64
_WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")


@lru_cache(1)
def _tables(seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    sigma = rng.permutation(UNIVERSE).astype(np.int32)
    pi = rng.permutation(UNIVERSE).astype(np.int32)
    around = np.concatenate([pi, pi[: COORDINATES - 1]])
    return sigma, np.lib.stride_tricks.sliding_window_view(around, COORDINATES)


def _forget() -> None:
    _tables.cache_clear()


def signatures(texts: list[str]) -> np.ndarray:
    """One row of COORDINATES for each text; texts have words."""
    sigma, shifted = _tables()
    data, starts, ends, first = word_spans([t.lower() for t in texts], ALNUM)
    h = word_hashes(data, starts, ends)
    n = np.diff(first)
    runs = np.maximum(n - (RUN - 1), np.minimum(n, 1))
    h = np.concatenate([h, np.zeros(RUN, np.uint64)])
    at = np.repeat(first[:-1] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    s = h[at] * M1
    for k, m in ((1, M2), (2, M3)):
        inside = at + k < np.repeat(first[1:], runs)
        s += mix(np.where(inside, h[at + k], np.uint64(k)) * m)
    p = sigma[(mix(s) >> np.uint64(44)).astype(np.int64)]
    out = np.full((len(texts), COORDINATES), UNIVERSE, np.int32)
    bounds = np.cumsum(runs) - runs
    for lo, hi in slices(runs, 20_000):
        a, b = bounds[lo], bounds[lo] + runs[lo:hi].sum()
        full = np.flatnonzero(runs[lo:hi]) + lo
        if hi - lo == 1:
            for c in range(a, b, 20_000):  # a very long text
                out[lo] = np.minimum(out[lo], shifted[p[c : min(b, c + 20_000)]].min(0))
        elif len(full):
            out[full] = np.minimum.reduceat(shifted[p[a:b]], bounds[full] - a, axis=0)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band, with the band's number in it."""
    rows = sig.reshape(len(sig), BANDS, -1).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * M3, rows.shape[:2]).copy()
    for r in range(rows.shape[2]):
        h = mix(h ^ (rows[:, :, r] + M1))
    return h.view(np.int64)


def _bands_of(batches):
    for b in batches:
        texts, keys = b.column("text").to_pylist(), b.column("key")
        for lo, hi in slices(np.array([len(t) for t in texts], np.int64), 1_000_000):
            x = bands(signatures(texts[lo:hi]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, BANDS), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), lists], ["key", "bands"])


def shingles(text: str) -> set:
    w = _WORD.findall(text.lower())
    return {tuple(w)} if len(w) < RUN else set(zip(w, w[1:], w[2:]))


def _verified(threshold: float):
    def run(batches):
        last, known = None, set()
        for b in batches:
            hits = []
            for i, (c, tc, tm) in enumerate(zip(b.column("c").to_pylist(), b.column("tc").to_pylist(), b.column("tm").to_pylist())):
                if c != last:
                    last, known = c, shingles(tc)
                m = shingles(tm)
                both = len(known & m)
                if both >= threshold * (len(known) + len(m) - both):
                    hits.append(i)
            if hits:
                yield pa.RecordBatch.from_arrays([b.column(x).take(pa.array(hits)) for x in ("c", "m")], ["a", "b"])

    return run


def verify(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (c, m) whose texts are similar enough, as (a, b)."""
    one = texts.withColumnRenamed("key", "m").withColumnRenamed("text", "tm")
    two = texts.withColumnRenamed("key", "c").withColumnRenamed("text", "tc")
    return pairs.join(one, "m").join(two, "c").select("c", "m", "tc", "tm").mapInArrow(tidied(_verified(threshold)), "a binary, b binary")


def components(spark: SparkSession, scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components by large and small stars: (node, comp), comp the smallest node; all nodes but the smallest of each."""
    now, seen = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges"), None
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).alias("x")
    while (here := now.select(mark).first()[0]) != seen:
        seen = here
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        of_u = Window.partitionBy("u")
        large = both.withColumn("low", F.least("u", F.min("v").over(of_u))).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        small = large.withColumn("low", F.min("v").over(of_u))
        small = small.select("v", "low").where("v != low").unionByName(small.select(F.col("u").alias("v"), "low")).toDF("u", "v").distinct()
        before, now = now, scratch.save(small, "edges")
        scratch.drop(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _runs_of(batches):
    """The runs of each text, as hashes, and how many there are."""
    for b in batches:
        for i, (key, text) in enumerate(zip(b.column("key").to_pylist(), b.column("text").to_pylist())):
            h = np.array(sorted({hash_run(r) for r in shingles(text)}), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.binary()), pa.array(h), pa.array(np.full(len(h), len(h), np.int32))], ["key", "run", "size"])


def hash_run(run: tuple) -> int:
    return int.from_bytes(blake2b("\x00".join(run).encode(), digest_size=8).digest(), "little", signed=True)


def _alike(scratch: Scratch, wide: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(c, m): pairs of texts of different components that an exact prefix filter leaves; wide has (key, comp)."""
    runs = scratch.save(wide.select("key").join(texts, "key").mapInArrow(tidied(_runs_of), "key binary, run bigint, size int"), "runs")
    rare = Window.partitionBy("key").orderBy("often", "run")
    nth = runs.join(runs.groupBy("run").agg(F.count("*").alias("often")).where("often > 1"), "run", "left").fillna(1, ["often"]).withColumn("r", F.row_number().over(rare))
    head = nth.where((F.col("often") > 1) & (F.col("r") <= F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - 1e-9) + 1)).select("key", "run", "size").join(wide, "key")
    head = scratch.save(head, "heads")
    x, y = head.toDF("c", "run", "sx", "cc"), head.toDF("m", "run", "sy", "cm")
    near = (F.least("sx", "sy") + 1e-9 >= F.greatest("sx", "sy") * threshold) & (F.col("c") < F.col("m")) & (F.col("cc") != F.col("cm"))
    return x.join(y, "run").where(near).select("c", "m").distinct()


def near_groups(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(node, comp) of text keys: texts that belong to the component of another, smaller key."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keyed = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text")).where("key is not null")
    exploded = keyed.mapInArrow(tidied(_bands_of, _forget), "key binary, bands array<bigint>").select("key", F.explode("bands").alias("band"))
    banded = scratch.save(exploded.distinct(), "banded")  # copies of a text are one member
    ends = banded.groupBy("band").agg(F.min("key").alias("c"), F.max("key").alias("top")).where("c != top").select("band", "c")
    members = scratch.save(banded.join(ends, "band").select("band", "key", "c"), "members")
    scratch.drop(banded)
    tried = scratch.save(members.where("key != c").select("c", F.col("key").alias("m")).distinct(), "tried")
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    good = scratch.save(verify(texts, tried, threshold), "verified")
    comp = components(spark, scratch, good)
    # Buckets that still hold several components: all pairs across components, but those already tried.
    placed = members.select("band", "key").join(comp.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("comp", "key").alias("comp"))
    placed = scratch.save(placed, "placed")
    several = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("band", "n")
    mixed = scratch.save(placed.join(several, "band"), "mixed")
    few = mixed.where(F.col("n") <= WIDE).drop("n")
    x, y = few.toDF("band", "c", "cc"), few.toDF("band", "m", "cm")
    rest = x.join(y, "band").where("c < m and cc != cm").select("c", "m")
    many = scratch.save(mixed.where(F.col("n") > WIDE).select("key", "comp").distinct(), "wide")
    if not many.isEmpty():
        rest = rest.unionByName(_alike(scratch, many, texts, threshold))
    rest = rest.distinct()
    rest = scratch.save(rest.join(tried, ["c", "m"], "left_anti"), "rest")
    scratch.drop(members, placed, mixed, many)
    if not rest.isEmpty():
        more = scratch.save(verify(texts, rest, threshold), "verified")
        if not more.isEmpty():
            old = comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))
            comp = components(spark, scratch, old.unionByName(more))
    scratch.drop(tried, good, rest)
    return comp


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row (doc_id, dup_of, group_size) for each document that is not the one of its group that stays."""
    comp = near_groups(docs, text, threshold)
    ids = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key")).where("key is not null")
    grouped = ids.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("g", F.coalesce("comp", "key"))
    inside = Window.partitionBy("g")
    ordered = inside.orderBy(F.col("doc_id").asc_nulls_last(), "key")
    return (
        grouped.withColumn("r", F.row_number().over(ordered))
        .withColumn("dup_of", F.first("doc_id").over(ordered))
        .withColumn("group_size", F.count("*").over(inside))
        .where("r > 1")
        .select("doc_id", "dup_of", "group_size")
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near duplicates, with the columns they came with."""
    comp = near_groups(docs, text, threshold)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"))
    first = row.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id")).alias("least"))
    of_group = Window.partitionBy("g").orderBy("least", "key")
    others = (
        first.join(comp.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("g", F.coalesce("comp", "key"))
        .withColumn("r", F.row_number().over(of_group))
        .where("r > 1")
        .select("key")
    )
    copies = Window.partitionBy("key").orderBy(F.col("id").asc_nulls_last())
    kept = row.where("key is not null").join(others, "key", "left_anti").withColumn("r", F.row_number().over(copies)).where("r = 1").select("row.*")
    return kept.unionByName(row.where("key is null").select("row.*"))
