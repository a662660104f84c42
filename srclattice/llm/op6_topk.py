"""Exact top-k search: queries against all vectors.

Queries and vectors are packed into shards of TILE rows, and BLOCK shards of either are a block; a task takes a block of queries
and a block of vectors, one tile of query shard x shard after another: a matrix product, partial selection
of the best of the tile, and a merge into the best so far. Shards are sent once for each block of the other side, by the number
of the pair of blocks, to as many partitions as there are pairs. What the tasks found is merged FAN lists at a
time until one list for each query is left. Similarity is the cosine. Without queries every vector is one; the registered query asks
with those whose id EVERY divides.

Exactness: products are taken in single precision; a tile passes on everything within `margin` (by the dimension, twice the rounding error that
such a product can have) of its k-th best, and candidates are scored again in double precision, whose result does not
depend on where in a tile a pair lay. Ranks are by that score, then by the smaller id.

Defined cases: a vector is no neighbour of itself, but a repeated row is one of its copy; of n equal queries each is asked. NULL
ids, NULL and empty vectors, and those with NULL, NaN or infinite elements are neither queries nor
neighbours. Vectors of different lengths are not compared. A zero vector has similarity 0
to all. With fewer than k others a query has fewer neighbours. Ids are integers; others are an error before anything runs. Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Scratch

K, TILE, BLOCK, FAN, EVERY = 10, 2048, 8, 8, 50
#: Pairs of blocks that there should be at least, so that a small search keeps all cores busy.
PAIRS = 48
BEST = "dim int, q int, part int, ids binary, near binary, score binary"


def _pack(t: pa.Table) -> pa.Table:
    t = t.sort_by([("id", "ascending"), ("row", "ascending")])
    dim = t["dim"][0].as_py()
    v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v = v / np.where(norm > 0, norm, 1)[:, None]
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([t["shard"][0].as_py()], pa.int32()), "ids": [t["id"].to_numpy().tobytes()], "rows": [t["row"].to_numpy().tobytes()], "vecs": [v.tobytes()]})


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k best by (score, smaller id), in order; -inf is no candidate."""
    order = np.lexsort((ids, -score))[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def margin(dim: int) -> float:
    """Twice the error of a product of unit vectors in single precision: rounding of the elements and of dim terms."""
    return 2.2 * (dim + 3) * 2.0**-24


def tile(q: np.ndarray, s: np.ndarray, s_ids: np.ndarray, k: int, same: np.ndarray | bool, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best of one tile: (score, id), rows padded with -inf. same: of each query its own row in s, -1 for none (True: the row with its number); floor: what a score must reach."""
    x = q.astype(np.float32) @ s.astype(np.float32).T
    own = np.arange(len(q)) if same is True else np.full(len(q), -1) if same is False else same
    has = np.flatnonzero(own >= 0)
    x[has, own[has]] = -np.inf
    n, near = x.shape[1], np.float32(margin(q.shape[1]))
    least = np.full(len(q), -2, np.float32) if floor is None else np.maximum(floor, -2).astype(np.float32) - near
    rows = np.flatnonzero(least < -1.5)  # nothing to compare with yet
    if n > k and len(rows):
        least[rows] = np.partition(x[rows], n - k, 1)[:, n - k] - near
    r, c = np.nonzero(x >= least[:, None])
    exact = np.empty(len(r))
    for lo in range(0, len(r), 200_000):
        exact[lo : lo + 200_000] = (q[r[lo : lo + 200_000]] * s[c[lo : lo + 200_000]]).sum(1)
    order = np.lexsort((s_ids[c], -exact, r))
    r, c, exact = r[order], c[order], exact[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    r, c, exact, nth = r[nth < k], c[nth < k], exact[nth < k], nth[nth < k]
    score, ids = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
    score[r, nth], ids[r, nth] = exact, s_ids[c]
    return score, ids


def _run(k: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim, part = key[0].as_py(), key[2].as_py()
        side, out = t["side"].to_pylist(), []
        unpack = lambda i: (t["shard"][i].as_py(), *(np.frombuffer(t[c][i].as_buffer(), np.int64) for c in ("ids", "rows")), np.frombuffer(t["vecs"][i].as_buffer(), np.float64).reshape(-1, dim))
        for i in [i for i, x in enumerate(side) if x == 0]:
            shard, ids, rows, q = unpack(i)
            top, near = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
            for j in [j for j, x in enumerate(side) if x == 1]:
                _, s_ids, s_rows, s = unpack(j)
                order = np.argsort(s_rows, kind="stable")
                at = np.searchsorted(s_rows[order], rows)
                own = np.where((at < len(s_rows)) & (s_rows[order[np.minimum(at, len(s_rows) - 1)]] == rows), order[np.minimum(at, len(s_rows) - 1)], -1)
                a, b = tile(q, s, s_ids, k, own, top[:, -1])
                top, near = best(np.hstack([top, a]), np.hstack([near, b]), k)
            out.append(_row(dim, shard, part, ids, near, top))
        return pa.concat_tables(out) if out else _row(dim, 0, part, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)).slice(0, 0)

    return run


def _row(dim, q, part, ids, near, score) -> pa.Table:
    return pa.table([pa.array([dim], pa.int32()), pa.array([q], pa.int32()), pa.array([part], pa.int32()), [ids.tobytes()], [near.tobytes()], [score.tobytes()]], names=["dim", "q", "part", "ids", "near", "score"])


def _merge(k: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids = np.frombuffer(t["ids"][0].as_py(), np.int64)
        get = lambda name, kind: np.hstack([np.frombuffer(x.as_py(), kind).reshape(len(ids), k) for x in t[name]])
        top, near = best(get("score", np.float64), get("near", np.int64), k)
        return _row(key[0].as_py(), key[1].as_py(), key[2].as_py(), ids, near, top)

    return run


def _rows(k: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b["ids"][i].as_py(), np.int64)
                near = np.frombuffer(b["near"][i].as_py(), np.int64)
                score = np.frombuffer(b["score"][i].as_py(), np.float64)
                on = score > -np.inf
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, k)[on]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))[on]), pa.array(near[on]), pa.array(np.round(score[on], 6) + 0.0)], ["vec_id", "rank", "neighbor_id", "score"]
                )

    return run


def top_k(vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", tile_rows: int = TILE, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbor_id, score) for every vector whose id `every` divides."""
    if not isinstance(vectors.schema[vec_id].dataType, IntegralType):
        raise ValueError(f"{vec_id} must be an integer")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & (F.size("v") > 0) & sound).withColumn("dim", F.size("v"))
    asked = F.col("id") % every == 0
    sizes = {r.dim: (-(-r.q // tile_rows), -(-r.n // tile_rows)) for r in v.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).collect() if r.q}
    if not sizes:
        return spark.createDataFrame([], "vec_id bigint, rank int, neighbor_id bigint, score double")
    by_dim = lambda of: F.create_map(*[F.lit(x) for dim, n in sizes.items() for x in (dim, of(*n))])[F.col("dim")]
    # a number of its own for every row, so that a query knows itself among equal rows; written, as it would differ when run again
    v = scratch.save(v.where(F.col("dim").isin(*sizes)).withColumn("row", F.monotonically_increasing_id()), "vectors")
    spread = F.xxhash64("id", "row")
    shards = {}
    for name, rows, of in (("queries", v.where(asked), lambda q, n: q), ("shards", v, lambda q, n: n)):
        packed = rows.withColumn("shard", F.pmod(spread, by_dim(of)).cast("int")).groupBy("dim", "shard").applyInArrow(_pack, "dim int, shard int, ids binary, rows binary, vecs binary")
        shards[name] = scratch.save(packed, name)
    side = lambda q, n: max(1, min(BLOCK, q * n // PAIRS))  # noqa: E731  shards in a block of vectors
    parts = lambda q, n: -(-n // side(q, n))
    blocks = lambda q, n: -(-q // BLOCK)
    every_part, every_block = (F.explode(F.sequence(F.lit(0), by_dim(x) - 1)) for x in (parts, blocks))
    q = shards["queries"].select("dim", F.floor(F.col("shard") / BLOCK).cast("int").alias("block"), every_part.alias("part"), F.lit(0).alias("side"), "shard", "ids", "rows", "vecs")
    s = shards["shards"].select("dim", every_block.alias("block"), F.floor(F.col("shard") / by_dim(side)).cast("int").alias("part"), F.lit(1).alias("side"), "shard", "ids", "rows", "vecs")
    pairs = sum(blocks(*n) * parts(*n) for n in sizes.values())
    cells = q.unionByName(s).repartition(min(2 * pairs, 20_000), "dim", "block", "part")  # a number that is given is not coalesced
    out = scratch.save(cells.groupBy("dim", "block", "part").applyInArrow(_run(k), BEST), "tiles")
    left = max(parts(*n) for n in sizes.values())
    while left > 1:
        out = out.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("dim", "q", "part").applyInArrow(_merge(k), BEST)
        left = -(-left // FAN)
    return out.select("ids", "near", "score").mapInArrow(_rows(k), "vec_id bigint, rank int, neighbor_id bigint, score double")


SQL = f"""
with v as (select vec_id, embedding::double[] e from embeddings),
p as (select a.vec_id, b.vec_id as neighbor_id, list_cosine_similarity(a.e, b.e) score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {EVERY} = 0),
r as (select *, row_number() over (partition by vec_id order by round(score, 9) desc, neighbor_id) rank from p)
select vec_id, rank::int as rank, neighbor_id, round(score, 6) as score from r where rank <= {K}
"""
