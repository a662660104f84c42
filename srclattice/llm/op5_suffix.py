"""Suffix-array dedup by a distributed difference-cover algorithm.

A passage of MIN_WORDS words or more that occurs twice in the corpus is a repeat; its
first occurrence (smallest document id, then place in it) stays and the others are cut.

1. Winnowing finds where repeats can be. Of each MIN_WORDS words in a row the smallest
   hash of a run of half that length is kept; equal passages keep equal hashes. So every
   repeated window of MIN_WORDS words holds a kept hash that occurs twice, and only the
   text around such hashes goes on. This loses no repeat, whatever the data.
2. The suffixes of those stretches are sorted with difference cover {1, 2} modulo 3
   (`suffix_order`): the triples at positions 1 and 2 mod 3 are sorted and named, the
   strings of names are sorted by the same function, and the suffixes at 0 mod 3 are
   merged in. Recursion ends when names are unique or cover MIN_WORDS words, as later
   words cannot matter; suffixes that agree that far are in any order among themselves.
3. Adjacent suffixes with equal prefixes of MIN_WORDS words are repeats.

Between 1 and 2 the stretches are divided into pieces that overlap by MIN_WORDS - 1 words,
so each window of MIN_WORDS words begins in one piece; where, the words decide, so that
copies of a long passage have equal pieces. Equal pieces are sorted once, as their first
occurrence; the copies are repeats from end to end. One row has the places of all copies
of a piece, 28 bytes for each.

Blocks of strings are rows with packed integers. A level sends each block's triples to
the owner of their range (splitters come from a sample) and gets the names back; nothing
but splitters is gathered on the driver. Triples are made unique in a block before they
are sent, so a triple that occurs everywhere costs its owner one entry a block. In the
merge, the suffixes that begin with one triple meet at one owner.

Words are separated by ASCII white space and compared as written, as 63-bit hashes;
prefixes as 64-bit hashes between neighbours in suffix order.

Defined cases: NULL and empty texts, and those under MIN_WORDS words, have no repeats and
stay as they are. Texts that are equal as a whole are sorted once: the one with the
smallest id (NULL last) is the first occurrence and every other is a repeat from end to
end. Rows that are equal in id and text are such copies too. Other columns are carried
untouched whatever their names. Ids that are no integers are ordered by their hash. Empty tables give empty results.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import M1, M2, M3, PLAIN, Scratch, mix, ragged, slices, text_key, tidied, word_hashes, word_spans

MIN_WORDS, BLOCK_WORDS, SPLIT_SAMPLE = 50, 300_000, 20_000
#: Owners of ranges at most: their bounds are known to every task, and SPLIT_EACH triples for each of them meet on the driver.
OWNERS, SPLIT_EACH = 200_000, 8
#: Bytes that go from Python to the JVM at once, if more than one row is to go.
BATCH_BYTES = 1 << 20
BLOCK = "blk int, lens binary, syms binary"
NO_ID = np.iinfo(np.int64).max


# ---------------------------------------------------------------- where repeats can be


def winnowed(h: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in h) and values of the hashes kept by winnowing; first: where each text starts."""
    k = max(1, min_words // 2)
    w = min_words - k + 1
    n = len(h) - min_words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        g = g * M1 + h[j : j + len(g)]
    g = mix(g)
    low, at, span = g, np.arange(len(g), dtype=np.int64), 1
    while span < w:
        step = min(span, w - span)
        a, b = low[:-step], low[step:]
        right = b < a
        low, at, span = np.where(right, b, a), np.where(right, at[step:], at[:-step]), span + step
    sizes = np.maximum(np.diff(first) - min_words + 1, 0)
    p = np.unique(at[ragged(first[:-1], sizes)])
    return p, g[p]


def _fingerprints(min_words: int):
    def run(batches):
        for b in batches:
            texts, keys = b.column("text").to_pylist(), b.column("key")
            for lo, hi in slices(np.array([len(t) for t in texts], np.int64), 1_000_000):
                data, starts, ends, first = word_spans(texts[lo:hi], PLAIN)
                if len(starts) < min_words:
                    continue
                p, v = winnowed(word_hashes(data, starts, ends), first, min_words)
                d = np.searchsorted(first, p, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), keys.take(pa.array(d + lo)), pa.array((p - first[d]).astype(np.int32))], ["fp", "key", "pos"])

    return run


def _anchors(syms: np.ndarray, p: np.ndarray) -> list[int]:
    """Of places in a text an eighth, chosen by the words there: the same ones in equal passages."""
    h = mix(syms[p].astype(np.uint64) * M1 + syms[np.minimum(p + 1, len(syms) - 1)].astype(np.uint64))
    return p[h % np.uint64(8) == 0].tolist()


def _stretches(min_words: int):
    """Pieces of the stretches: each window of min_words words begins in one of them, and equal pieces have equal h."""
    k = max(1, min_words // 2)

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for key, text, no, pos in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("ord").to_pylist(), b.column("pos").to_pylist()):
                data, starts, ends, _ = word_spans([text], PLAIN)
                syms = (word_hashes(data, starts, ends) >> np.uint64(1)).astype(np.int64)
                p = np.sort(np.array(pos, np.int64))
                lo, hi = np.maximum(p - (min_words - k), 0), np.minimum(p + min_words, len(syms))
                new = np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1]])
                ends = np.maximum.reduceat(hi, np.flatnonzero(new))
                for s, e in zip(lo[new].tolist(), ends.tolist()):
                    cuts = [s]
                    for c in _anchors(syms, p[(p > s) & (p <= e - min_words)] if len(ends) > 1 else p[p <= e - min_words]):
                        if c >= cuts[-1] + min_words:
                            cuts.append(c)
                    for a, b in zip(cuts, [*(c + min_words - 1 for c in cuts[1:]), e]):
                        x = syms[a:b].tobytes()
                        out.append((md5(x).digest(), NO_ID if no is None else no, int.from_bytes(key[:8], "little", signed=True), a, key, b - a, x))
            if out:
                types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["h", "ord", "k", "start", "key", "n", "syms"])

    return run


def _pack(t: pa.Table) -> pa.Table:
    """A block of pieces that are all different. Each has its first place (keys, ords, starts) and those of its copies (more: how many)."""
    t = t.sort_by("h").combine_chunks()
    lens = t["n"].to_numpy().astype(np.int32)
    occ = pa.concat_arrays(t["occ"].chunks)
    many, at = occ.value_lengths().to_numpy().astype(np.int64), occ.flatten()
    lead = np.zeros(len(at), bool)
    lead[np.cumsum(many) - many] = True
    first, rest = at.filter(pa.array(lead)), at.filter(pa.array(~lead))
    meta = {"keys": b"".join(first.field("key").to_pylist()), "ords": first.field("ord").to_numpy().tobytes(), "starts": first.field("start").to_numpy().astype(np.int32).tobytes()}
    meta |= {"more": (many - 1).astype(np.int32).tobytes(), "ckeys": b"".join(rest.field("key").to_pylist()), "cstarts": rest.field("start").to_numpy(zero_copy_only=False).astype(np.int32).tobytes()}
    return pa.table({"blk": pa.array([t["blk"][0].as_py()], pa.int32()), "lens": [lens.tobytes()], "syms": [b"".join(t["syms"].to_pylist())]} | {k: [v] for k, v in meta.items()})


# ---------------------------------------------------------------- the suffix order


def _arr(x, dtype) -> np.ndarray:
    return np.frombuffer(x.as_py(), dtype)


def _within(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: its place in its string, and how many follow it there."""
    n = lens.astype(np.int64)
    p = ragged(np.zeros(len(n), np.int64), n)
    return p, np.repeat(n, n) - 1 - p


def _next(x: np.ndarray, left: np.ndarray, by: int) -> np.ndarray:
    """The value so many places on; -1, below all others, beyond the string's end."""
    out = np.full(len(x), -1, np.int64)
    out[:-by] = x[by:]
    out[left < by] = -1
    return out


def _route(t: tuple, cuts: np.ndarray) -> np.ndarray:
    """How many of the sorted splitters (rows of cuts) are at or below each triple."""
    if not len(cuts):
        return np.zeros(len(t[0]), np.int64)
    lo, hi = np.searchsorted(cuts[:, 0], t[0], "left"), np.searchsorted(cuts[:, 0], t[0], "right")
    unsure = np.flatnonzero(lo < hi)
    if len(unsure):
        a = np.concatenate([cuts[:, 0], t[0][unsure]])
        b = np.concatenate([cuts[:, 1], t[1][unsure]])
        c = np.concatenate([cuts[:, 2], t[2][unsure]])
        isq = np.arange(len(a)) >= len(cuts)
        order = np.lexsort((isq, c, b, a))
        below = np.cumsum(~isq[order])
        where = isq[order]
        lo[unsure[order[where] - len(cuts)]] = below[where]
    return lo


def _triples(syms: np.ndarray, left: np.ndarray, at: np.ndarray) -> tuple:
    return syms[at], _next(syms, left, 1)[at], _next(syms, left, 2)[at]


def _unique(t: tuple) -> tuple[tuple, np.ndarray]:
    """The distinct triples in order, and which of them each one is."""
    order = np.lexsort(t[::-1])
    s = [x[order] for x in t]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (s[0][1:] != s[0][:-1]) | (s[1][1:] != s[1][:-1]) | (s[2][1:] != s[2][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return tuple(x[new] for x in s), which


def _sampled(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions at 1 and 2 mod 3, string by string and class by class; the new strings' lengths; the distance to the end."""
    p, left = _within(lens)
    n = lens.astype(np.int64)
    base = np.cumsum(n) - n
    sizes = np.stack([(n + 1) // 3, n // 3], 1).ravel()
    starts = np.stack([base + 1, base + 2], 1).ravel()
    at = np.repeat(starts - 3 * (np.cumsum(sizes) - sizes), sizes) + 3 * np.arange(sizes.sum())
    return at, sizes.astype(np.int32), left


def _splitters(blocks: DataFrame, owners: int, n_blocks: int) -> np.ndarray:
    """Bounds of the owners' ranges, from a sample of a fixed total."""
    total = max(SPLIT_SAMPLE, SPLIT_EACH * owners)
    per_block = -(-total // min(n_blocks, total))
    blocks = blocks.where(F.pmod(F.xxhash64("blk"), F.lit(n_blocks)) < total) if n_blocks > total else blocks

    def take(batches):
        for b in batches:
            for i in range(b.num_rows):
                lens, syms = _arr(b["lens"][i], np.int32), _arr(b["syms"][i], np.int64)
                at, _, left = _sampled(lens)
                at = at[:: max(1, len(at) // per_block)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _triples(syms, left, at)], ["a", "b", "c"])

    rows = blocks.select("lens", "syms").mapInArrow(take, "a bigint, b bigint, c bigint").toArrow()
    s = np.stack([rows[c].to_numpy() for c in "abc"], 1)
    s = s[np.lexsort((s[:, 2], s[:, 1], s[:, 0]))]
    cuts = s[np.arange(1, owners) * len(s) // owners] if len(s) and owners > 1 else s[:0]
    return np.unique(cuts, axis=0) if len(cuts) else cuts


def _ask_names(cuts: np.ndarray):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                lens, syms = _arr(b["lens"][i], np.int32), _arr(b["syms"][i], np.int64)
                at, _, left = _sampled(lens)
                u, _ = _unique(_triples(syms, left, at))
                to = _route(u, cuts)
                edge = np.flatnonzero(np.diff(to, prepend=-1))
                parts = [np.concatenate([x[lo:hi] for x in u]).tobytes() for lo, hi in zip(edge, [*edge[1:], len(to)])]
                # one batch a block: with one for each owner, batches would grow with the square of the number of blocks
                yield pa.RecordBatch.from_arrays([pa.array(to[edge], pa.int32()), pa.array([b["blk"][i].as_py()] * len(edge), pa.int32()), pa.array(parts, pa.binary())], ["own", "blk", "t"])

    return run


def _name(t: pa.Table) -> pa.Table:
    own = t["own"][0].as_py()
    each = [_arr(x, np.int64).reshape(3, -1) for x in t["t"]]
    u, which = _unique(tuple(np.concatenate([e[k] for e in each]) for k in range(3)))
    names = which + (np.int64(own) << 36)
    ends = np.cumsum([e.shape[1] for e in each])
    parts = [names[e - x.shape[1] : e].tobytes() for e, x in zip(ends, each)]
    return pa.table({"blk": t["blk"].cast(pa.int32()), "own": t["own"].cast(pa.int32()), "x": pa.array(parts, pa.binary()), "d": pa.array([len(u[0])] + [0] * (len(each) - 1), pa.int64()), "n": pa.array([e.shape[1] for e in each], pa.int64())})


def _strings_of_names(block: pa.Table, replies: pa.Table) -> pa.Table:
    lens, syms = _arr(block["lens"][0], np.int32), _arr(block["syms"][0], np.int64)
    at, sizes, left = _sampled(lens)
    _, which = _unique(_triples(syms, left, at))
    order = np.argsort(replies["own"].to_numpy())
    parts = replies["x"].to_pylist()
    names = np.concatenate([np.frombuffer(parts[i], np.int64) for i in order]) if parts else np.zeros(0, np.int64)
    return pa.table({"blk": block["blk"].cast(pa.int32()), "lens": [sizes.tobytes()], "syms": [names[which].tobytes()]})


def _prefixes(syms: np.ndarray, min_words: int) -> np.ndarray:
    """For each position the hash of the min_words symbols from there on, from powers of two."""
    h, size, power = syms.astype(np.uint64), 1, M1
    total, done = None, 0
    for bit in bin(min_words)[:1:-1]:
        if bit == "1":
            total = h if total is None else total * power + np.roll(h, -done)
            done += size
        h, size, power = h * power + np.roll(h, -size), 2 * size, np.uint64(int(power) ** 2 % 2**64)
    return mix(total).view(np.int64)


def _parcels(blk: int, to: np.ndarray, types: list, cols) -> pa.Table:
    """A row for each owner with its entries of all columns, in small batches; cols makes the columns one at a time."""
    order = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.diff(to[order], prepend=-1))
    own, ends = to[order[edge]], np.append(edge[1:], len(order))[: len(edge)]
    width, before = sum(np.dtype(d).itemsize for d in types), 0
    data = np.empty(width * len(order), np.uint8)
    for col, kind in zip(cols, types):
        size = np.dtype(kind).itemsize
        raw = col.astype(kind, copy=False)[order].view(np.uint8)
        for lo, hi in zip(edge.tolist(), ends.tolist()):
            data[width * lo + before * (hi - lo) :][: size * (hi - lo)] = raw[size * lo : size * hi]
        before += size
    out = []
    for i, j in slices(width * (ends - edge), BATCH_BYTES):
        lo, hi = int(edge[i]), int(ends[j - 1])
        bounds = (width * (np.append(edge[i:j], hi) - lo)).astype(np.int32)
        x = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(bounds), pa.py_buffer(data[width * lo : width * hi])])
        out.append(pa.RecordBatch.from_arrays([pa.array(own[i:j], pa.int32()), pa.array([blk] * (j - i), pa.int32()), x], ["own", "blk", "x"]))
    return pa.Table.from_batches(out, pa.schema([("own", pa.int32()), ("blk", pa.int32()), ("x", pa.binary())]))


def _ask_order(cuts: np.ndarray, min_words: int, top: bool):
    def run(block: pa.Table, ranked: pa.Table) -> pa.Table:
        lens, syms = _arr(block["lens"][0], np.int32), _arr(block["syms"][0], np.int64)
        at, _, left = _sampled(lens)
        r = np.full(len(syms), -1, np.int64)
        r[at] = _arr(ranked["syms"][0], np.int64)
        place = _within(lens)[0].astype(np.int32)
        cls = (place % 3).astype(np.int8)

        def cols():
            yield cls
            yield np.arange(len(syms), dtype=np.int32)
            yield syms
            yield _next(syms, left, 1)
            yield np.where(cls == 0, _next(r, left, 1), r)
            yield np.where(cls == 1, _next(r, left, 1), _next(r, left, 2))
            if top:
                yield _prefixes(syms, min_words)
                yield left >= min_words - 1
                yield np.repeat(_arr(block["ords"][0], np.int64), lens)
                yield np.repeat(np.frombuffer(block["keys"][0].as_py(), np.int64)[::2], lens)
                yield np.repeat(_arr(block["starts"][0], np.int32), lens) + place

        to = _route((syms, _next(syms, left, 1), _next(syms, left, 2)), cuts)
        return _parcels(block["blk"][0].as_py(), to, _MERGE + _TOP * top, cols())

    return run


_MERGE = [np.int8, np.int32, np.int64, np.int64, np.int64, np.int64]
_TOP = [np.int64, np.int8, np.int64, np.int64, np.int32]


def _unpack(t: pa.Table, types: list, want: tuple | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all parts, or those wanted, and each entry's part."""
    sizes = [np.dtype(d).itemsize for d in types]
    raw = [x.as_buffer() for x in t["x"]]
    n = [x.size // sum(sizes) for x in raw]
    cols = range(len(types)) if want is None else want
    return [np.concatenate([np.frombuffer(x, types[k], m, m * sum(sizes[:k])) for x, m in zip(raw, n)]) for k in cols], np.repeat(np.arange(len(n)), n)


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def merged(cls: np.ndarray, t0: np.ndarray, t1: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For suffixes of all three classes: each one's place in their common order.

    Samples are in the order of their ranks (a). A suffix at 0 mod 3 comes after the samples at
    1 mod 3 that are smaller by (symbol, rank of the next) and those at 2 mod 3 that are smaller
    by (symbol, symbol, rank of the next but one).
    """
    zero, one, two = (np.flatnonzero(cls == c) for c in range(3))
    # the rank of the suffix one on: a of class 0, b of class 1; two on: b of classes 0 and 2
    k1 = np.zeros(len(cls), np.int64)
    sel = np.concatenate([zero, one])
    k1[sel] = (_dense(t0[sel]) << 31) | _dense(np.concatenate([a[zero], b[one]]))
    k2 = np.zeros(len(cls), np.int64)
    sel = np.concatenate([zero, two])
    k2[sel] = (_dense((_dense(t0[sel]) << 31) | _dense(t1[sel])) << 31) | _dense(b[sel])
    zero = zero[np.argsort(k1[zero], kind="stable")]
    smaller = np.searchsorted(np.sort(k1[one]), k1[zero]) + np.searchsorted(np.sort(k2[two]), k2[zero])
    sample = np.concatenate([one, two])
    sample = sample[np.argsort(a[sample], kind="stable")]
    place = np.empty(len(cls), np.int64)
    place[zero] = smaller + np.arange(len(zero))
    # samples: as many before as smaller samples and as 0-mod-3 suffixes with fewer samples below
    place[sample] = np.arange(len(sample)) + np.searchsorted(np.maximum.accumulate(smaller) if len(smaller) else smaller, np.arange(len(sample)), "right")
    return place


def _rank(t: pa.Table) -> pa.Table:
    (cls, idx, t0, t1, a, b), part = _unpack(t, _MERGE)
    rank = merged(cls, t0, t1, a, b) + (np.int64(t["own"][0].as_py()) << 36)
    ends = np.cumsum(np.bincount(part, minlength=t.num_rows))
    parts = [idx[s:e].tobytes() + rank[s:e].tobytes() for s, e in zip(np.concatenate([[0], ends[:-1]]), ends)]
    return pa.table({"blk": t["blk"].cast(pa.int32()), "x": pa.array(parts, pa.binary())})


def _ranks(t: pa.Table) -> pa.Table:
    (idx, rank), _ = _unpack(t, [np.int32, np.int64])
    out = np.empty(len(idx), np.int64)
    out[idx] = rank
    return pa.table({"blk": t["blk"][:1].cast(pa.int32()), "lens": [b""], "syms": [out.tobytes()]})


def suffix_order(blocks: DataFrame, scratch: Scratch, n_blocks: int, min_words: int, cover: int = 1) -> DataFrame:
    """Ranks of all suffixes as (blk, lens, syms), syms the ranks in the order of the positions.

    At the top (cover 1) nothing needs ranks in text order; the last merge gives the repeats
    themselves, as (blk, x), x packed (index, is first, document of the first occurrence).
    """
    cuts = _splitters(blocks, min(n_blocks, OWNERS), n_blocks)
    plain = blocks.select("blk", "lens", "syms")
    replies = plain.mapInArrow(tidied(_ask_names(cuts)), "own int, blk int, t binary").groupBy("own").applyInArrow(_name, "blk int, own int, x binary, d bigint, n bigint")
    replies = scratch.save(replies, f"names{cover}")
    total = replies.agg(F.sum("d"), F.sum("n")).first()
    names = plain.groupBy("blk").cogroup(replies.select("blk", "own", "x").groupBy("blk")).applyInArrow(_strings_of_names, BLOCK)
    names = scratch.save(names, f"strings{cover}")
    scratch.drop(replies)
    positions = names.select(F.sum(F.length("syms") / 8)).first()[0] or 0
    unique = total[0] is not None and total[0] >= positions
    if 3 * cover >= min_words or unique:
        ranked = names
    else:
        ranked = suffix_order(names, scratch, n_blocks, min_words, 3 * cover)
        scratch.drop(names)
    top = cover == 1
    asked = blocks.groupBy("blk").cogroup(ranked.groupBy("blk")).applyInArrow(_ask_order(cuts, min_words, top), "own int, blk int, x binary")
    if top:
        out = scratch.save(asked.groupBy("own").applyInArrow(_repeats, "blk int, x binary"), "repeats")
    else:
        out = scratch.save(asked.groupBy("own").applyInArrow(_rank, "blk int, x binary").groupBy("blk").applyInArrow(_ranks, BLOCK), f"ranks{cover}")
    scratch.drop(ranked)
    return out


# ---------------------------------------------------------------- repeats


def _repeats(t: pa.Table) -> pa.Table:
    """Neighbours in suffix order with equal prefixes, and which of each group occurs first."""
    columns = lambda *k: _unpack(t, _MERGE + _TOP, k)[0]  # noqa: E731 - no more of them at a time than a step needs
    order = np.argsort(merged(*columns(0, 2, 3, 4, 5)), kind="stable")
    h, whole = columns(6, 7)
    order = order[whole[order] == 1]
    if not len(order):
        return pa.table({"blk": pa.array([], pa.int32()), "x": pa.array([], pa.binary())})
    hs = h[order]
    new = np.concatenate([[True], hs[1:] != hs[:-1]])
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    order, group = order[several], group[several]
    del h, hs, whole, new, several
    (idx, ords, keys, places), part = _unpack(t, _MERGE + _TOP, (1, 8, 9, 10))
    o = order[np.lexsort((places[order], keys[order], ords[order], group))]
    g = np.repeat(np.arange(len(np.unique(group))), np.unique(group, return_counts=True)[1])
    lead = np.flatnonzero(np.diff(g, prepend=-1))
    first = np.zeros(len(o), np.int8)
    first[lead] = 1
    from_doc = ords[o[lead]][g]
    p = part[o]
    by = np.argsort(p, kind="stable")
    edge = np.flatnonzero(np.diff(p[by], prepend=-1))
    blks = t["blk"].to_numpy()
    rows = [(int(blks[p[by[lo]]]), idx[o[s := by[lo:hi]]].tobytes() + first[s].tobytes() + from_doc[s].tobytes()) for lo, hi in zip(edge, [*edge[1:], len(by)])]
    return pa.table({"blk": pa.array([r[0] for r in rows], pa.int32()), "x": pa.array([r[1] for r in rows], pa.binary())})


def _runs(covered: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and string of each run of covered positions; strings are apart."""
    p, _ = _within(lens)
    on = covered.astype(bool)
    prev = np.concatenate([[False], on[:-1]]) & (p > 0)
    start = np.flatnonzero(on & ~prev)
    follow = np.concatenate([on[1:], [False]])
    follow[:-1] &= p[1:] > 0
    end = np.flatnonzero(on & ~follow)
    string = np.repeat(np.arange(len(lens)), lens)
    return start, end + 1, string[start]


def _spans(min_words: int):
    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        lens = _arr(block["lens"][0], np.int32)
        n = int(lens.sum())
        (idx, first, doc), _ = _unpack(found, [np.int32, np.int8, np.int64]) if found.num_rows else ([np.zeros(0, d) for d in (np.int32, np.int8, np.int64)], None)
        source = np.full(n + 1, NO_ID)
        source[idx] = doc
        # every window of a piece with copies is repeated, if only by these
        more, (_, left) = _arr(block["more"][0], np.int32), _within(lens)
        copied = np.repeat(more > 0, lens) & (left >= min_words - 1)
        alone = copied.copy()
        alone[idx] = False
        source[:-1][alone] = np.repeat(_arr(block["ords"][0], np.int64), lens)[alone]
        every = np.union1d(idx, np.flatnonzero(copied))
        rows: dict[str, list] = {k: [] for k in ("key", "cut", "s", "e", "src")}
        keys = block["keys"][0].as_py()
        base, starts = np.cumsum(lens) - lens, _arr(block["starts"][0], np.int32)
        for cut in (0, 1):
            use = every if not cut else idx[first == 0]
            step = np.zeros(n + min_words + 1, np.int32)
            np.add.at(step, use, 1)
            np.add.at(step, use + min_words, -1)
            a, e, string = _runs(np.cumsum(step)[:n] > 0, lens) if n else (np.zeros(0, np.int64),) * 3
            shift = starts[string] - base[string]
            rows["key"] += [keys[16 * i : 16 * i + 16] for i in string.tolist()]
            rows["cut"] += [bool(cut)] * len(a)
            rows["s"] += (a + shift).tolist()
            rows["e"] += (e + shift).tolist()
            rows["src"] += source[a].tolist()
            of = np.repeat(np.arange(len(lens)), more)
            ckeys, cs = block["ckeys"][0].as_py(), _arr(block["cstarts"][0], np.int32)
            rows["key"] += [ckeys[16 * i : 16 * i + 16] for i in range(len(of))]
            rows["cut"] += [bool(cut)] * len(of)
            rows["s"] += cs.tolist()
            rows["e"] += (cs + lens[of]).tolist()
            rows["src"] += source[base[of]].tolist()
        return pa.table([pa.array(rows["key"], pa.binary()), pa.array(rows["cut"], pa.bool_()), pa.array(rows["s"], pa.int32()), pa.array(rows["e"], pa.int32()), pa.array(rows["src"], pa.int64())], names=list(rows))

    return run


def _joined(batches):
    """Spans of one text that touch or overlap, as one."""
    for b in batches:
        lists = b.column("spans")
        x = lists.flatten()
        s, e, src = (x.field(k).to_numpy() for k in ("s", "e", "src"))
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        shift = row.astype(np.int64) << 32
        until = np.maximum.accumulate(e + shift)
        head = np.flatnonzero(np.concatenate([[True], (s + shift)[1:] > until[:-1]])) if len(s) else np.zeros(0, np.int64)
        last = np.concatenate([head[1:], [len(s)]])[: len(head)] - 1
        of = pa.array(row[head])
        yield pa.RecordBatch.from_arrays([b.column("key").take(of), b.column("cut").take(of), pa.array(s[head]), pa.array((until[last] - shift[last]).astype(np.int32)), pa.array(src[head])], ["key", "cut", "s", "e", "src"])


def _order(docs: DataFrame, doc_id: str) -> Column:
    """What documents are ordered by: their ids, or hashes of these if they are no integers."""
    c = F.col(doc_id)
    return c.cast("bigint") if isinstance(docs.schema[doc_id].dataType, IntegralType) else F.when(c.isNotNull(), F.xxhash64(c.cast("string")))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, cut, s, e, src): for each distinct text, its stretches of repeated words (cut false) and those to cut."""
    if min_words < 2:
        raise ValueError("min_words must be 2 at least")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keyed = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"), _order(docs, doc_id).alias("id")).where("key is not null")
    fps = scratch.save(keyed.select("key", "text").mapInArrow(tidied(_fingerprints(min_words)), "fp bigint, key binary, pos int"), "fingerprints")
    place = F.xxhash64("key", "pos")  # which one is least and which greatest is found before anything is sent
    twice = fps.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("fp")
    marked = fps.join(twice, "fp").groupBy("key").agg(F.collect_set("pos").alias("pos"))
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"), F.min("id").alias("ord"))
    stretches = scratch.save(marked.join(texts, "key").select("key", "text", "ord", "pos").mapInArrow(tidied(_stretches(min_words)), "h binary, ord bigint, k bigint, start int, key binary, n int, syms binary"), "stretches")
    scratch.drop(fps)
    pieces = scratch.save(stretches.groupBy("h").agg(F.first("n").alias("n"), F.first("syms").alias("syms"), F.sort_array(F.collect_list(F.struct("ord", "k", "start", "key"))).alias("occ")), "pieces")
    scratch.drop(stretches)
    words = pieces.agg(F.sum("n")).first()[0] or 0
    out = "key binary, cut boolean, s int, e int, src bigint"
    if not words:
        return spark.createDataFrame([], out)
    n_blocks = max(1, round(words / BLOCK_WORDS))
    blocks = pieces.withColumn("blk", F.pmod(F.xxhash64("h"), F.lit(n_blocks)).cast("int")).groupBy("blk").applyInArrow(_pack, BLOCK + ", keys binary, ords binary, starts binary, more binary, ckeys binary, cstarts binary")
    blocks = scratch.save(blocks, "blocks")
    scratch.drop(pieces)
    found = suffix_order(blocks, scratch, n_blocks, min_words)
    spans = blocks.groupBy("blk").cogroup(found.groupBy("blk")).applyInArrow(_spans(min_words), out)
    spans = spans.groupBy("key", "cut").agg(F.sort_array(F.collect_list(F.struct("s", "e", "src"))).alias("spans"))
    spans = scratch.save(spans.mapInArrow(tidied(_joined), out), "spans")
    scratch.drop(blocks, found)
    return spans


def _n_words(text: Column) -> Column:
    """Words as in PLAIN: between ASCII white space."""
    return F.size(F.filter(F.split(text, r"[\t\n\x0b\f\r\x1c-\x1f ]+"), lambda w: w != ""))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, cut_words, first_doc_id): every stretch of repeated passages of every document.

    cut_words of the stretch occur earlier in the corpus; first_doc_id has the first occurrence of the passage that it starts with.
    """
    spans = repeated_spans(docs, doc_id, text, min_words)
    scratch = Scratch(docs.sparkSession)
    ids = docs.select(text_key(F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"), _order(docs, doc_id).alias("ord"), F.col(text).alias("t")).where("key is not null").select("key", "doc_id", "ord", _n_words(F.col("t")).alias("n"))
    ids = scratch.save(ids, "ids")
    same = ids.groupBy("key").agg(F.count("*").alias("c"), F.min("ord").alias("least"))
    ids = ids.join(same, "key")
    cuts = spans.where("cut").select("key", F.col("s").alias("cs"), F.col("e").alias("ce"))
    inner = spans.where("not cut").select("key", "s", "e", "src")
    inner = inner.join(cuts, (inner.key == cuts.key) & (cuts.cs >= inner.s) & (cuts.ce <= inner.e), "left").groupBy(inner.key, "s", "e", "src").agg(F.coalesce(F.sum(F.col("ce") - F.col("cs")), F.lit(0)).cast("int").alias("cut_words"))
    whole = ids.where(f"c > 1 and n >= {min_words}")
    one = ids.where(f"c = 1 or n < {min_words}").groupBy("key").agg(F.min_by("doc_id", "ord").alias("doc_id"))
    single = one.join(inner, "key").select("doc_id", F.col("s").alias("start_word"), F.col("e").alias("end_word"), "cut_words", F.when(F.col("src") != int(NO_ID), F.col("src")).alias("first"))
    lost = inner.groupBy("key").agg(F.sum("cut_words").cast("int").alias("lost"))
    # of copies with the least id, one is the first
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.col("ord").asc_nulls_last()))
    firsts = whole.where(F.col("ord").eqNullSafe(F.col("least"))).withColumn("r", nth)
    copies = firsts.unionByName(whole.where(~F.col("ord").eqNullSafe(F.col("least"))).withColumn("r", F.lit(2))).join(lost, "key", "left").select(
        "doc_id", F.lit(0).alias("start_word"), F.col("n").alias("end_word"), F.when(F.col("r") > 1, F.col("n")).otherwise(F.coalesce("lost", F.lit(0))).alias("cut_words"), F.col("least").alias("first")
    )
    out = single.unionByName(copies)
    if isinstance(docs.schema[doc_id].dataType, IntegralType):
        return out.withColumnRenamed("first", "first_doc_id")
    names = ids.where("ord is not null").groupBy(F.col("ord").alias("first")).agg(F.min("doc_id").alias("first_doc_id"))
    return out.join(names, "first", "left").drop("first")


def _cut_texts(texts, spans):
    out = []
    for t, s in zip(texts, spans):
        if s is None or not len(s):
            out.append(t)
            continue
        data, starts, ends, _ = word_spans([t], PLAIN)
        keep = np.ones(len(data), bool)
        for x in s:
            a, e = x["s"], x["e"]
            keep[starts[a] : starts[e] if e < len(starts) else len(data)] = False
        out.append(data[keep].tobytes().decode())
    return out


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, with their columns, without repeated passages but for the first occurrence of each.

    A document of which nothing is left goes; so do whole copies, of min_words words or more, of another document.
    """
    spans = repeated_spans(docs, doc_id, text, min_words)
    cuts = spans.where("cut").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("cuts"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, _order(docs, doc_id).alias("id"), text_key(F.col(text)).alias("key"), F.col(text).alias("t"))
    order = Window.partitionBy("key").orderBy(F.col("id").asc_nulls_last())
    have = rows.where("key is not null").withColumn("r", F.row_number().over(order)).where((F.col("r") == 1) | (_n_words(F.col("t")) < min_words)).join(cuts, "key", "left")

    @F.pandas_udf("string")
    def cut(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(_cut_texts(t, s), dtype=object)

    # not deterministic by name only: else the filter gets a second call, and each task a second Python worker
    changed = have.where("cuts is not null").withColumn("new", cut.asNondeterministic()("t", "cuts")).where(F.trim("new") != "")
    changed = changed.select(*[(F.col("new") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return changed.unionByName(have.where("cuts is null").select("row.*")).unionByName(rows.where("key is null").select("row.*"))
