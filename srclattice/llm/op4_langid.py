"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text gives a suffix automaton. A text is
parsed from left to right into the longest phrases that occur in the sample; a letter that
the sample lacks is a phrase of its own. With c phrases over n letters against a sample of
m bytes, c * log2(m) / n estimates the cross entropy in bits a byte; the language with the
smallest one wins.

The automaton is turned into one table: the next state for each state and byte class, with
a mark where a phrase ends. Pieces of texts of PIECE bytes are parsed side by side, one
byte of each in a step, each from the start state; then the parse of each piece is carried on into the next one until it
meets the state that the next one's own parse is in, from where on they are the same. A text in which they do not meet is parsed
from end to end. So phrases do not depend on pieces. Only letters count: other
characters are white space, runs of it one space, and case is folded.

The sample (the first SAMPLE_BYTES characters of each language, as the model is fitted on a bounded sample) is
the labelled documents in the order of a hash of their ids and texts, equal rows once; which hashes are low enough is told by
sums by powers of two of the hash, so that about SAMPLE_BYTES, or a few times that, of a language meet to be ordered, however
many rows or languages there are. Rejected are texts without
letters, and those above MAX_BITS with even the best language: they are no running text of
any of the languages.

Defined cases: NULL, empty and letterless texts are rejected, with language "und" and NULL
bits. Ties go to the language first in the alphabet. Every row is judged, repeated ones too.
Labelled rows with a NULL label or text do not train; without any labelled text all is
"und". Whole texts are parsed, however long. Other columns are carried untouched whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import slices, tidied, utf8

SAMPLE_BYTES, PIECE, MAX_BITS = 40_000, 512, 8.0
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_LETTER[[65 + i for i in range(26)]] = True


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with only letters and single spaces, and each text's length in them."""
    data, off = utf8([t.lower() for t in texts])
    if not len(data):
        return data, np.zeros(len(texts), np.int64)
    on = _LETTER[data]
    first = np.zeros(len(data), bool)
    first[off[:-1][off[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[0], after[1:] = False, on[:-1]
    keep = on | (after & ~first)  # a space after each run of letters
    out = np.where(on, data, 32).astype(np.uint8)[keep]
    ends = np.concatenate([[0], np.cumsum(keep)])[off]
    return out, np.diff(ends)


def automaton(sample: bytes) -> tuple[list[dict], list[int]]:
    """The suffix automaton: the transitions of every state; state 0 is the root."""
    nxt, link, size, last = [{}], [-1], [0], 0
    for c in sample:
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                new = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = new
                    p = link[p]
                link[q] = link[cur] = new
        last = cur
    return nxt, size


@lru_cache(2)
def parser(samples: tuple[tuple[str, bytes], ...]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The class of each byte; for each language its table of 4 * next state + (phrases that end here); log2 of the samples."""
    used = sorted({c for _, s in samples for c in s})
    cls = np.zeros(256, np.int64)
    cls[used] = np.arange(1, len(used) + 1)
    tables = []
    for _, s in samples:
        nxt, _ = automaton(s)
        t = np.full((len(nxt), len(used) + 1), 2, np.int32)  # an unknown letter: it ends a phrase, and is one
        t[0] = 1
        for c, q in nxt[0].items():
            t[1:, cls[c]], t[0, cls[c]] = 4 * q + 1, 4 * q
        for p, d in enumerate(nxt):
            if d:
                t[p, cls[list(d)]] = 4 * np.fromiter(d.values(), np.int32, len(d))
        tables.append(t)
    return cls, tables, np.log2([max(2, len(s)) for _, s in samples])


def _forget() -> None:
    parser.cache_clear()


def phrases(data: np.ndarray, sizes: np.ndarray, samples: tuple) -> np.ndarray:
    """Phrases of each text (row) against each language (column)."""
    cls, tables, _ = parser(samples)
    pieces = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    begin = np.cumsum(sizes) - sizes
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, length = begin[owner] + nth * PIECE, np.minimum(sizes[owner] - nth * PIECE, PIECE)
    order = np.argsort(-length, kind="stable")
    start, length, owner = start[order], length[order], owner[order]
    out = np.zeros((len(sizes), len(tables)), np.int64)
    if not len(owner):
        return out
    codes = cls[data]
    live = np.searchsorted(-length, -np.arange(length[0]), "left")  # pieces longer than j
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    follow = np.where(np.append(owner[place][1:], -1) == owner[place], np.append(place[1:], -1), -1)[order]  # the next piece of the same text
    for k, t in enumerate(tables):
        flat, width = t.ravel(), t.shape[1]
        state, count = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        at = np.zeros((int(length[0]), len(owner)), np.int32)  # state and phrases so far, by step
        upto = np.zeros((int(length[0]), len(owner)), np.int16)
        for j in range(int(length[0])):
            n = live[j]
            x = flat[state[:n] * width + codes[start[:n] + j]]
            count[:n] += x & 3
            state[:n] = x >> 2
            at[j, :n], upto[j, :n] = state[:n], count[:n]
        total = np.bincount(owner, count + ((state > 0) & (follow < 0)), len(sizes)).astype(np.int64)
        total += _carried(flat, width, codes, at, upto, state, count, start, length, owner, follow, begin, sizes, total)
        out[:, k] = total
    return out


def _carried(flat, width, codes, at, upto, state, count, start, length, owner, follow, begin, sizes, total) -> np.ndarray:
    """What each text's count changes by as the parse of each piece goes on into the next one."""
    change = np.zeros(len(sizes), np.int64)
    lane = np.flatnonzero(follow >= 0)
    to, s, more, j = follow[lane], state[lane], np.zeros(len(lane), np.int64), 0
    apart = []  # the texts of parses that did not meet
    while len(lane):
        x = flat[s * width + codes[start[to] + j]]
        more, s = more + (x & 3), x >> 2
        met = at[j, to] == s
        np.add.at(change, owner[to[met]], more[met] - upto[j, to[met]])
        over = ~met & (length[to] == j + 1)
        apart.append(owner[to[over]])
        on = ~met & ~over
        lane, to, s, more, j = lane[on], to[on], s[on], more[on], j + 1
    for d in np.unique(np.concatenate(apart)).tolist() if apart else []:
        n, q, view = 0, 0, memoryview(flat)
        for c in codes[begin[d] : begin[d] + sizes[d]].tolist():
            x = view[q * width + c]
            n, q = n + (x & 3), x >> 2
        change[d] = n + (q > 0) - total[d]
    return change


def identify(texts: list[str | None], samples: tuple, max_bits: float = MAX_BITS) -> tuple[list[str], np.ndarray]:
    """The language of each text and its bits a byte (NaN without letters)."""
    data, sizes = letters([t or "" for t in texts])
    if not samples:
        return ["und"] * len(texts), np.full(len(texts), np.nan)
    bits = phrases(data, sizes, samples) * parser(samples)[2] / np.maximum(sizes, 1)[:, None]
    best = bits.argmin(1)
    low = np.where(sizes > 0, bits[np.arange(len(texts)), best], np.nan)
    return [samples[i][0] if x <= max_bits else "und" for i, x in zip(best.tolist(), low.tolist())], low


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> tuple[tuple[str, bytes], ...]:
    """A sample of each language: (language, letters). The only thing gathered on the driver."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).rlike("[A-Za-z]|[^\\x00-\\x7f]")).select(F.col(label).cast("string").alias("lang"), F.xxhash64(doc_id, text).alias("h"), F.substring(F.col(text), 1, sample_bytes).alias("t"))
    rows = rows.withColumn("z", F.length(F.conv(F.hex("h"), 16, 2)))  # bits of the hash: half of all rows have 64, a quarter has 63
    tally: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("lang", "z").agg(F.sum(F.length("t")).alias("n")).collect():
        tally.setdefault(r.lang, {})[r.z] = r.n
    if not tally:
        return ()
    cut = {}
    for lang, by in tally.items():
        got = 0
        for z in sorted(by):
            cut[lang], got = z, got + by[z]
            if got >= 2 * sample_bytes:
                break
    upto = F.create_map(*[F.lit(x) for kv in sorted(cut.items()) for x in kv])
    few = rows.where(F.col("z") <= upto[F.col("lang")]).groupBy("lang", "h").agg(F.min("t").alias("t"))
    before = F.sum(F.length("t")).over(Window.partitionBy("lang").orderBy(F.length(F.conv(F.hex("h"), 16, 2)), "h").rowsBetween(Window.unboundedPreceding, -1))
    by_lang: dict[str, list[str]] = {}
    for r in few.withColumn("before", before).where(f"before is null or before < {sample_bytes}").toArrow().sort_by([("lang", "ascending"), ("before", "ascending")]).to_pylist():
        by_lang.setdefault(r["lang"], []).append(r["t"])
    out = [(k, letters([" ".join(v)])[0][:sample_bytes].tobytes()) for k, v in sorted(by_lang.items())]
    return tuple(x for x in out if x[1])


def _judge(samples: tuple, max_bits: float, inner: str | None):
    def run(batches):
        for b in batches:
            texts = (b.column("row").field(inner) if inner else b.column("t")).to_pylist()
            langs, bits = [], []
            for lo, hi in slices(np.array([len(t or "") for t in texts], np.int64), 1_000_000):
                a, x = identify(texts[lo:hi], samples, max_bits)
                langs += a
                bits.append(x)
            x = np.concatenate(bits) if bits else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(langs, pa.string()), pa.array(np.round(x, 4), mask=np.isnan(x))], ["row", "language", "bits"])

    return run


def languages(docs: DataFrame, samples: tuple | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "lang", max_bits: float = MAX_BITS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """(row, language, bits) of every document; row has the columns keep, or all."""
    samples = fit(docs, doc_id, text, label) if samples is None else samples
    cols = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    inner = text if text in cols else None
    rows = docs.select(row) if inner else docs.select(row, F.col(text).alias("t"))
    out = StructType([rows.schema["row"], StructField("language", StringType()), StructField("bits", DoubleType())])
    return rows.mapInArrow(tidied(_judge(samples, max_bits, inner), _forget), out)


def known_language(docs: DataFrame, **how) -> DataFrame:
    """The documents that are not rejected, with the columns they came with."""
    return languages(docs, **how).where("language != 'und'").select("row.*")


def identified(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """(doc_id, language, bits) of the documents that are not rejected."""
    return languages(docs, doc_id=doc_id, keep=(doc_id,), **how).where("language != 'und'").select(F.col(f"row.`{doc_id}`").alias("doc_id"), "language", "bits")
