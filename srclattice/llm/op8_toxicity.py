"""Toxicity by Levenshtein automata over a lexicon.

The lexicon is LEXICON and, where there are labels, what they teach (`learned`): of a bounded sample of FIT_ROWS labelled
documents of each language the words that occur in toxic documents and next to nowhere else. A word is
taken if the share q of its occurrences that are in toxic documents is PRECISION or more, and if q is above the
language's own share p by more than chance: s * log(q / p) + (s / q - s) * log((1 - q) / (1 - p)) must reach log(V / ALPHA),
the bound for V words tried at once, where s counts the different neighbourhoods (word before, word after; 64
buckets) that it has in toxic documents, so that copies of one document are one piece of evidence; so they are in p.

The lexicon is a trie; walking it with up to k edits is a finite automaton, made
deterministic as far as the texts walk it: a state is the set of (trie node, edits so far) that a word's letters
so far can have reached. All words of a batch of texts are fed to it side by side, letter by letter,
and leave it as soon as no term is in reach.

Terms of MIN_ONE letters or more allow one edit, of MIN_TWO or more two; shorter ones
none. An edit is an inserted, lost or other letter, or two that changed places, anywhere in the word; letters are those of any script. Digits and
signs that stand for letters (1diot, $tupid) are those letters. A term near which the harmless words of the sample lie
close (more than ALIKE different ones within e edits) allows fewer edits than e: its misspellings could not be told from those words. Learned terms
allow e edits only if there is no such word for the term itself, and CROWD at most on average for all that its language taught.

What a term weighs as written, and what each of its misspelled forms weighs, is learned from all labelled documents: of
n that contain it k are toxic, and with PRIOR it weighs (k + a) / (n + a + b). A form weighs (k + FORM * w) / (n + FORM), where w is the weight
of its term as written, times DISCOUNT for each edit; so a form that no label tells about weighs w. Names and
words (of this or other languages) that look like a term thereby weigh little, without taking weight from its misspellings. Counts by term
and form are gathered on the driver: as many as there are forms within the edits of a term, at most.

Where a learned term is all that a document has, its weight is multiplied by the share, (k + 1) / (n + 1), of labelled documents
of that kind which are toxic: words that were learned from few documents may be chance, and several of them together are none.

A hit has its term's weight, doubled if a word of address (you, your)
is among the WINDOW words before or after it, and quartered if it is quoted: a quotation mark
directly before or after it, or a word about words (said, called, word, term) among the QUOTE_WINDOW
words before it. A document's score is the largest sum of the weights within WINDOW
words; it is toxic from THRESHOLD on. So one exact term that is not quoted is enough, or one with one edit if labels make
its term a strong one; weaker ones must be close together, and a document about terms is left alone.

Defined cases: NULL and empty texts have no hits. Every row is judged, repeated ones too.
Whole texts are read, however long. Words are runs of letters, marks, digits, $ and @, in lower case; of three or more $ or @ in a row none belongs to a word. Labels with a
NULL id or verdict do not count; without labels LEXICON has its prior weights. A NULL id is
judged, but has no label. Ids are of any type. A NULL language is a language of its own; without a column of languages all documents are of one. Columns other than the named ones are
not read. An empty table gives an empty result; an empty lexicon finds what labels teach.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, slices, tidied, word_spans  # noqa: F401

MIN_ONE, MIN_TWO, WINDOW, QUOTE_WINDOW = 4, 8, 25, 3
#: What is added to (toxic, other) documents with a term as written; how many documents the term counts as for a misspelled form, and its discount by edit.
PRIOR, FORM, DISCOUNT, THRESHOLD = (3.0, 1.0), 2.0, 0.8, 0.7
#: Labelled documents of a language that the lexicon is learned from, about; the chance of one wrong word; the least share in toxic documents; harmless look-alikes that an edit may have, of LEXICON's terms and on average of learned ones.
FIT_ROWS, ALPHA, PRECISION, ALIKE, CROWD = 10_000, 0.01, 0.8, 3, 0.25
#: Ids that go to every executor; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
LEXICON = (
    "idiot idiots idiotic moron morons moronic stupid stupidity imbecile imbeciles cretin cretins dimwit halfwit dumbass jackass asshole assholes bastard bastards bitch bitches "
    "scum scumbag scumbags loser losers pathetic worthless disgusting despicable trash clown clowns retard retarded freak filth filthy vermin parasite parasites degenerate "
    "subhuman slut sluts whore whores fuck fucker fuckers fucking motherfucker shithead bullshit douchebag braindead brainless wanker crap sleazebag lowlife"
).split()
ADDRESS, ABOUT = "you your youre yours yourself u ur".split(), "said says called calls word words term terms quote quoted quotes wrote".split()
_STANDS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "$": "s", "@": "a"}

#: Which codes belong to words. Texts are coded by one number a character: ASCII as it is, letters beyond by NUMBER, others as OTHER.
TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = True
TOKEN[[36, 64]] = True
OTHER = 128
_RUNS = re.compile(r"\${3,}|@{3,}")
_MARKS = set("\xab\xbb\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\u2039\u203a\u300a\u300b\u300c\u300d\u300e\u300f")


@lru_cache(1)
def _kinds() -> np.ndarray:
    """By character beyond ASCII: OTHER for what belongs to words, a quotation mark for one, else a space."""
    out = np.full(0x110000, 32, np.uint16)
    out[:128] = np.arange(128)
    for i in range(128, 0x110000):
        c = chr(i)
        if c.isalnum() or unicodedata.category(c)[0] == "M":
            out[i] = OTHER
        elif c in _MARKS:
            out[i] = 34
    return out


def _default(term: str) -> int:
    return 2 if len(term) >= MIN_TWO else 1 if len(term) >= MIN_ONE else 0


class Automaton:
    """Next state by (state, class of a character), -1 where it is not known yet, state 0 being out of reach and 1 the start.

    first: the first letter must be right. allow: the edits of each term, by its length if it is not given.
    """

    def __init__(self, lexicon: tuple[str, ...], first: bool, allow: tuple[int, ...] | None):
        self.first, limits = first, allow or tuple(map(_default, lexicon))
        self.kids: list[dict[str, int]] = [{}]
        self.allowed, self.term, self.limit = [0], [0], [-1]
        for i, (w, k) in enumerate(zip(lexicon, limits)):
            p = 0
            for c in w:
                if c not in self.kids[p]:
                    self.kids[p][c] = len(self.kids)
                    self.kids.append({})
                    self.allowed.append(-1)
                    self.term.append(0)
                    self.limit.append(-1)
                p = self.kids[p][c]
                self.allowed[p] = max(self.allowed[p], k)
            self.term[p], self.limit[p] = i, k
        self.allowed[0] = max(self.allowed)
        letters = sorted({c for w in lexicon for c in w} | set(_STANDS))
        self.means = [""] + [c + _STANDS.get(c, "") for c in letters]
        beyond = [c for c in letters if ord(c) > 127]
        self.code = {c: OTHER + 1 + i for i, c in enumerate(beyond)}
        self.read = np.zeros(OTHER + 1 + len(beyond), np.int64)
        for i, c in enumerate(letters):
            self.read[self.code.get(c, ord(c))] = i + 1
        for c in range(97, 123):
            self.read[c - 32] = self.read[c]
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[frozenset] = [frozenset()]
        self.table = np.zeros((64, len(self.means)), np.int32)
        self.best, self.which = np.full(64, 9, np.int8), np.zeros(64, np.int32)
        self._number(self._close({(0, ""): 0}))

    def _number(self, state: frozenset) -> int:
        if state not in self.number:
            n = self.number[state] = len(self.states)
            self.states.append(state)
            if n >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.best = np.concatenate([self.best, np.full(len(self.best), 9, np.int8)])
                self.which = np.concatenate([self.which, np.zeros_like(self.which)])
            self.table[n] = -1
            self.best[n], self.which[n] = min([(e, self.term[p]) for (p, wait), e in state if not wait and self.limit[p] >= e], default=(9, 0))
        return self.number[state]

    def _close(self, items: dict) -> frozenset:
        """Items are (node, a letter that must come as it changed places with the last one, or ""): edits."""
        todo = list(items.items())
        while todo:  # letters of the term that the word lost
            (p, wait), e = todo.pop()
            if items.get((p, wait)) == e and (p or not self.first) and not wait:
                for q in self.kids[p].values():
                    if e + 1 <= self.allowed[q] and items.get((q, ""), 9) > e + 1:
                        items[q, ""] = e + 1
                        todo.append(((q, ""), e + 1))
        return frozenset(items.items())

    def _step(self, state: frozenset, letters: str) -> frozenset:
        out: dict[tuple, int] = {}
        allowed, kids = self.allowed, self.kids

        def put(p, e, wait=""):
            if e <= allowed[p] and out.get((p, wait), 9) > e:
                out[p, wait] = e

        for (p, wait), e in state:
            if wait:
                if wait in letters:
                    put(p, e)
                continue
            free = (p or not self.first) and e < allowed[p]
            for c, q in kids[p].items():
                if c in letters:
                    put(q, e)
                elif free:
                    put(q, e + 1)
                if free:
                    for c2, q2 in kids[q].items():
                        if c2 in letters and c2 != c:
                            put(q2, e + 1, c)
            if free:
                put(p, e + 1)
        return self._close(out)

    def advance(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        to = self.table[state, cls]
        if (to < 0).any():
            width = len(self.means)
            for x in np.unique(state[to < 0].astype(np.int64) * width + cls[to < 0]).tolist():
                n = self._number(self._step(self.states[x // width], self.means[x % width]))
                self.table[x // width, x % width] = n
            to = self.table[state, cls]
        return to

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The characters of all texts by their codes, and where each text starts (and the last ends)."""
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        data = _kinds()[chars]
        for c, i in self.code.items():
            data[chars == ord(c)] = i
        return data, off


@lru_cache(2)
def automaton(lexicon: tuple[str, ...], first: bool = True, allow: tuple[int, ...] | None = None) -> Automaton:
    return Automaton(lexicon, first, allow)


def _forget() -> None:
    automaton.cache_clear()
    _kinds.cache_clear()


def edits(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: tuple[str, ...], first: bool = True, allow: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each word the edits to the nearest term in reach, 9 if there is none, and the number of that term. first: words must begin as the term does."""
    out, term = np.full(len(starts), 9, np.int8), np.zeros(len(starts), np.int32)
    if not len(starts) or not lexicon:
        return out, term
    a = automaton(lexicon, first, allow)
    size, j = ends - starts, 1
    code = np.append(a.read, 0)  # codes beyond the lexicon's are other letters
    read = lambda at: code[np.minimum(data[at], len(code) - 1)]
    state = a.advance(np.ones(len(starts), np.int64), read(starts))
    live = np.flatnonzero(state)
    state = state[live]
    while len(live):
        over = size[live] == j
        out[live[over]], term[live[over]] = a.best[state[over]], a.which[state[over]]
        live, state = live[~over], state[~over]
        state = a.advance(state, read(starts[live] + j)) if len(live) else state
        on = state > 0
        live, state, j = live[on], state[on], j + 1
    return out, term


def _plain(text: str) -> str:
    text = text.lower()
    return _RUNS.sub(lambda m: " " * len(m[0]), text) if "$$$" in text or "@@@" in text else text


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each text's first word (and one past the last)."""
    inside = (data >= 128) | TOKEN[np.minimum(data, 255)]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edges = off[off < len(data)]
    before[edges] = False  # a text starts anew
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[off[off > 0]] = False
    return starts, np.flatnonzero(inside & ~after[1:]) + 1, np.searchsorted(starts, off)


def _quoted(data: np.ndarray, s: int, e: int) -> bool:
    """A quotation mark directly before or after."""
    return bool(s and data[s - 1] in (34, 39, 96)) or bool(e < len(data) and data[e] in (34, 39, 96))


def hits(texts: list[str], lexicon: tuple[str, ...], allow: tuple[int, ...] | None = None) -> list[list[tuple]]:
    """(place, term, misspelled, factor, word, edits) of each hit of each text; factor comes from its context."""
    out: list[list[tuple]] = [[] for _ in texts]
    if not lexicon:
        return out
    texts = [_plain(t) for t in texts]
    data, off = automaton(lexicon, False, allow).coded(texts)
    starts, ends, first = _words(data, off)
    found, term = edits(data, starts, ends, lexicon, False, allow)
    at = np.flatnonzero(found < 9)
    flat = "".join(texts) if len(at) else ""
    word = lambda i: flat[starts[i] : ends[i]]
    for d, i in zip((np.searchsorted(first, at, "right") - 1).tolist(), at.tolist()):
        a, z, factor = int(first[d]), int(first[d + 1]), 1.0
        if not {word(j) for j in range(max(a, i - WINDOW), min(z, i + WINDOW + 1))}.isdisjoint(ADDRESS):
            factor *= 2
        if not {word(j) for j in range(max(a, i - QUOTE_WINDOW), i)}.isdisjoint(ABOUT) or _quoted(data, int(starts[i]), int(ends[i])):
            factor /= 4
        out[d].append((i - a, lexicon[term[i]], bool(found[i]), factor, word(i), int(found[i])))
    return out


# ---------------------------------------------------------------- what labels teach


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("lab_id")).agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))


def _vocabulary(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str | None, fit_rows: int, scratch: Scratch) -> DataFrame:
    """(lang, word, tox, all, support) of the words of the sample: occurrences in toxic documents and in all, neighbourhoods in toxic ones."""
    rows = docs.select(F.col(doc_id).alias("id"), (F.col(lang) if lang in docs.columns else F.lit("")).alias("lang"), F.col(text).alias("t"))
    of = rows.select("id", "lang").join(_labelled(labels), F.col("id") == F.col("lab_id")).select("lab_id", "toxic", "lang", (F.pmod(F.xxhash64("lab_id"), F.lit(1 << 30)) / float(1 << 30)).alias("u")).distinct()
    of = scratch.save(of, "labelled")
    share = of.groupBy(F.col("lang").alias("l")).agg((fit_rows / F.count("*")).alias("share"))
    ids = scratch.save(of.join(share, F.col("lang").eqNullSafe(F.col("l"))).where("u < share").select("lab_id", "toxic").distinct(), "sample")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    cut = F.regexp_replace(F.lower("t"), r"\${3,}|@{3,}", " ")
    ws = F.filter(F.split(cut, r"[^\p{L}\p{M}\p{N}$@]+"), lambda w: w != "")
    few = rows.join(ids, F.col("id") == F.col("lab_id")).select("lang", "toxic", ws.alias("ws"))
    near = lambda i: F.coalesce(F.get("ws", i), F.lit(""))
    each = few.select("lang", "toxic", F.explode(F.transform("ws", lambda w, i: F.struct(w.alias("word"), F.when(F.col("toxic") == 1, F.pmod(F.xxhash64(near(i - 1), near(i + 1)), F.lit(64)).cast("int")).alias("b")))).alias("x"))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("x.b")))
    return scratch.save(each.groupBy("lang", F.col("x.word").alias("word")).agg(F.sum("toxic").alias("tox"), F.count("*").alias("all"), F.bit_count(bits).alias("support")), "words")


def _alike(lexicon: tuple[str, ...]):
    """(term, edits) of each word that is near a term."""

    def run(batches):
        for b in batches:
            words = b.column("word").to_pylist()
            data, off = automaton(lexicon, False).coded(words)
            found, term = edits(data, off[:-1], off[1:], lexicon, False)
            at = np.flatnonzero((found < 9) & (found > 0))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(term[at].astype(np.int32)), pa.array(found[at].astype(np.int32))], ["term", "e"])

    return run


def learned(docs: DataFrame, labels: DataFrame, lexicon: tuple[str, ...], doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", fit_rows: int = FIT_ROWS) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """The lexicon with what labels teach, and the edits that each term allows."""
    scratch = Scratch(docs.sparkSession)
    words = _vocabulary(docs, labels, doc_id, text, lang, fit_rows, scratch)
    apart = F.when(F.col("support") < 60, F.least("tox", -64 * F.log1p(-F.col("support") / 64))).otherwise(F.col("tox"))  # occurrences in toxic documents without those of copies
    size = words.groupBy("lang").agg(F.sum(apart).alias("lt"), F.sum(apart + F.col("all") - F.col("tox")).alias("la"), F.count("*").alias("v")).withColumnRenamed("lang", "l")
    w = words.where(f"support > 1 and tox >= {PRECISION} * all").join(size, F.col("lang").eqNullSafe(F.col("l")))
    q, p = F.col("tox") / F.col("all"), F.col("lt") / F.col("la")
    kl = F.col("support") * F.log(q / p) + F.when(q < 1, (F.col("support") / q - F.col("support")) * F.log((1 - q) / (1 - p))).otherwise(0)
    taken: dict[str, set] = {}  # the languages that taught a word
    for r in w.where((q > p) & (kl >= F.log(F.col("v") / ALPHA))).select("word", "lang").collect():
        taken.setdefault(r.word, set()).add(r.lang)
    lex = tuple(sorted({*lexicon, *taken}))
    harmless = words.where(f"tox < {PRECISION / 2} * all").select("word").distinct()
    near = {(r.term, r.e): r["count"] for r in harmless.mapInArrow(tidied(_alike(lex), _forget), "term int, e int").groupBy("term", "e").count().collect()} if lex else {}
    within = [[sum(near.get((i, e), 0) for e in range(1, k + 1)) for k in range(_default(t) + 1)] for i, t in enumerate(lex)]
    crowd: dict = {}
    for t, x in zip(lex, within):
        for lg in taken.get(t, ()) if t not in lexicon else ():
            for k, c in enumerate(x):
                crowd.setdefault((lg, k), []).append(c)
    thin = {key: sum(x) <= CROWD * len(x) for key, x in crowd.items()}
    sound = lambda t, k, c: c <= ALIKE if t in lexicon else c == 0 and all(thin[lg, k] for lg in taken[t])
    allow = tuple(max(k for k, c in enumerate(x) if sound(t, k, c)) for t, x in zip(lex, within))
    scratch.drop(words)
    return lex, allow


HIT = "array<struct<place:int,term:string,misspelled:boolean,factor:double,word:string,edits:int>>"


def _find(lexicon: tuple[str, ...], allow: tuple[int, ...] | None):
    kind = pa.list_(pa.struct([("place", pa.int32()), ("term", pa.string()), ("misspelled", pa.bool_()), ("factor", pa.float64()), ("word", pa.string()), ("edits", pa.int32())]))
    names = ("place", "term", "misspelled", "factor", "word", "edits")

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column("t").to_pylist()]
            for lo, hi in slices(np.array([len(t) for t in texts], np.int64), 1_000_000):
                found = hits(texts[lo:hi], lexicon, allow)
                has = [i for i, f in enumerate(found) if f]
                if has:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([lo + i for i in has])), pa.array([[dict(zip(names, x)) for x in found[i]] for i in has], kind)], ["doc_id", "found"])

    return run

Known = tuple[dict[str, float], dict[tuple[str, str], tuple[int, int]], float, frozenset]


def weights(found: DataFrame, labels: DataFrame | None, lexicon: tuple[str, ...], taught: frozenset = frozenset()) -> Known:
    """What each term weighs as written; of its misspelled forms in labelled documents, how many documents have it and how many of these are toxic; how far a lone learned term counts, and which are learned."""
    a, b = PRIOR
    out, forms = dict.fromkeys(lexicon, a / (a + b)), {}
    if labels is None:
        return out, forms, 1.0, taught
    lab = _labelled(labels).withColumnRenamed("lab_id", "doc_id")
    once = found.select("doc_id", F.explode(F.array_distinct(F.transform("found", lambda h: F.struct(h.term.alias("term"), F.when(h.misspelled, h.word).otherwise("").alias("form"))))).alias("h"))
    for r in once.join(lab, "doc_id").groupBy("h").agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("k")).collect():
        if r.h.form:
            forms[r.h.term, r.h.form] = (r.n, r.k)
        else:
            out[r.h.term] = (r.k + a) / (r.n + a + b)
    terms = F.array_distinct(F.transform("found", lambda h: h.term))
    lone = found.where((F.size(terms) == 1) & terms[0].isin(*taught)).join(lab, "doc_id").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first() if taught else None
    return out, forms, ((lone.k or 0) + 1) / (lone.n + 1) if lone else 1.0, taught


def weight(h: dict, known: Known) -> float:
    """Of a hit, without its context."""
    out, forms, _, _ = known
    w = out[h["term"]] * DISCOUNT ** h["edits"]
    if not h["misspelled"]:
        return w
    n, k = forms.get((h["term"], h["word"]), (0, 0))
    return (k + FORM * w) / (n + FORM)


def score(found: list[dict], known: Known) -> float:
    """The largest sum of weights within WINDOW words."""
    places = np.array([h["place"] for h in found])
    total = np.concatenate([[0.0], np.cumsum([weight(h, known) * h["factor"] for h in found])])
    lone = known[2] if len(terms := {h["term"] for h in found}) == 1 and terms <= known[3] else 1.0
    return lone * float((total[np.searchsorted(places, places + WINDOW, "right")] - total[:-1]).max())


def _score(known: Known):
    def run(batches):
        for b in batches:
            found = b.column("found").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([round(score(f, known), 4) for f in found], pa.float64()), pa.array([len(f) for f in found], pa.int64()), pa.array([sorted({h["word"] for h in f}) for f in found], pa.list_(pa.string()))],
                ["doc_id", "score", "hits", "words"],
            )

    return run


def suspected(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", lexicon: list[str] = LEXICON, lang: str | None = "lang") -> DataFrame:
    """(doc_id, score, hits, words) of every document with a hit."""
    given = lex = tuple(sorted({w.lower() for w in lexicon if w}))
    allow = None
    if labels is not None:
        lex, allow = learned(docs, labels, lex, doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    of = lambda ddl: StructType([rows.schema["doc_id"], *StructType.fromDDL(ddl)])
    found = Scratch(docs.sparkSession).save(rows.mapInArrow(tidied(_find(lex, allow), _forget), of(f"found {HIT}")), "hits")
    return found.mapInArrow(tidied(_score(weights(found, labels, lex, frozenset(lex) - frozenset(given)))), of("score double, hits bigint, words array<string>"))


def toxic(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, **how) -> DataFrame:
    """(doc_id, score, hits, words) of the toxic documents."""
    return suspected(docs, labels, **how).where(F.col("score") >= threshold)
