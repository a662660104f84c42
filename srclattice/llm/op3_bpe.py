"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary of byte-level BPE spells tokens in printable characters, one for each byte;
_BYTE_OF is the table back. Merges never cross the parts that the vocabulary's pattern cuts a
text into, and the pattern always cuts where a run of white space begins after something
else, and where a sign or number follows a letter. So texts are cut there, equal pieces are cut by the pattern, spelt and
encoded by the library once, and ids are put together again;
texts with white space beyond ASCII, where that cut may be wrong, are encoded whole. Every
text is decoded again and compared; should two pieces ever share a hash, the text is
encoded whole as well. So is every text where the file has another pattern, a normaliser or a prefix space. The result is that of the library.
A file that is no byte-level BPE is an error.

Offsets are characters of the text. A token is bytes from the end of the one before to its
own end, and a character begins at each byte that is no continuation byte. `starts` has
for each token the character that its first byte belongs to; where a character is split
over tokens, they all have that character, and their places are in `split` (the tokens
that begin inside a character). So token i ends before character starts[i+1], or after it
if i+1 is in `split`.

Decoding joins the bytes of the tokens; split characters are whole again there, and bytes that are
no UTF-8 (ids cut off inside a character) become U+FFFD, as the library does it.

Defined cases: a NULL text has NULL ids and offsets, an empty one none. Strings of
special tokens in a text are ordinary text. Ids and texts of any number and length are taken; every row is encoded,
repeated ones too. Ids of rows are of any type. Decoding takes NULL ids as NULL; an id that the vocabulary lacks is an
error. Other columns than the named ones are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import ragged, slices, tidied, utf8, word_hashes

VOCABULARY = os.environ.get("SRCLATTICE_BPE", "/opt/tokenizers/byte_bpe_50k.json")
CACHE = 400_000
_WHITE = r"\t-\r \x85\xa0  -     　"
_WIDE_SPACE = regex.compile(r"[\x85\xa0  -     　]")
#: How a vocabulary of this kind cuts a text: contractions; letters, numbers or other signs, each with a space before; white space.
_PARTS = regex.compile(rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _printable() -> dict[str, int]:
    """The byte that each character of the vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTE_OF = _printable()
_SPELT = {b: c for c, b in _BYTE_OF.items()}
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:65] = _SIGN[91:97] = _SIGN[123:127] = True


def _after_letter(data: np.ndarray) -> np.ndarray:
    """Whether a letter ends before each byte: an ASCII one, or one of U+00C0 to U+024F."""
    out = np.zeros(len(data), bool)
    out[1:] = _ASCII_LETTER[data[:-1]]
    lead, rest = data[:-2], data[1:-1]
    out[2:] |= (lead >= 0xC3) & (lead <= 0xC8) & (rest >= 0x80) & (rest < 0xC0) & ~((lead == 0xC3) & ((rest == 0x97) | (rest == 0xB7)))
    return out


class Codec:
    """A vocabulary, and the pieces that were encoded last."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        said = json.loads(self.tok.to_str())
        before = said["pre_tokenizer"] or {}
        if said["model"]["type"] != "BPE" or said["model"].get("end_of_word_suffix") or said["model"].get("continuing_subword_prefix") or "ByteLevel" not in json.dumps(before) or not set("".join(self.tok.get_vocab(False))) <= set(_BYTE_OF):
            raise ValueError(f"{path} is no byte-level BPE")
        #: Whether texts may be cut as _PARTS does.
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said["normalizer"]
        special = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        words = {i: w for w, i in self.tok.get_vocab(True).items()}
        self.bytes = [special[i].encode() if i in special else bytes(_BYTE_OF[c] for c in words[i]) if i in words else b"" for i in range(max(words) + 1)]
        self.known = np.array([i in words for i in range(len(self.bytes))])
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.flat, self.at = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.sizes) - self.sizes
        from tokenizers import pre_tokenizers

        self.plain = Tokenizer(self.tok.model)  # for parts that are cut and spelt already
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.forget()

    def forget(self) -> None:
        self.hashes, self.where, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        spelt = [x.encode().decode("latin-1").translate(_SPELT) for p in pieces for x in _PARTS.findall(p)]
        lists = [e.ids for e in self.plain.encode_batch_fast([" ".join(spelt[i : i + 2000]) for i in range(0, len(spelt), 2000)], add_special_tokens=False)]
        ids = np.concatenate([np.array(x, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
        want = np.cumsum([len(p.encode()) for p in pieces])
        upto = np.searchsorted(np.cumsum(self.sizes[ids]), want) + 1
        return ids, np.diff(upto, prepend=0)

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        if len(self.hashes) > CACHE:
            self.forget()
        ids, count = self._encode_pieces(pieces)
        base = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.hashes, h)  # both are sorted
        self.hashes, self.where, self.count = np.insert(self.hashes, at, h), np.insert(self.where, at, base + np.cumsum(count) - count), np.insert(self.count, at, count)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        if not self.cuts:
            lists = self._encode(texts)
            return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)
        data, off = utf8(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        space = _SPACE[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = space[1:] & ~space[:-1]
        cut |= _SIGN[data] & _after_letter(data)
        cut[off[:-1][off[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        h = word_hashes(data, starts, ends)
        u, first, which = np.unique(h, return_index=True, return_inverse=True)
        p = np.searchsorted(self.hashes, u)
        new = np.ones(len(u), bool)
        inside = p < len(self.hashes)
        new[inside] = self.hashes[p[inside]] != u[inside]
        if len(self.hashes) + new.sum() > CACHE and len(self.hashes):
            self.forget()
            new[:] = True
        if new.any():
            raw = data.tobytes()
            self._learn(u[new], [raw[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        p = np.searchsorted(self.hashes, u)[which]
        count = self.count[p]
        ids = self.ids[ragged(self.where[p], count)]
        each = np.add.reduceat(np.append(count, 0), np.searchsorted(starts, off[:-1])) * (np.diff(off) > 0)
        wrong = {i for i, t in enumerate(texts) if not t.isascii() and _WIDE_SPACE.search(t)}
        back, sizes = self.joined(ids), self.sizes[ids]
        ends_of = np.cumsum(each)
        got = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends_of])]
        if len(back) != len(data) or not np.array_equal(got, off) or not np.array_equal(back, data):
            wrong |= {i for i in range(len(texts)) if back[got[i] : got[i + 1]].tobytes() != data[off[i] : off[i + 1]].tobytes()}
        if wrong:
            parts = np.split(ids, ends_of[:-1])
            some = sorted(wrong)
            for i, x in zip(some, self._encode([texts[i] for i in some])):
                parts[i] = np.array(x, np.int32)
            ids, each = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, each

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after another."""
        return self.flat[ragged(self.at[ids], self.sizes[ids])]

    def decode(self, lists: list) -> list[str]:
        count = np.array([len(x) for x in lists], np.int64)
        ids = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.known[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        raw = self.joined(ids).tobytes()
        end = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], np.cumsum(count)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(end, end[1:])]

    def offsets(self, ids: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the character in its text that its first byte belongs to, and whether it begins inside one."""
        data = self.joined(ids)
        begins = (data & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(begins)])
        at = np.cumsum(self.sizes[ids]) - self.sizes[ids]
        inside = ~np.append(begins, True)[at]
        start = chars[at] - inside
        first = np.cumsum(each) - each
        base = chars[np.append(at, len(data))[first]]
        return (start - np.repeat(base, each)).astype(np.int32), inside


@lru_cache(2)
def codec(path: str) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path)


def _forget() -> None:
    codec.cache_clear()


def _encoded(path: str, again: bool):
    """again: also the digest of each text as it is decoded from its ids."""

    def run(batches):
        c = codec(path)
        for b in batches:
            texts, ids_col = b.column("t").to_pylist(), b.column("id")
            for lo, hi in slices(np.array([len(t or "") for t in texts], np.int64), 1_000_000):
                some = texts[lo:hi]
                null = np.array([t is None for t in some])
                ids, each = c.encode([t or "" for t in some])
                starts, inside = c.offsets(ids, each)
                ends = np.concatenate([[0], np.cumsum(each)])
                off = pa.array(ends.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(ends.astype(np.int32))
                at = np.flatnonzero(inside)
                d = np.searchsorted(ends, at, "right") - 1
                soff = np.searchsorted(at, ends).astype(np.int32)
                soff = pa.array(soff, mask=np.append(null, False)) if null.any() else pa.array(soff)
                lists = [pa.ListArray.from_arrays(off, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(starts)), pa.ListArray.from_arrays(soff, pa.array((at - ends[d]).astype(np.int32)))]
                names = ["doc_id", "n_tokens", "ids", "starts", "split"]
                if again:
                    back = c.decode(np.split(ids, ends[1:-1]))
                    lists.append(pa.array([None if n else hashlib.md5(t.encode()).hexdigest() for n, t in zip(null.tolist(), back)], pa.string()))
                    names.append("decoded_md5")
                yield pa.RecordBatch.from_arrays([ids_col.slice(lo, hi - lo), pa.array(each, mask=null), *lists], names)

    return run


TOKENS = "n_tokens bigint, ids array<int>, starts array<int>, split array<int>"


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, again: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, starts, split) of every document; again: and decoded_md5, of the text that the ids decode to."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    out = StructType([StructField("doc_id", rows.schema["id"].dataType), *StructType.fromDDL(TOKENS + ", decoded_md5 string" * again)])
    return rows.mapInArrow(tidied(_encoded(vocabulary, again), _forget), out)


def ends(starts, split, n_chars) -> list[int]:
    """Where each token ends (the character after it)."""
    inside = set(split)
    return [s + (i in inside) for i, s in enumerate([*starts[1:], n_chars], 1)] if starts else []


def _decoded(path: str):
    def run(batches):
        c = codec(path)
        for b in batches:
            lists = b.column("ids").to_pylist()
            texts = c.decode([x or [] for x in lists])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else t for x, t in zip(lists, texts)], pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) again."""
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(tidied(_decoded(vocabulary), _forget), StructType([rows.schema["doc_id"], StructField("text", StringType())]))
