"""What several operators share: scratch tables, row keys, words and hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="srclattice-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables in the shared folder: they cut lineage and outlive executors.

    A table may be dropped once nothing reads it; the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/srclattice-{uuid.uuid4().hex}", 0
        atexit.register(self._quietly_drop_all)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables, and let Spark clean the shuffle files that only they needed."""
        for t in tables:
            self._delete(t._scratch_path)  # type: ignore[attr-defined]
        release(self.spark)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _quietly_drop_all(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.root)
            except Exception:  # noqa: BLE001 - the JVM may already be gone at exit
                pass


def beside(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A table for one side of a join: it goes to every executor if it has that many rows at most; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects their handles; ask for that between large steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@lru_cache(1)
def _frugal() -> None:
    """Python workers live on between tasks: have freed arrays go back to the system at once, rather than into pools."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: fixed, where it would grow to 32 MB
    except (AttributeError, OSError):
        pass  # another C library


_held: list = []


def _claim(forget) -> None:
    if _held and _held[0] is not forget:
        _held.pop()()
    if forget is not None:
        _held[:] = [forget]


def tidied(run, forget=None):
    """A function over batches that returns memory after its partition.

    forget drops the model that the function keeps for its next partition; that happens when a
    partition of another operator comes to the same worker, so it holds one model at a time.
    """

    def tidy_run(batches):
        _frugal()  # in workers only
        _claim(forget)
        try:
            yield from run(batches)
        finally:
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass

    return tidy_run


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def text_key(text: Column) -> Column:
    """128 bits of a text; NULL for a text without letters or digits."""
    return F.when(has_words(text), F.unhex(F.md5(text.cast("binary"))))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * M2
    x = x ^ (x >> np.uint64(27))
    x = x * M3
    return x ^ (x >> np.uint64(31))


#: Which bytes belong to words. PLAIN: all but ASCII white space. ALNUM: letters, digits and every byte of a non-ASCII character.
PLAIN = np.ones(256, bool)
PLAIN[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def utf8(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text starts (and the last ends)."""
    a = pa.array(texts, pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[: len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_spans(texts: list[str], word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and the start and end of each word in them; and each text's first word (and one past the last)."""
    data, off = utf8(texts)
    if not len(data):
        z = np.zeros(0, np.int64)
        return data, z, z, np.zeros(len(texts) + 1, np.int64)
    inside = word_bytes[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = off[(off > 0) & (off < len(data))]
    before[edges] = False  # a text starts anew
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return data, starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, all words in step, byte by byte."""
    size = ends - starts
    h = size.astype(np.uint64) * M3
    live, j = np.arange(len(starts)), 0
    left = size
    while len(live):
        if len(live) == len(h):
            h = (h ^ data[starts + j]) * M1
        else:
            h[live] = (h[live] ^ data[starts[live] + j]) * M1
        j += 1
        keep = left > j
        live, left = live[keep], left[keep]
    return mix(h)


def slices(sizes: np.ndarray, at_most: int):
    """Ranges of consecutive items of about at_most in total; a larger item is alone."""
    lo, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if total and total + s > at_most:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start+1 ... for size items, for each pair in turn."""
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    return np.arange(n, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)
