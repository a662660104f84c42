"""From raw documents to token ids: five stages, each written as Parquet and read again.

1. language_id: documents that are no text of a known language go.
2. minhash_dedup: of each group of near duplicates one document stays.
3. suffix_dedup: passages of 50 words or more stay at their first occurrence only.
4. mixing: sources get their target shares; documents are left out or repeated for it.
5. byte_bpe: what is left becomes token ids with offsets.

All but the last return the columns of documents. ORACLE_SQL is None, as SQL cannot
express stages 1, 2, 3 and 5.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from srclattice.llm.common import Scratch, table
from srclattice.llm.op1_mixing import mix
from srclattice.llm.op3_bpe import encode
from srclattice.llm.op4_langid import known_language
from srclattice.llm.op5_suffix import cut_repeats
from srclattice.llm.op9_minhash import drop_near_duplicates
from srclattice.session import ship


def language_id(spark, docs, sf_dir):
    return known_language(docs)


def minhash_dedup(spark, docs, sf_dir):
    return drop_near_duplicates(docs)


def suffix_dedup(spark, docs, sf_dir):
    return cut_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mixing(spark, docs, sf_dir):
    return mix(docs)


def byte_bpe(spark, docs, sf_dir):
    return encode(docs)


STAGES = [("language_id", language_id), ("minhash_dedup", minhash_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; what comes between them is a table in the shared folder."""
    docs, scratch = table(ship(spark), sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
