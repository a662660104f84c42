"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from ..session import ship
from . import op1_mixing, op2_urls, op3_bpe, op4_langid, op5_suffix, op6_topk, op7_chat, op8_toxicity, op9_minhash, op10_hosts
from .common import table


def op1_pareto_mixing(spark, sf_dir):
    return op1_mixing.sample(table(ship(spark), sf_dir, "documents"))


def op2_url_reputation(spark, sf_dir):
    return op2_urls.filter_urls(table(ship(spark), sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark, sf_dir):
    return op3_bpe.encode(table(ship(spark), sf_dir, "documents"), again=True)


def op4_language_id(spark, sf_dir):
    return op4_langid.identified(table(ship(spark), sf_dir, "documents"))


def op5_suffix_dedup(spark, sf_dir):
    return op5_suffix.repeats(table(ship(spark), sf_dir, "documents"))


def op6_exact_topk(spark, sf_dir):
    return op6_topk.top_k(table(ship(spark), sf_dir, "embeddings"), every=op6_topk.EVERY)


def op7_chat_format(spark, sf_dir):
    return op7_chat.render(op7_chat.as_log(table(ship(spark), sf_dir, "conversations")))


def op8_toxic_terms(spark, sf_dir):
    return op8_toxicity.toxic(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minhash_dedup(spark, sf_dir):
    return op9_minhash.near_duplicates(table(ship(spark), sf_dir, "documents"))


def op10_host_rules(spark, sf_dir):
    return op10_hosts.keep_good_hosts(table(ship(spark), sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_pareto_mixing, op2_url_reputation, op3_byte_bpe, op4_language_id, op5_suffix_dedup, op6_exact_topk, op7_chat_format, op8_toxic_terms, op9_minhash_dedup, op10_host_rules)
}
SQL = {"op1_pareto_mixing": op1_mixing.SQL, "op2_url_reputation": op2_urls.SQL, "op6_exact_topk": op6_topk.SQL, "op7_chat_format": op7_chat.SQL, "op10_host_rules": op10_hosts.SQL}
