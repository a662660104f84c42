"""Host-level quality rules.

Each document is held against RULES; a document that breaks any is a failure. Failures are
counted by domain, and a domain's rate of failures is shrunk by a beta prior fitted by
moments over all domains, so that a domain with few documents is judged mostly by the
prior. A domain is bad if its posterior mean less Z posterior standard deviations is over
MAX_RATE. The verdicts are joined back to the documents; those of bad domains go.

The host of a document is that of its source if this is a URL, else the source itself;
domains are registered domains, as in the URL filter.

Defined cases: a NULL or empty source is the domain ''. A NULL or empty text is a document
without words and breaks the rule "short". Every row counts, repeated ones too. Columns
other than the named ones are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside
from .op2_urls import DOMAIN, HOST, domain_of, host_of
from .priors import low_bound, strength, strength_sql

Z, MAX_RATE = 1.645, 0.5
#: name: SQL over w (words), dw (distinct words), n (characters but white space), letters, upper, bars, lines, dl (distinct lines)
RULES = {
    "short": "w < 5",
    "symbols": "n > 0 and 10 * (n - letters) > 4 * n",
    "capitals": "w >= 5 and 10 * upper > 5 * letters",
    "bars": "w >= 5 and 10 * bars > 2 * w",
    "lines": "lines >= 4 and 10 * dl < 7 * lines",
    "words": "w >= 50 and 10 * dw < 2 * w",
}


def measured(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    s = F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.when(s.contains("://"), host_of(s)).otherwise(F.lower(s)).alias("host"), t.alias("t"), F.filter(F.split(t, r"[ \t\n\r\f\x0b]+"), lambda w: w != "").alias("ws"), F.filter(F.split(t, "\n"), lambda x: x != "").alias("ls")
    )
    count = lambda pattern: F.length(F.regexp_replace("t", pattern, "")).cast("bigint")
    return rows.select(
        "doc_id", domain_of(F.col("host")).alias("domain"), F.size("ws").alias("w"), F.size(F.array_distinct("ws")).alias("dw"), count(r"[ \t\n\r\f\x0b]+").alias("n"),
        count(r"[^\p{L}]+").alias("letters"), count(r"[^\p{Lu}]+").alias("upper"), count(r"[^|]+").alias("bars"), F.size("ls").alias("lines"), F.size(F.array_distinct("ls")).alias("dl"),
    )


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """(doc_id, domain, broken, domain_docs, domain_failures, rate, bound, good) of every document."""
    broken = F.array_join(F.filter(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in RULES.items()]), lambda x: x.isNotNull()), ",")
    scratch = Scratch(docs.sparkSession)
    each = scratch.save(measured(docs, doc_id, text, source).select("doc_id", "domain", broken.alias("broken")), "broken")  # texts are measured once
    domains = each.groupBy("domain").agg(F.count("*").alias("dn"), F.sum(F.when(F.col("broken") != "", 1).otherwise(0)).alias("df"))
    prior = domains.agg(strength("dn", "df").alias("m"), ((F.coalesce(F.sum("df"), F.lit(0)) + 1) / (F.coalesce(F.sum("dn"), F.lit(0)) + 2)).alias("p"))
    a, b = F.col("m") * F.col("p") + F.col("df"), F.col("m") * (1 - F.col("p")) + F.col("dn") - F.col("df")
    verdicts = domains.crossJoin(F.broadcast(prior)).select("domain", F.col("dn").alias("domain_docs"), F.col("df").cast("bigint").alias("domain_failures"), F.round(a / (a + b), 6).alias("rate"), F.round(low_bound(a, b, Z), 6).alias("bound"))
    return each.join(beside(scratch.save(verdicts, "verdicts")), "domain").select("doc_id", "domain", "broken", "domain_docs", "domain_failures", "rate", "bound", (F.col("bound") <= max_rate).alias("good"))


def keep_good_hosts(docs: DataFrame, **how) -> DataFrame:
    """The documents of domains that are not bad, with what was found."""
    return judged(docs, **how).where("good").drop("good")


_WORDS = "list_filter(string_split_regex(t, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')"
_LINES = "list_filter(string_split(t, chr(10)), lambda x: x <> '')"
SQL = f"""
with d as (select doc_id, coalesce(text, '') t, lower(coalesce(source, '')) s from documents),
h as (select *, case when contains(s, '://') then rtrim(regexp_extract(s, '{HOST}', 1), '.') else s end host, {_WORDS} ws, {_LINES} ls from d),
m as (select doc_id, case when regexp_matches(host, '^[0-9.]+$') or regexp_extract(host, '{DOMAIN}', 1) = '' then host else regexp_extract(host, '{DOMAIN}', 1) end as domain,
  len(ws) w, len(list_distinct(ws)) dw, length(regexp_replace(t, '[ \\t\\n\\r\\f\\x0b]+', '', 'g')) n, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) letters,
  length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) upper, length(regexp_replace(t, '[^|]+', '', 'g')) bars, len(ls) as lines, len(list_distinct(ls)) dl from h),
e as (select doc_id, domain, concat_ws(',', {', '.join(f"case when {c} then '{k}' end" for k, c in RULES.items())}) broken from m),
v as (select domain, count(*) dn, sum(case when broken <> '' then 1 else 0 end)::bigint df from e group by domain),
f as (select {strength_sql('dn', 'df')} m, (sum(df) + 1)::double / (sum(dn) + 2) p from v),
ab as (select domain, dn, df, m * p + df a, m * (1 - p) + dn - df b from v, f),
r as (select domain, dn, df, round(a / (a + b), 6) rate, round(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) bound from ab)
select doc_id, domain, broken, dn as domain_docs, df as domain_failures, rate, bound from e join r using (domain) where bound <= {MAX_RATE}
"""
