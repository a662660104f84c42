"""URL filter by the reputation of hosts, shrunk through two levels of beta priors.

Labelled pages give each host, registered domain and suffix its good and its labelled
pages. The overall rate is the prior of suffixes, a suffix's posterior mean that of its
domains, a domain's that of its hosts; how many observations a prior counts for is fitted
by moments at each level. A page is kept if its host's posterior mean less Z posterior
standard deviations is MIN_GOOD or more.

A label belongs to the page whose page_id is its doc_id; quality 1 is a good outcome.
Suffixes of two labels are those of SECOND + country (co.uk, gob.mx), and SHARED, under which
everybody has a domain of his own (github.io); there is no list of all public suffixes in here.

Defined cases: a URL that is NULL or has no host belongs to the host '' (likewise domain
and suffix), which is judged like any other. An IPv4 address is its own domain, suffix ''.
Labels with a NULL id or quality do not count; several labels of a page count each; a page
listed twice counts and is returned twice. Without any label the overall rate is 1/2.
Other columns than the named ones are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside
from .priors import low_bound, strength, strength_sql

Z, MIN_GOOD = 1.645, 0.5
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
SECOND = "co|com|org|net|ac|gov|edu|mil|sch|ltd|plc|ne|or|go|gob|gouv|gub".split("|")
SHARED = "github.io gitlab.io blogspot.com wordpress.com tumblr.com herokuapp.com appspot.com netlify.app vercel.app pages.dev web.app weebly.com wixsite.com".split()
DOMAIN = rf"([^.]+\.(?:(?:{'|'.join(SECOND)})\.[a-z][a-z]|{'|'.join(x.replace('.', chr(92) + '.') for x in SHARED)}|[^.]+))$"


def host_of(url: Column) -> Column:
    return F.coalesce(F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit(".")), F.lit(""))


def domain_of(host: Column) -> Column:
    d = F.regexp_extract(host, DOMAIN, 1)  # the leftmost match, so the longest suffix
    return F.when(host.rlike(r"^[0-9.]+$") | (d == ""), host).otherwise(d)


def suffix_of(domain: Column) -> Column:
    return F.when(domain.rlike(r"^[0-9.]+$"), "").otherwise(F.regexp_extract(domain, r"^[^.]+\.(.*)$", 1))


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, domain, suffix, labelled, good, mean, bound) of every host."""
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("g"))
    known = pages.select("page_id", host_of(F.col("url")).alias("host")).join(lab, F.col("page_id") == lab.doc_id, "left")
    hosts = known.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hn"), F.coalesce(F.sum("g"), F.lit(0)).alias("hg"))
    scratch = Scratch(pages.sparkSession)
    hosts = scratch.save(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))), "hosts")  # read four times
    domains = scratch.save(hosts.groupBy("suffix", "domain").agg(F.sum("hn").alias("dn"), F.sum("hg").alias("dg")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dg").alias("sg"))
    overall = suffixes.agg(((F.coalesce(F.sum("sg"), F.lit(0)) + 1) / (F.coalesce(F.sum("sn"), F.lit(0)) + 2)).alias("p0"), strength("sn", "sg").alias("ms"))
    fitted = overall.crossJoin(domains.agg(strength("dn", "dg").alias("md"))).crossJoin(hosts.agg(strength("hn", "hg").alias("mh")))
    s = suffixes.crossJoin(F.broadcast(fitted)).withColumn("sp", (F.col("ms") * F.col("p0") + F.col("sg")) / (F.col("ms") + F.col("sn")))  # fitted: one row
    d = domains.join(s, "suffix").withColumn("dp", (F.col("md") * F.col("sp") + F.col("dg")) / (F.col("md") + F.col("dn")))
    h = hosts.join(d.select("domain", "dp", "mh"), "domain")
    a, b = F.col("mh") * F.col("dp") + F.col("hg"), F.col("mh") * (1 - F.col("dp")) + F.col("hn") - F.col("hg")
    return h.select("host", "domain", "suffix", F.col("hn").alias("labelled"), F.col("hg").alias("good"), F.round(a / (a + b), 6).alias("mean"), F.round(low_bound(a, b, Z), 6).alias("bound"))


def judged_urls(pages: DataFrame, labels: DataFrame, min_good: float = MIN_GOOD) -> DataFrame:
    """(page_id, host, domain, suffix, labelled, good, mean, bound, keep) of every page."""
    pages = pages.select("page_id", "url")
    r = Scratch(pages.sparkSession).save(reputations(pages, labels), "reputations")
    out = pages.select("page_id", host_of(F.col("url")).alias("host")).join(beside(r), "host")
    return out.select("page_id", "host", "domain", "suffix", "labelled", "good", "mean", "bound", (F.col("bound") >= min_good).alias("keep"))


def filter_urls(pages: DataFrame, labels: DataFrame, min_good: float = MIN_GOOD) -> DataFrame:
    """(page_id, host, domain, suffix, labelled, good, mean, bound) of the pages that stay."""
    return judged_urls(pages, labels, min_good).where("keep").drop("keep")


SQL = f"""
with p as (select page_id, rtrim(regexp_extract(lower(url), '{HOST}', 1), '.') host from pages),
l as (select doc_id, count(*) n, sum(case when quality = 1 then 1 else 0 end) g from labels where quality is not null group by doc_id),
h0 as (select host, coalesce(sum(n), 0)::bigint hn, coalesce(sum(g), 0)::bigint hg from p left join l on page_id = doc_id group by host),
h1 as (select *, case when regexp_matches(host, '^[0-9.]+$') or regexp_extract(host, '{DOMAIN}', 1) = '' then host else regexp_extract(host, '{DOMAIN}', 1) end as domain from h0),
h as (select *, case when regexp_matches(domain, '^[0-9.]+$') then '' else regexp_extract(domain, '^[^.]+\\.(.*)$', 1) end suffix from h1),
d as (select suffix, domain, sum(hn)::bigint dn, sum(hg)::bigint dg from h group by all),
s as (select suffix, sum(dn)::bigint sn, sum(dg)::bigint sg from d group by suffix),
f as (select (sum(sg) + 1)::double / (sum(sn) + 2) p0 from s),
ms as (select {strength_sql('sn', 'sg')} ms from s where sn > 0),
md as (select {strength_sql('dn', 'dg')} md from d where dn > 0),
mh as (select {strength_sql('hn', 'hg')} mh from h where hn > 0),
sp as (select suffix, (ms * p0 + sg) / (ms + sn) sp from s, f, ms),
dp as (select domain, (md * sp + dg) / (md + dn) dp from d join sp using (suffix), md),
ab as (select host, h.domain, suffix, hn, hg, mh * dp + hg a, mh * (1 - dp) + hn - hg b from h join dp on dp.domain = h.domain, mh),
r as (select *, round(a / (a + b), 6) mean, round(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) bound from ab)
select page_id, host, domain, suffix, hn as labelled, hg as good, mean, bound from p join r using (host) where bound >= {MIN_GOOD}
"""
