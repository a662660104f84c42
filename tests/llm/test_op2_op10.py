import duckdb
import pytest

from srclattice.llm import op2_urls as u
from srclattice.llm import op10_hosts as h


def test_hosts(spark):
    urls = ["https://User@Blog.a.co.uk:80/x", "http://10.0.0.1/x", "ftp://localhost", "no url", None, "http://b.org./"]
    df = spark.createDataFrame([(x,) for x in urls], "url string")
    d = u.domain_of(u.host_of(df.url))
    got = [tuple(r) for r in df.select(u.host_of(df.url), d, u.suffix_of(d)).collect()]
    assert got == [("blog.a.co.uk", "a.co.uk", "co.uk"), ("10.0.0.1", "10.0.0.1", ""), ("localhost", "localhost", ""), ("", "", ""), ("", "", ""), ("b.org", "b.org", "org")]


def test_shared_suffixes(spark):
    df = spark.createDataFrame([("me.github.io",), ("a.b.gob.mx",), ("x.y.blogspot.com",), ("github.io",), ("www.info.de",)], "h string")
    assert [r[0] for r in df.select(u.domain_of(df.h)).collect()] == ["me.github.io", "b.gob.mx", "y.blogspot.com", "github.io", "info.de"]


def test_very_long_urls_and_clashing_columns(spark):
    long = "http://h.example.org/" + "x" * 2_000_000
    p = spark.createDataFrame([(1, long, "a", 1.0), (2, "http://" + "a" * 100_000 + ".org", "b", 2.0)], "page_id bigint, url string, domain string, bound double")
    la = spark.createDataFrame([(1, 1, "z")], "doc_id bigint, quality int, host string")
    assert sorted((r.page_id, r.domain[-11:]) for r in u.judged_urls(p, la).collect()) == [(1, "example.org"), (2, "aaaaaaa.org")]


def test_bad_hosts_go_and_small_ones_lean_on_their_domain(spark):
    rows, labels = [], []
    for i in range(600):
        host = f"h{i % 30}.{'bad' if i % 30 < 10 else 'good'}.com"
        rows.append((i, f"http://{host}/{i}"))
        if i < 500:
            labels.append((i, int(i % 30 >= 10 or i % 7 == 0), 0))
    rows += [(900, "http://new.bad.com/"), (901, "http://new.good.com/")]
    p, la = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r.keep for r in u.judged_urls(p, la).collect()}
    assert {r.page_id for r in u.filter_urls(p, la).collect()} == {i for i, keep in got.items() if keep} and len(got) == 602 and not got[0] and got[11] and not got[900] and got[901]
    c = duckdb.connect()
    for n, df in (("pages", p), ("labels", la)):
        c.register(n, df.toPandas())
    assert sorted(map(tuple, u.filter_urls(p, la).collect())) == sorted(c.sql(u.SQL).fetchall())


def test_url_edges(spark):
    p = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "http://a.b/", 2), (3, "http://a.b/", 2), (3, "http://a.b/", 2)], "page_id bigint, url string, host int")
    la = spark.createDataFrame([(None, 1), (3, None), (3, 1), (3, 0)], "doc_id bigint, quality int")
    assert u.judged_urls(p, la).count() == 5
    assert u.judged_urls(p, la.limit(0)).count() == 5 and u.filter_urls(p.limit(0), la).count() == 0


def test_rules_and_verdicts(spark):
    good = "Some plain words that make a sentence here and there."
    rows = [(i, "### $$$ %%% &&& ***" if i % 10 else good, "bad") for i in range(100)] + [(100 + i, good, f"http://www.ok{i % 3}.org/x") for i in range(60)] + [(200, "A B\nA B\nA B\nA B\nA B", "ok"), (201, None, None), (202, "x | y | z | w", "ok"), (203, "LOUD LOUD WORDS ARE HERE", "ok")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {r.doc_id: r for r in h.judged(df).collect()}
    assert not out[0].good and out[100].good and out[100].domain == "ok0.org" and out[201].broken == "short"
    assert (out[200].broken, out[202].broken, out[203].broken) == ("capitals,lines", "symbols,bars", "capitals")
    kept = h.keep_good_hosts(df)
    assert kept.where("doc_id < 100").count() == 0
    c = duckdb.connect()
    c.register("documents", df.toPandas().astype({"text": object}).where(lambda x: x.notna(), None))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, c.sql(h.SQL).fetchall()))


def test_rule_edges(hard, none):
    assert h.keep_good_hosts(none).count() == 0
    assert h.judged(hard).count() == hard.count()
    broken = {r.doc_id: r.broken for r in h.judged(hard).where("doc_id > 3").collect()}
    assert broken == {4: "short", 5: "short", 6: "short", 7: "short,symbols", 8: "", 9: "", 10: "short", 11: "short"}


@pytest.mark.parametrize("groups,lo,hi", [([(10, 5)] * 5, 1000, 1000), ([(50, 50), (50, 0)], 2, 2), ([], 1000, 1000)])
def test_strength(spark, groups, lo, hi):
    from srclattice.llm.priors import strength

    df = spark.createDataFrame(groups, "n bigint, k bigint")
    assert lo <= df.agg(strength("n", "k")).first()[0] <= hi
