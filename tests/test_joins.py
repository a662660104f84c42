"""Joins that avoid pairs, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from srclattice.operators import text as T
from tests.test_graph import facts


@pytest.mark.parametrize("least", [0.1, 0.3, 0.5, 0.75])
def test_similar_against_all_pairs(spark, least):
    r = random.Random(7)
    words = [f"m{i}" for i in range(30)]
    of = {f"T{i}": {"get"} | set(r.sample(words, r.randrange(1, 12))) for i in range(40)} | {"U1": {"get"}, "U2": {"get"}}
    ins = {c: set(r.sample(["A", "B", "C"], r.randrange(0, 3))) for c in of} | {"V1": {"A", "B"}, "V2": {"A", "B"}, "V3": {"A"}}
    f = facts(spark, methods=[(c, m, 0, "void", "", True, "", 1, 2) for c, ms in of.items() for m in ms], implements=[(c, i) for c, x in ins.items() for i in x])
    want = set()
    names = sorted({*of, *ins})
    for a in names:
        for b in names:
            ma, mb, ia, ib = of.get(a, set()), of.get(b, set()), ins.get(a, set()), ins.get(b, set())
            if a < b and (ma & mb or ia & ib):
                s = 0.7 * (len(ma & mb) / len(ma | mb) if ma | mb else 0.0) + 0.3 * (len(ia & ib) / max(len(ia), len(ib)) if ia & ib else 0.0)
                if s >= least:
                    want.add((a, b, math.floor(s * 100 + 0.5)))
    rows = [tuple(x) for x in T.similar(f, least).collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_near_names_against_all_pairs(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abC") for _ in range(n))
    asked = sorted({word(r.randrange(0, 9)) for _ in range(25)} | {"saveEverything", ""})
    names = sorted({word(r.randrange(0, 12)) for _ in range(120)} | {"saveEverythng", "doSaveEverythingNow", "aveverything", ""})
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = T._near_names(df(asked, "name"), df(names, "n2"))
    near = lambda d: {(x.name, x.n2) for x in d.where((F.levenshtein(F.lower("name"), F.lower("n2")) <= 3) | ((F.col("name") != "") & (F.col("n2") != "") & (F.lower("name").contains(F.lower("n2")) | F.lower("n2").contains(F.lower("name"))))).collect()}
    assert near(got) == near(df(asked, "name").crossJoin(df(names, "n2"))) and near(got)
