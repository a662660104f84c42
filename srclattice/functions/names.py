"""Names of methods and packages as they are shown and asked for."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def display(cls: str, name: str, params: str) -> Column:
    """C.m(2 params), C.m(1 param), C.m() for none or an unknown number."""
    n = F.col(params)
    return F.concat(F.concat_ws(".", cls, name), F.when(n == 1, "(1 param)").when(n > 1, F.concat(F.lit("("), n.cast("string"), F.lit(" params)"))).otherwise("()"))


def abbreviated(package: Column) -> Column:
    """Of more than two segments all but the last by their first letter."""
    s = F.split(package, r"\.")
    short = F.transform(s, lambda x, i: F.when(i < F.size(s) - 1, F.substring(x, 1, 1)).otherwise(x))
    return F.when(F.size(s) > 2, F.array_join(short, ".")).otherwise(package)


def parameter_types(signature: Column) -> Column:
    """The types of a signature's parameters, without generics, annotations, array and variable-length signs."""
    s = F.regexp_replace(signature, r"@[\w.]+(\([^()]*\))?", " ")
    inside = F.regexp_extract(s, r"\(([^()]*)\)", 1)
    for _ in range(5):  # generics may hold others
        inside = F.regexp_replace(inside, r"<[^<>]*>", "")
    each = F.transform(F.split(inside, ","), lambda p: F.regexp_extract(p, r"^\s*(?:final\s+)?([\w$]+(?:\.[\w$]+)*)", 1))
    return F.filter(each, lambda t: t != "")


@dataclass(frozen=True)
class MethodRef:
    cls: str | None
    name: str
    types: tuple[str, ...] | None  # None: not said


def strip_generics(t: str) -> str:
    out, depth = [], 0
    for c in t:
        depth += c == "<"
        if not depth:
            out.append(c)
        depth -= c == ">"
    return "".join(out)


def parse_ref(ref: str) -> MethodRef:
    """m, m(T, U), C.m, pkg.C.m(T): "()" says that there are no parameters."""
    ref = strip_generics(ref.strip())
    m = re.fullmatch(r"(?:(.*)\.)?([A-Za-z_$][\w$]*|<init>)(?:\((.*)\))?", ref)
    if not m:
        raise ValueError(f"no method reference: {ref!r}")
    args = None if m[3] is None else tuple(x.strip() for x in m[3].split(",") if x.strip())
    return MethodRef(m[1], m[2], args)
