"""Beta priors from counts of groups, by moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least and most observations that a prior may count for.
WEAK, STRONG = 2.0, 1000.0


def strength(n: str, k: str) -> Column:
    """Of groups with k hits among n: how many observations the beta prior of their rates counts for.

    From the between-group variance as in a one-way analysis of variance, within WEAK and STRONG;
    STRONG where groups differ no more than by chance, or there are fewer than two.
    """
    some = F.col(n) > 0
    g, a, h = (F.coalesce(F.sum(F.when(some, x)), F.lit(0)).cast("double") for x in (F.lit(1), F.col(n), F.col(k)))
    squares = F.coalesce(F.sum(F.when(some, F.col(n).cast("double") * F.col(n) )), F.lit(0.0))
    between = F.coalesce(F.sum(F.when(some, F.col(k).cast("double") * F.col(k) / F.col(n))), F.lit(0.0))
    p = h / F.when(a > 0, a)
    noise = p * (1 - p)
    scale = noise * (a - squares / F.when(a > 0, a) - (g - 1))
    rho = F.when(scale > 1e-9, (between - h * p - noise * (g - 1)) / F.when(scale > 1e-9, scale))
    return F.coalesce(F.when(rho > 1e-9, F.least(F.greatest(1 / F.when(rho > 1e-9, rho) - 1, F.lit(WEAK)), F.lit(STRONG))), F.lit(STRONG))


def strength_sql(n: str, k: str) -> str:
    """The same for SQL over a relation that has n > 0 only."""
    a, h, g = f"sum({n})::double", f"sum({k})::double", "count(*)::double"
    p = f"({h} / {a})"
    rho = f"((sum({k}::double * {k} / {n}) - {h} * {p} - {p} * (1 - {p}) * ({g} - 1)) / nullif({p} * (1 - {p}) * ({a} - sum({n}::double * {n}) / {a} - ({g} - 1)), 0))"
    return f"coalesce(case when {p} * (1 - {p}) * ({a} - sum({n}::double * {n}) / {a} - ({g} - 1)) > 1e-9 and {rho} > 1e-9 then least(greatest(1 / {rho} - 1, {WEAK}), {STRONG}) end, {STRONG})"


def low_bound(a: Column, b: Column, z: float) -> Column:
    """The mean of Beta(a, b) less z of its standard deviations."""
    return a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
