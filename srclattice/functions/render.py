"""Results as JSON lines, Markdown or a short list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fields(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are, in the order asked for."""
    return df.select(*[c for c in wanted if c in df.columns]) if any(c in df.columns for c in wanted) else df


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON document a row; NULL fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("json"))


def markdown(df: DataFrame, limit: int = 50) -> str:
    """A table of the first rows, for reading."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
