"""The fact relations that every operator reads.

A code base is seven tables; every operator takes them as lazy DataFrames and returns one.

types        name, package, qualified, kind, is_interface, is_abstract, super_class, path, start_line, end_line
methods      class, name, params, return_type, signature, is_public, path, start_line, end_line
fields       class, name, type
edges        caller_class, caller, caller_params, callee_class, callee, callee_params, line
implements   class, interface
annotations  class, method (NULL: on the class), name, value
imports      class, import
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "types": "name string, package string, qualified string, kind string, is_interface boolean, is_abstract boolean, super_class string, path string, start_line int, end_line int",
    "methods": "class string, name string, params int, return_type string, signature string, is_public boolean, path string, start_line int, end_line int",
    "fields": "class string, name string, type string",
    "edges": "caller_class string, caller string, caller_params int, callee_class string, callee string, callee_params int, line int",
    "implements": "class string, interface string",
    "annotations": "class string, method string, name string, value string",
    "imports": "class string, import string",
}


@dataclass(frozen=True)
class Facts:
    types: DataFrame
    methods: DataFrame
    fields: DataFrame
    edges: DataFrame
    implements: DataFrame
    annotations: DataFrame
    imports: DataFrame

    def without_tests(self) -> "Facts":
        """Only the types outside test folders, and their members."""
        kept = self.types.where(~is_test(F.col("path")))
        names = kept.select(F.col("name").alias("class")).distinct()
        of = lambda df: df.join(names, "class", "left_semi")
        callers = names.withColumnRenamed("class", "caller_class")
        return Facts(kept, of(self.methods), of(self.fields), self.edges.join(callers, "caller_class", "left_semi"), of(self.implements), of(self.annotations), of(self.imports))

    def save(self, path: str) -> None:
        """Write the tables as Parquet, the index of a code base."""
        for name in SCHEMAS:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


class Saved:
    """Facts whose tables are each written when they are first asked for, and read from there on."""

    def __init__(self, facts: Facts, path: str):
        self._facts, self._path = facts, path

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        df = getattr(self._facts, name)
        df.write.mode("overwrite").parquet(f"{self._path}/{name}")
        self.__dict__[name] = df.sparkSession.read.schema(df.schema).parquet(f"{self._path}/{name}")
        return self.__dict__[name]

    def without_tests(self) -> Facts:
        return Facts.without_tests(self)


class Late:
    """Facts of which a table may be a function, called when the table is first asked for."""

    save, without_tests = Facts.save, Facts.without_tests

    def __init__(self, **tables):
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        made = self._tables[name]
        self.__dict__[name] = made() if callable(made) else made
        return self.__dict__[name]


def load(spark, path: str) -> Facts:
    return Facts(*[spark.read.schema(s).parquet(f"{path}/{name}") for name, s in SCHEMAS.items()])


def is_test(path):
    return path.contains("/test/") | path.contains("/testFixtures/")


def joined(column, sep: str = ","):
    """A sorted list of the distinct values of a group, as one string."""
    return F.array_join(F.sort_array(F.collect_set(column)), sep)


def loc():
    return F.col("end_line") - F.col("start_line") + 1


def complexity():
    return F.greatest(F.lit(1), F.floor(loc() / 5)).cast("int")
