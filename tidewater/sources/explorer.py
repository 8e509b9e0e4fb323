"""Read-only SQL: an allow-list in front of spark.sql, bounded results, schema listing."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

ALLOWED = ("select", "with", "explain", "table")


_PARTS = re.compile(r"('(?:[^'\\\\]|\\\\.|'')*'|\"(?:[^\"\\\\]|\\\\.)*\"|`(?:[^`]|``)*`)|(--[^\n]*|/\\*.*?\\*/)|(;)", re.S)


_CALLS = re.compile(r"\b(?:reflect|java_method|try_reflect|CallMethodViaReflection|ScriptTransformation)\b", re.I)


def check(sql: str) -> str:
    """The statement, if it is a single one that may read, without comments; else ValueError."""
    semicolons = []

    def keep(m: re.Match) -> str:
        semicolons.extend([1] if m[3] else [])
        return m[1] or m[3] or " "

    bare = _PARTS.sub(keep, sql).strip()
    if bare.endswith(";"):
        bare, _ = bare[:-1].strip(), semicolons.pop()
    if not bare:
        raise ValueError("empty statement")
    if semicolons:
        raise ValueError("more than one statement")
    if bare.split(None, 1)[0].lower() not in ALLOWED:
        raise ValueError("only SELECT, WITH, EXPLAIN and TABLE are allowed")
    return bare


def explore(spark: SparkSession, sql: str, most: int = 1000) -> tuple[DataFrame, bool]:
    """The first rows of a statement, and whether there are more.

    The statement is read as a subquery, where Spark's parser takes queries only: what writes, WITH ... INSERT too, is refused.
    """
    bare = check(sql)
    explain = re.match(r"explain\b\s*((?:extended|codegen|cost|formatted)\b)?", bare, re.I)
    query = f"SELECT * FROM (\n{bare[explain.end():] if explain else bare}\n)"
    try:
        rows = spark.sql(f"{explain[0]} {query}" if explain else query).limit(most + 1)
    except ParseException as e:
        raise ValueError("only queries are allowed") from e
    # functions that call any method of the JVM or run scripts are named in the analysed plan
    if _CALLS.search(rows._jdf.queryExecution().analyzed().toString()):
        raise ValueError("calls of Java methods and scripts are not allowed")
    return rows.limit(most), rows.count() > most


def schemas(spark: SparkSession, database: str | None = None) -> dict[str, list[tuple[str, str]]]:
    return {t.name: [(c.name, c.dataType) for c in spark.catalog.listColumns(t.name)] for t in spark.catalog.listTables(database)}
