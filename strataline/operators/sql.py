"""SQL over registered tables: query, execute, list, describe."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_READS = re.compile(r"^\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*(select|with|values|table|show|describe|desc|explain|from)\b", re.I | re.S)


def register(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Parquet tables of a folder as temporary views."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def query(spark: SparkSession, text: str) -> DataFrame:
    """Rows of a reading statement; an empty text and a writing statement are errors, and so are repeated column names."""
    if not text or not text.strip():
        raise ValueError("query is empty")
    if not _READS.match(text):
        raise ValueError("only reading statements are allowed")
    out = spark.sql(text)
    if len(set(out.columns)) != len(out.columns):
        raise ValueError("column names must be unique")
    return out


def query_json(spark: SparkSession, text: str) -> dict:
    """Columns and rows of a query, for a result that fits the caller."""
    out = query(spark, text)
    return {"columns": out.columns, "rows": [r.asDict(recursive=True) for r in out.toLocalIterator()]}


def execute(spark: SparkSession, statement: str) -> None:
    if not statement or not statement.strip():
        raise ValueError("statement is empty")
    spark.sql(statement)


def list_tables(spark: SparkSession) -> DataFrame:
    """``(name)`` of all tables and views, in order."""
    return spark.createDataFrame(sorted((t.name,) for t in spark.catalog.listTables()), "name string")


def describe(spark: SparkSession, exclude: Sequence[str] = ()) -> DataFrame:
    """``(table_name, column_name, data_type, position)`` of all tables, without excluded columns."""
    rows = []
    for t in sorted(x.name for x in spark.catalog.listTables()):
        rows += [(t, f.name, f.dataType.simpleString(), k) for k, f in enumerate(spark.table(t).schema.fields) if f.name not in exclude]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")


def context(spark: SparkSession) -> str:
    """Definitions of all tables as text, ordered by name."""
    out: dict[str, list[str]] = {}
    for r in describe(spark).orderBy("table_name", "position").toLocalIterator():
        out.setdefault(r[0], []).append(f"{r[1]} {r[2]}")
    return "\n".join(f"CREATE TABLE {t} ({', '.join(c)});" for t, c in out.items())


def tables_in(folder: str) -> list[str]:
    return sorted(p.name.removesuffix(".parquet") for p in Path(folder).glob("*.parquet"))
