"""Sinks: chunk tables, structured JSON, Markdown, records, sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.operators.transforms import factored


def without_empty_content(content: Column) -> Column:
    return F.coalesce(F.when(content != "", content), F.lit("<no content>"))


def append_chunks(df: DataFrame, path: str) -> None:
    """Chunks added below one folder per dataset."""
    df.write.mode("append").partitionBy("dataset").parquet(path)


def structured_json(df: DataFrame, group: Sequence[str] = ("path",)) -> DataFrame:
    """``(group, json)``: documents of each group with what their metadata share moved up. ``df`` has ``doc_index, content, metadata``."""
    parents, children = factored(df, group)
    docs = children.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("doc_index", "metadata", "content")), lambda x, y: F.coalesce(x["doc_index"] - y["doc_index"], F.lit(0))).alias("_docs"))
    out = docs.join(parents.withColumnRenamed("metadata", "_m"), list(group), "left")
    documents = F.transform("_docs", lambda d: F.struct(d["metadata"].alias("metadata"), d["content"].alias("content")))
    return out.select(*group, F.to_json(F.struct(F.coalesce("_m", F.from_json(F.lit("{}"), "map<string,string>")).alias("metadata"), documents.alias("documents"))).alias("json"))


DOC_BREAK = "\n---docbreak---\n"


def markdown(df: DataFrame, group: Sequence[str] = ("path",)) -> DataFrame:
    """``(group, markdown)``: each document that is not empty under a line of its metadata, with breaks between."""
    line = F.concat(F.lit("<!-- "), F.to_json("metadata"), F.lit(" -->\n"), F.col("content"))
    docs = df.where(F.col("content") != "").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("doc_index", line.alias("_t")))).alias("_d"))
    return docs.select(*group, F.array_join(F.transform("_d", lambda d: d["_t"]), DOC_BREAK).alias("markdown"))


def elements(df: DataFrame, name: Column, description: Column, contents: Column) -> DataFrame:
    """Search results as ``(name, description, contents)``."""
    return df.select(name.cast("string").alias("name"), description.cast("string").alias("description"), contents.cast("string").alias("contents"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))


def sheet_cells(value: Column) -> tuple[Column, Column]:
    """(value, formula) of what is written to a cell: a text that starts with ``=`` is a formula."""
    is_formula = value.startswith("=")
    return F.when(~is_formula, value), F.when(is_formula, value)


def append_rows(sheet: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows behind those of a sheet; missing columns are empty."""
    return sheet.unionByName(rows, allowMissingColumns=True)


def update_cell(sheet: DataFrame, row_no: int, column: str, value) -> DataFrame:
    return sheet.withColumn(column, F.when(F.col("row_no") == row_no, F.lit(value)).otherwise(F.col(column)))


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
