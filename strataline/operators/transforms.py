"""Transforms of chunk frames ``(id, file_id, content, metadata map)``, and metadata operations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.providers import LLM


def _empty() -> Column:
    return F.from_json(F.lit("{}"), "map<string,string>")


def _overwritten(old: Column, new: Column) -> Column:
    """Entries of both maps, the new one's where a key is in both."""
    keys = F.map_keys(new)
    kept = F.map_filter(F.coalesce(old, _empty()), lambda k, v: ~F.array_contains(keys, k))
    return F.map_concat(kept, new)


def _literal(values: Mapping[str, str]) -> Column:
    pairs = [c for k, v in values.items() for c in (F.lit(k), F.lit(v).cast("string"))]
    return F.create_map(*pairs) if pairs else _empty()


def add_metadata(df: DataFrame, values: Mapping[str, str], metadata: str = "metadata") -> DataFrame:
    return df.withColumn(metadata, _overwritten(F.col(metadata), _literal(values)))


def _dropped(metadata: Column, key: str) -> Column:
    return F.map_filter(metadata, lambda k, v: k != key)


def manipulate_metadata(df: DataFrame, steps: Sequence[tuple], metadata: str = "metadata") -> DataFrame:
    """Steps in order: ``("add", key, value)`` fails on an existing key, ``("upsert", key, value)``, ``("remove", key)``."""
    out = F.coalesce(F.col(metadata), _empty())
    for step in steps:
        kind, key = step[0], step[1]
        if kind == "add":
            taken = F.map_contains_key(out, key)
            value = F.when(taken, F.raise_error(F.lit(f"metadata key exists: {key}")).cast("string")).otherwise(F.lit(str(step[2])))
            out = _overwritten(out, F.create_map(F.lit(key), value))
        elif kind == "upsert":
            out = _overwritten(out, _literal({key: step[2]}))
        elif kind == "remove":
            out = _dropped(out, key)
        else:
            raise ValueError(f"unknown step: {kind}")
    return df.withColumn(metadata, out)


def ingest_metadata(extra: Column, filename: Column, path: Column, size: Column) -> Column:
    """Extra metadata of an ingested file; ``filename``, ``absPath`` and ``fileSize`` are never overridden by it."""
    fixed = F.create_map(F.lit("filename"), filename, F.lit("absPath"), path, F.lit("fileSize"), size.cast("string"))
    return _overwritten(extra, fixed)


def directory_metadata(files: DataFrame, entries: DataFrame, overall: Mapping[str, str] | None = None, path: str = "path") -> DataFrame:
    """Metadata of files from the folders above them: deeper folders override shallower ones, overall values override all.

    ``entries`` is ``(folder, metadata)``; every folder above a file is a key of its own, so the join is an equi-join.
    """
    parts = F.split(F.regexp_replace(F.col(path), "/[^/]*$", ""), "/")
    above = files.select(path, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_depth", "_folder"))
    held = above.join(entries.select(F.col("folder").alias("_folder"), F.col("metadata").alias("_m")), "_folder")
    pairs = held.select(path, "_depth", F.explode("_m").alias("k", "v")).groupBy(path, "k").agg(F.max_by("v", "_depth").alias("v"))
    maps = pairs.groupBy(path).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    return files.join(maps, path, "left").withColumn("metadata", _overwritten(F.col("metadata"), _literal(overall or {})))


def renumber(df: DataFrame, file: Sequence[str] = ("file_id",), order: Column | None = None, tie: str = "id") -> DataFrame:
    """``docIndex`` 0 to n - 1 in the former order of a file, and ``docsTotal``. Rows without a file stay as they are, so they never come to one task."""
    place = order if order is not None else F.col("metadata")["docIndex"].try_cast("double").cast("int")
    of_file = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in file])
    loose, df = df.where(~of_file), df.where(of_file)
    window = Window.partitionBy(*file)
    index = F.row_number().over(window.orderBy(place.asc_nulls_last(), F.asc(tie))) - 1
    values = F.create_map(F.lit("docIndex"), index.cast("string"), F.lit("docsTotal"), F.count("*").over(window).cast("string"))
    return df.withColumn("metadata", _overwritten(F.col("metadata"), values)).unionByName(loose)


def common_metadata(df: DataFrame, group: Sequence[str], metadata: str = "metadata") -> DataFrame:
    """``(group, key, value)`` of the entries that all rows of a group share. Rows of a group are counted before anything is joined."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"))
    entries = df.select(*group, F.explode(metadata).alias("key", "value")).groupBy(*group, "key", "value").agg(F.count("*").alias("_c"))
    return entries.join(sizes, list(group)).where(F.col("_c") == F.col("_n")).select(*group, "key", "value")


def factored(df: DataFrame, group: Sequence[str], metadata: str = "metadata") -> tuple[DataFrame, DataFrame]:
    """Common metadata as one map per group, and the rows without it."""
    shared = common_metadata(df, group, metadata)
    parents = shared.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("_common"))
    rows = df.join(parents, list(group), "left").withColumn("_common", F.coalesce("_common", _empty()))
    children = rows.withColumn(metadata, F.map_filter(F.col(metadata), lambda k, v: ~F.map_contains_key(F.col("_common"), k))).drop("_common")
    return parents.withColumnRenamed("_common", metadata), children


def has_body(content: Column) -> Column:
    """Whether a Markdown text has a line that is no heading; an empty line counts, an empty text has none."""
    return (content != "") & F.exists(F.split(content, "\n"), lambda line: ~line.startswith("#"))


def filter_markdown(df: DataFrame) -> DataFrame:
    return df.where(has_body(F.col("content")))


def llm_keywords(df: DataFrame, llm: LLM, count: int = 10) -> DataFrame:
    """Keywords of each content by a model, comma-joined in metadata."""

    @F.pandas_udf("string")
    def ask(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: ",".join(w.strip() for w in llm.prompt(f"List {count} keywords.\n{c}").split(",")))

    asked = df.withColumn("_keywords", ask("content"))
    return asked.withColumn("metadata", _overwritten(F.col("metadata"), F.create_map(F.lit("keywords"), F.col("_keywords")))).drop("_keywords")


def merge_pages(pages: DataFrame, budget: int, file: str = "file_id") -> DataFrame:
    """Pages of a file packed greedily while their tokens fit ``budget``: ``(file_id, chunk_no, first_page, last_page, content, tokens)``.

    ``pages`` has ``page, content, tokens``; empty pages are skipped, a page above the budget
    stands alone. The fold is sequential over the pages of one file.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in rows.sort_values("page", kind="stable").itertuples(index=False):
            if not isinstance(r.content, str) or not r.content:
                continue
            if out and out[-1][5] + r.tokens <= budget:
                last = out[-1]
                last[3], last[4], last[5] = r.page, f"{last[4]}\n{r.content}", last[5] + r.tokens
            else:
                out.append([getattr(r, file), len(out), r.page, r.page, r.content, r.tokens])
        return pd.DataFrame(out, columns=[file, "chunk_no", "first_page", "last_page", "content", "tokens"])

    kind = dict(pages.dtypes)[file]
    return pages.select(file, "page", "content", "tokens").groupBy(file).applyInPandas(fold, f"{file} {kind}, chunk_no int, first_page int, last_page int, content string, tokens int")


#: Transforms by name, as a flow configuration names them.
TRANSFORMS: dict[str, Callable[..., DataFrame]] = {
    "extra_metadata": lambda df, **o: add_metadata(df, o.get("metadata", o)),
    "metadata": lambda df, manipulations=(), **_: manipulate_metadata(df, [tuple(m) for m in manipulations]),
    "filter_markdown_docs_no_content": lambda df, **_: filter_markdown(df),
    "keywords": lambda df, llm=None, numKeywords=10, **_: llm_keywords(df, llm, numKeywords),
}


def apply_all(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda d, step: step(d), steps, df)
