"""Postprocessors of ranked rows ``(query_id, id, content, metadata, score)``, by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions.scalars import blend
from strataline.operators.providers import LLM, Reranker
from strataline.operators.ranking import B, K1, bm25_scores, keyword_predicate, top_per


def similarity(df: DataFrame, threshold: float, keep_min: int = 0) -> DataFrame:
    """Scores of at least the threshold, and the best ``keep_min`` in any case."""
    kept = df.where(F.col("score") >= threshold)
    return kept if keep_min <= 0 else kept.unionByName(top_per(df, ["query_id"], keep_min).where(~F.coalesce(F.col("score") >= threshold, F.lit(False))))


def reduce(df: DataFrame, top_k: int) -> DataFrame:
    return top_per(df, ["query_id"], top_k)


def content_substring(df: DataFrame, contains: Sequence[str] = (), not_contains: Sequence[str] = ()) -> DataFrame:
    """All of one list occur and none of the other; case counts."""
    for w in contains:
        df = df.where(F.col("content").contains(w))
    for w in not_contains:
        df = df.where(~F.col("content").contains(w))
    return df


def keywords(df: DataFrame, words: Sequence[str]) -> DataFrame:
    return df.where(keyword_predicate(words, F.col("content")))


def bm25_rerank(df: DataFrame, queries: DataFrame, top_n: int = 0, sparse_weight: float = 0.5, k1: float = K1, b: float = B, stopwords: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """BM25 over each result list alone, as it is, blended with the similarity, best first; ``top_n`` of 0 keeps all.

    ``compat`` keeps the list's former order and, with ``top_n`` of 0, returns nothing.
    """
    sparse = bm25_scores(queries, df.select("id", "content", "query_id"), k1, b, stopwords, by=["query_id"])
    sparse = sparse.select("query_id", "id", F.col("score").alias("_sparse"))
    out = df.join(sparse, ["query_id", "id"], "left").withColumn("_sparse", F.coalesce("_sparse", F.lit(0.0)))
    if compat:
        return top_per(out.drop("_sparse"), ["query_id"], top_n) if top_n > 0 else out.drop("_sparse").limit(0)
    return top_per(out.withColumn("score", blend(F.col("_sparse"), F.col("score"), sparse_weight)).drop("_sparse"), ["query_id"], top_n)


def content_filter(df: DataFrame, llm: LLM, question: str, include: bool = True) -> DataFrame:
    """Rows whose content a model answers with yes, or with no when ``include`` is off."""

    @F.pandas_udf("boolean")
    def ask(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: llm.prompt(f"{question}\n{c}\nAnswer yes or no.").strip().lower().startswith("y"))

    return df.where(ask("content") == F.lit(include))


def external_rerank(df: DataFrame, queries: DataFrame, reranker: Reranker, top_n: int = 0) -> DataFrame:
    """New scores from a reranking model, one list of results at a time."""
    schema = "query_id string, id string, score double"

    def rerank(rows: pd.DataFrame) -> pd.DataFrame:
        scores = reranker.rerank(rows["query"].iloc[0], rows["content"].tolist())
        return pd.DataFrame({"query_id": rows["query_id"].astype(str), "id": rows["id"].astype(str), "score": scores})

    new = df.join(queries.select("query_id", "query"), "query_id").groupBy("query_id").applyInPandas(rerank, schema)
    return top_per(df.drop("score").join(new, ["query_id", "id"]), ["query_id"], top_n)


def format_hits(df: DataFrame, sources: DataFrame, budget: int = 120_000, least: int = 5_000, hits: int = 10, full: int = 3) -> DataFrame:
    """``(query_id, hit_no, url, content)``: result lists flattened, whole files put in for the first hits.

    ``df`` has ``query_id, subquery_no, rank, content, url, file, file_size``; ``sources`` has
    ``file, text``. Subqueries are added while fewer than ``hits`` rows are out, so more may
    come. Of the first ``full`` rows those of a file above ``least`` and below what is left
    of the ``budget`` give the whole file, whose further hits are left out. The fold is
    sequential over one result list.
    """
    joined = df.join(sources.select("file", F.col("text").alias("_text")), "file", "left")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["subquery_no", "rank"], kind="stable")
        out, done, left = [], set(), budget
        for _, group in rows.groupby("subquery_no", sort=True):
            if len(out) >= hits:
                break
            for r in group.itertuples(index=False):
                if r.file in done:
                    continue
                content = r.content
                if len(out) < full and pd.notna(r.file_size) and least < r.file_size < left:
                    done.add(r.file)
                    left -= int(r.file_size)
                    content = r[-1] if isinstance(r[-1], str) and r[-1] else content
                out.append((r.query_id, len(out) + 1, r.url, content))
        return pd.DataFrame(out, columns=["query_id", "hit_no", "url", "content"])

    kinds = dict(df.dtypes)
    return joined.groupBy("query_id").applyInPandas(fold, f"query_id {kinds['query_id']}, hit_no int, url string, content string")


def per_query(transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """An ingestion transform as a postprocessor."""
    return lambda df, **_: transform(df)


def extra_metadata(df: DataFrame, values: dict[str, str]) -> DataFrame:
    from strataline.operators.transforms import add_metadata

    return add_metadata(df, values)


