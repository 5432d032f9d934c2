"""Query modifiers: ``queries (query_id, query)`` to queries."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.providers import LLM

_SPELLING = "Correct the spelling of this search query. Answer with the query only.\n"
_ENHANCE = "Rewrite this search query so that it finds more relevant passages. Answer with the query only.\n"


def _one(queries: DataFrame, llm: LLM, prompt: str) -> DataFrame:
    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: llm.prompt(prompt + t).strip() or t)

    return queries.withColumn("query", ask("query"))


def spellcheck(queries: DataFrame, llm: LLM) -> DataFrame:
    return _one(queries, llm, _SPELLING)


def enhance(queries: DataFrame, llm: LLM) -> DataFrame:
    return _one(queries, llm, _ENHANCE)


def generic(queries: DataFrame, llm: LLM, prompt: str) -> DataFrame:
    """Any number of queries for each, all kept: ``(query_id, subquery_no, query)``. The model answers with a JSON list; other text is one query."""

    def parsed(answer: str) -> list[str]:
        try:
            found = json.loads(answer)
        except ValueError:
            return [answer]
        found = found.get("results", found.get("queries", [])) if isinstance(found, dict) else found
        return [str(x) for x in found] if isinstance(found, list) else [str(found)]

    @F.pandas_udf("array<string>")
    def ask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parsed(llm.prompt(f"{prompt}\n{t}")))

    return queries.select("query_id", F.posexplode(ask("query")).alias("subquery_no", "query"))
