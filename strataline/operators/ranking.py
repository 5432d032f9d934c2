"""Retrievers: dense, BM25, hybrid merge, subquery fusion, routing.

A retriever maps queries and chunks to ranked rows ``(query_id, id, score)`` and declares
whether its scores lie in [0, 1] already. Queries are few and go to the chunks; chunk
statistics that ranking needs are aggregated before anything is joined, and contents are
joined only to the rows that were kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.scalars import cosine, dot, minmax, norm, space_tokens, without_stopwords
from strataline.operators.providers import LLM

TOP_K = 10
SUBQUERY_TOP_K = 3
#: Datasets that a model may choose from, where a flow names none.
MOST_ROUTES = 1_000
K1, B = 1.2, 0.75
#: Queries scored in one pass over the chunks. A larger set is scored in several.
QUERY_BATCH = 1_000
QUERY_BYTES = 64 << 20
#: Distinct query terms up to which chunks are filtered by a list of them; more are joined.
LISTED_TERMS = 1_000


class Retriever(Protocol):
    normalised: bool

    def retrieve(self, queries: DataFrame, chunks: DataFrame) -> DataFrame: ...


def top_per(df: DataFrame, keys: Sequence[str], k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The ``k`` best rows of each group, ties by id; all rows when ``k`` is not positive. Spark limits groups before the shuffle."""
    if k <= 0:
        return df
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def ranked(df: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Rows with their rank from 1 within a query."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))))


def metadata_equals(where: dict[str, str] | None, metadata: str = "metadata", skip_blank: bool = False) -> Column:
    """All entries equal; nothing asked for is true. Blank keys or values are skipped on request."""
    out = F.lit(True)
    for k, v in (where or {}).items():
        if skip_blank and (not k.strip() or not str(v).strip()):
            continue
        out = out & (F.col(metadata)[k] == F.lit(v))
    return out


def keyword_predicate(words: Sequence[str], content: Column) -> Column:
    """Any of the plain words occurs, and none of those behind a minus sign."""
    wanted = [w for w in words if w and not w.startswith("-")]
    barred = [w[1:] for w in words if w.startswith("-") and len(w) > 1]
    out = F.lit(True)
    if wanted:
        any_of = F.lit(False)
        for w in wanted:
            any_of = any_of | content.contains(w)
        out = out & any_of
    for w in barred:
        out = out & ~content.contains(w)
    return out


# --- dense ----------------------------------------------------------------------------


def dense_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cosine of every query with every chunk of its dimension, for operators that need whole lists.

    ``queries`` is ``(query_id, vector)``, a stated set; it is sent to the chunks in batches
    of at most ``QUERY_BATCH`` rows and ``QUERY_BYTES``, so the chunks are scanned once per
    batch and never shuffled. ``dense_top`` finds the nearest ones without making the lists.
    """
    count, longest = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    batch = max(1, min(QUERY_BATCH, QUERY_BYTES // (8 * max(1, longest or 1))))
    q = queries.select("query_id", F.col("vector").alias("_q"), norm(F.col("vector")).alias("_qn")).where(F.col("_qn") > 0)
    c = chunks.withColumn("_cn", norm(F.col("embedding"))).where(F.col("_cn") > 0)
    parts = max(1, -(-count // batch))
    out = None
    for part in range(parts):
        own = q if parts == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        hit = c.join(F.broadcast(own), F.size("embedding") == F.size("_q")).withColumn("score", dot(F.col("embedding"), F.col("_q")) / (F.col("_cn") * F.col("_qn")))
        hit = hit.drop("_q", "_qn", "_cn")
        out = hit if out is None else out.unionByName(hit)
    return out


def _units(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of the rows of one dimension that have a finite, positive norm."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(invalid="ignore", over="ignore"):
        norms = np.sqrt((flat * flat).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return rows[good], flat[good] / norms[good, None]


def _best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best scores, equal ones by id."""
    if len(scores) > k:
        place = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        place = np.arange(len(scores))
    return np.array(sorted(place.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)


def _scored(asked: np.ndarray, unit: np.ndarray, block: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of each query, computed a block of queries at a time."""
    for start in range(0, len(asked), block):
        for q, scores in enumerate(np.round(asked[start : start + block] @ unit.T, 12), start):
            yield q, scores


def dense_top(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest chunks of every query by cosine, as ``(query_id, id, score)``.

    A batch of chunks is compared with all queries by one matrix product, and a task keeps
    only its ``k`` best of each query, so what is shuffled is tasks x queries x k rows
    however many chunks there are. Queries are read ``QUERY_BATCH`` at a time, a pass over
    the chunks for each batch. Zero, null and non-finite vectors take no part; scores are
    rounded to 12 places, so equal vectors are equal and rank by id.
    """
    query_kind, id_kind = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["id"]
    source = chunks.where(F.col("id").isNotNull()).select("id", "embedding")
    found, held = None, []

    def search(batch: list[tuple]) -> DataFrame:
        by_dims: dict[int, tuple[list, np.ndarray]] = {}
        for dims in {len(v) for _, v in batch}:
            own = [(q, v) for q, v in batch if len(v) == dims]
            rows, unit = _units(pa.array([v for _, v in own], pa.list_(pa.float64())), dims)
            if len(rows):
                by_dims[dims] = [own[r][0] for r in rows], unit
        shared = queries.sparkSession.sparkContext.broadcast(by_dims)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            kinds = None
            for rb in batches:
                kinds = kinds or rb.schema.field(0).type
                for dims, (_, asked) in shared.value.items():
                    rows, unit = _units(rb.column(1), dims)
                    if not len(rows):
                        continue
                    ids = np.array(rb.column(0).take(pa.array(rows)).to_pylist(), dtype=object)
                    for q, scores in _scored(asked, unit):
                        place = _best_of(scores, ids, k)
                        new = scores[place], ids[place]
                        if (dims, q) in top:
                            new = tuple(np.concatenate(x) for x in zip(top[dims, q], new))
                            place = _best_of(new[0], new[1], k)
                            new = new[0][place], new[1][place]
                        top[dims, q] = new
            rows_out = [(shared.value[dims][0][q], i, s) for (dims, q), (scores, ids) in top.items() for s, i in zip(scores.tolist(), ids)]
            if rows_out:
                names, ids, scores = zip(*rows_out)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids, kinds), pa.array(scores, pa.float64())], names=["query_id", "id", "score"])

        return source.mapInArrow(best, f"query_id {query_kind}, id {id_kind}, score double")

    for row in queries.where(F.col("vector").isNotNull()).select("query_id", "vector").toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == QUERY_BATCH:
            part, held = search(held), []
            found = part if found is None else found.unionByName(part)
    if held or found is None:
        part = search(held)
        found = part if found is None else found.unionByName(part)
    return top_per(found, ["query_id"], k)


@dataclass
class Dense:
    """Top ``top_k`` chunks by cosine. Filters apply before ranking; per-dataset limits never change the global result."""

    top_k: int = TOP_K
    where: dict[str, str] | None = None
    keywords: Sequence[str] = ()
    datasets: Sequence[str] | None = None
    normalised: bool = True

    def retrieve(self, queries: DataFrame, chunks: DataFrame) -> DataFrame:
        if self.datasets is not None:
            chunks = chunks.where(F.col("dataset").isin(list(self.datasets)))
        if self.where:
            chunks = chunks.where(metadata_equals(self.where))
        if self.keywords:
            chunks = chunks.where(keyword_predicate(self.keywords, F.col("content")))
        return dense_top(queries, chunks, self.top_k or TOP_K)


def top_per_dataset(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every dataset, ranked within it; what a task keeps is limited before anything is shuffled."""
    scored = dense_scores(queries, chunks).select("query_id", "dataset", "id", F.round("score", 12).alias("score"))
    order = Window.partitionBy("query_id", "dataset").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_one(chunks: DataFrame, vector: Sequence[float], k: int = TOP_K) -> DataFrame:
    """Top ``k`` for a single query vector: a sort-limit without any exchange of chunks."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return chunks.where(F.size("embedding") == len(vector)).withColumn("score", cosine(F.col("embedding"), q)).where(F.col("score").isNotNull()).orderBy(F.desc("score"), F.asc("id")).limit(k)


# --- BM25 -----------------------------------------------------------------------------

# The most frequent words of four languages, fixed lists.
LANGUAGE_STOPWORDS = {
    "en": "a an and are as at be but by for from has have if in into is it its no not of on or our that the their then there these they this to was we were will with you".split(),
    "fr": "à au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour que qui sa se ses son sur un une vous".split(),
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für im in ist mit nach nicht oder sich sie sind so um und von vor war wie wir zu zum zur".split(),
    "es": "a al como con de del el ella en es esta este la las lo los más no o para pero por que se si sin sobre su sus un una y ya".split(),
}


def cleaned_tokens(text: Column, stopwords: Sequence[str]) -> Column:
    """Tokens of a text without stop words: given ones, those of languages named by their codes, or for ``auto`` those of the language whose stop words the text has most of."""
    tokens = space_tokens(text)
    given = [w for w in stopwords if w != "auto" and w not in LANGUAGE_STOPWORDS]
    named = [w for code in stopwords if code in LANGUAGE_STOPWORDS for w in LANGUAGE_STOPWORDS[code]]
    if list(stopwords)[:1] != ["auto"]:
        return without_stopwords(tokens, [*given, *named])
    lowered = F.transform(tokens, F.lower)
    among = lambda words: F.size(F.filter(lowered, lambda t: t.isin(words)))
    hits = {code: among(words) for code, words in LANGUAGE_STOPWORDS.items()}
    most = F.greatest(*hits.values())
    out = F.when(most == 0, tokens)
    for code, words in LANGUAGE_STOPWORDS.items():
        out = out.when(hits[code] == most, without_stopwords(tokens, words))
    return out


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_scores(queries: DataFrame, chunks: DataFrame, k1: float = K1, b: float = B, stopwords: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Okapi BM25 of every chunk that holds a query term, as ``(query_id, id, score)``.

    Tokens are split at single spaces and case-sensitive; a repeated query term counts
    repeatedly. Statistics are over all chunks, or over the chunks of each group of ``by``.
    Only tokens of the queries leave the scan: a chunk sends one row per matched term and
    its length stays with it.
    """
    by = list(by)
    tokens = cleaned_tokens(F.col("content"), stopwords)
    sized = chunks.where(F.col("content").isNotNull()).select("id", *by, tokens.alias("_t")).withColumn("_len", F.size("_t"))
    stats = sized.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))
    asked = queries.select("query_id", *[c for c in by if c in queries.columns], F.explode(space_tokens(F.col("query"))).alias("term"))
    asked = asked.groupBy("query_id", *[c for c in by if c in queries.columns], "term").agg(F.count("*").alias("_times"))
    terms = asked.select("term").distinct()
    listed = [r[0] for r in terms.limit(LISTED_TERMS + 1).collect()]
    if len(listed) <= LISTED_TERMS:
        matched = sized.select("id", *by, "_len", F.explode(F.filter("_t", lambda t: t.isin(listed))).alias("term"))
    else:
        matched = sized.select("id", *by, "_len", F.explode("_t").alias("term")).join(terms, "term", "left_semi")
    tf = matched.groupBy("id", *by, "_len", "term").agg(F.count("*").alias("_tf"))
    df = tf.groupBy(*by, "term").agg(F.count("*").alias("_df"))
    weighted = tf.join(df, [*by, "term"])
    weighted = weighted.join(stats, by) if by else weighted.crossJoin(F.broadcast(stats))
    weight = bm25_idf(F.col("_n"), F.col("_df")) * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    weighted = weighted.select("id", *by, "term", weight.alias("_w"))
    return weighted.join(asked, ["term", *[c for c in by if c in queries.columns]]).groupBy("query_id", "id").agg(F.sum(F.col("_w") * F.col("_times")).alias("score"))


@dataclass
class BM25:
    top_n: int = TOP_K
    k1: float = K1
    b: float = B
    stopwords: Sequence[str] = ()
    normalised: bool = False

    def retrieve(self, queries: DataFrame, chunks: DataFrame) -> DataFrame:
        """The best chunks; where fewer than ``top_n`` hold a query term, others follow with score 0.

        Those come from the ``2 * top_n`` least ids, of which at least ``top_n`` hold no term
        when they are needed.
        """
        scored = bm25_scores(queries, chunks, self.k1, self.b, self.stopwords)
        if self.top_n > 0:
            least = F.broadcast(chunks.where(F.col("content").isNotNull()).select("id").orderBy("id").limit(2 * self.top_n))
            others = queries.select("query_id").crossJoin(least).join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti")
            scored = scored.unionByName(others.withColumn("score", F.lit(0.0)))
        return top_per(scored, ["query_id"], self.top_n)


# --- combinations ---------------------------------------------------------------------


def normalise_scores(df: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Scores scaled to [0, 1] within each list."""
    ranges = df.groupBy(*keys).agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    return df.join(ranges, list(keys)).withColumn("score", minmax(F.col("score"), F.col("_low"), F.col("_high"))).drop("_low", "_high")


@dataclass
class Merge:
    """Weighted sum over retrievers; scores that are not normalised are scaled first.

    ``compat`` gives the older behaviour in which a chunk that the first retriever found
    scores 0 there when that retriever is normalised.
    """

    retrievers: Sequence[tuple[str, float, Retriever]] = field(default_factory=list)
    top_k: int = TOP_K
    compat: bool = False
    normalised: bool = True

    def retrieve(self, queries: DataFrame, chunks: DataFrame) -> DataFrame:
        parts = None
        for place, (name, weight, retriever) in enumerate(self.retrievers):
            found = retriever.retrieve(queries, chunks)
            found = found if retriever.normalised else normalise_scores(found)
            value = F.lit(0.0) if self.compat and place == 0 and retriever.normalised else F.col("score") * F.lit(float(weight))
            found = found.select("query_id", "id", value.alias("score"), F.lit(place).alias("_place"), F.lit(name).alias("_name"))
            parts = found if parts is None else parts.unionByName(found)
        merged = parts.groupBy("query_id", "id").agg(
            F.sum("score").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_name"))), lambda x: x["_name"]), ",").alias("retrievers")
        )
        return top_per(merged, ["query_id"], self.top_k)


def fuse_subqueries(found: DataFrame) -> DataFrame:
    """One row per chunk of a query, with its highest score over the subqueries."""
    return found.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def subquery_search(queries: DataFrame, subqueries: DataFrame, chunks: DataFrame, limit: int = 3, top_k: int = SUBQUERY_TOP_K) -> DataFrame:
    """Dense search of up to ``limit`` subqueries of each query, fused.

    ``subqueries`` is ``(query_id, subquery_no, vector)``. A limit below 1 is an error.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    own = subqueries.join(queries.select("query_id"), "query_id", "left_semi").where(F.col("subquery_no") < limit)
    asked = own.select(F.struct("query_id", "subquery_no").alias("query_id"), "vector")
    asked = asked.withColumn("query_id", F.to_json("query_id"))
    found = Dense(top_k).retrieve(asked, chunks)
    return top_per(fuse_subqueries(found.select(F.get_json_object("query_id", "$.query_id").alias("query_id"), "id", "score")), ["query_id"], top_k)


def routed_search(queries: DataFrame, routes: DataFrame, chunks: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Dense search of each query in the one dataset that ``routes (query_id, dataset)`` picks for it.

    Queries meet only the chunks of their own dataset, and only ids and scores go on.
    """
    asked = queries.join(routes, "query_id").select("query_id", "dataset", F.col("vector").alias("_q"), norm(F.col("vector")).alias("_qn")).where("_qn > 0")
    held = chunks.select("dataset", "id", "embedding", norm(F.col("embedding")).alias("_cn")).where("_cn > 0")
    met = held.join(asked, (held["dataset"] == asked["dataset"]) & (F.size("embedding") == F.size("_q")))
    scored = met.select("query_id", "id", F.round(dot(F.col("embedding"), F.col("_q")) / (F.col("_cn") * F.col("_qn")), 12).alias("score"))
    return top_per(scored, ["query_id"], top_k)


def in_collections(vectors: DataFrame, collections: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Vectors ``(id, collection_id, embedding)`` with the name of their collection ``(collection_id, dataset)``, of all or some collections."""
    wanted = collections if names is None else collections.where(F.col("dataset").isin(list(names)))
    return vectors.join(wanted.select("collection_id", "dataset"), "collection_id")


def collection_sizes(chunks: DataFrame) -> DataFrame:
    """``(dataset, dims, n)``: chunks of each dataset by the length of their vectors; null vectors count for none."""
    rows = chunks.where(F.col("embedding").isNotNull()).select("dataset", F.size("embedding").cast("bigint").alias("dims"))
    return rows.groupBy("dataset", "dims").agg(F.count("*").alias("n"))


def bm25_corpus(chunks: DataFrame, stopwords: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Statistics of a corpus: one row ``(n, avgdl)``, and ``(term, df)``."""
    sized = chunks.where(F.col("content").isNotNull()).select(without_stopwords(space_tokens(F.col("content")), stopwords).alias("_t"))
    overall = sized.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avgdl"))
    return overall, sized.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


_SPLIT = "Split this search query into at most {limit} queries, one for each topic in it. Answer with a JSON list of them; a query of one topic stays as it is.\n"
_ROUTE = "Which one of these datasets should be searched for the query? {names}\nAnswer with the name only.\n"


@dataclass
class Subqueries:
    """Dense search of the parts that a model splits each query into, fused by the best score."""

    llm: LLM
    embed: Callable[[Sequence[str]], list[list[float]]] | None = None
    limit: int = 3
    top_k: int = SUBQUERY_TOP_K
    normalised: bool = True

    def retrieve(self, queries: DataFrame, chunks: DataFrame) -> DataFrame:
        from strataline.operators.providers import embedded_with
        from strataline.operators.rewrite import generic

        if self.embed is None:
            raise ValueError("subqueries need an embedder")
        parts = generic(queries.select("query_id", "query"), self.llm, _SPLIT.format(limit=self.limit))
        parts = embedded_with(parts.where(F.col("subquery_no") < self.limit), self.embed, "query", "vector")
        return subquery_search(queries, parts.select("query_id", "subquery_no", "vector"), chunks, self.limit, self.top_k)


@dataclass
class Routed:
    """Dense search of each query in the dataset that a model names; one that it does not know is an error of that query, which then finds nothing."""

    llm: LLM
    datasets: Sequence[str] = ()
    top_k: int = TOP_K
    normalised: bool = True

    def retrieve(self, queries: DataFrame, chunks: DataFrame) -> DataFrame:
        names = list(self.datasets) or [r[0] for r in chunks.select("dataset").distinct().orderBy("dataset").limit(MOST_ROUTES).collect()]
        llm, prompt = self.llm, _ROUTE.format(names=", ".join(names))

        @F.pandas_udf("string")
        def chosen(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: llm.prompt(prompt + t).strip())

        routes = queries.select("query_id", chosen("query").alias("dataset")).where(F.col("dataset").isin(names))
        return routed_search(queries.select("query_id", "vector"), routes, chunks, self.top_k)


def check_embedding_model(datasets: DataFrame, dataset: str, model: str, prefer_new: bool = False) -> str:
    """The model to embed a query with: the one recorded for the dataset, unless the new one is preferred."""
    row = datasets.where(F.col("id") == dataset).select("embedding_model").first()
    recorded = row and row[0]
    return model if prefer_new or not recorded else recorded


def with_content(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Contents and metadata of the kept rows, joined after ranking."""
    return found.join(chunks.select("id", "content", "metadata"), "id")
