"""Queries of the engine's own operators over the whole tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.core.runtime import ship, table
from strataline.functions import scalars as S
from strataline.functions.html import page_markdown
from strataline.operators import connectors, dedupe, lookup, postprocess, providers, ranking, splitters, sql, transforms
from strataline.sources import loaders, sinks
from strataline.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def registered(sql_text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql_text:
            _SQL[f.__name__] = sql_text
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: (lambda spark, d, f=f: f(ship(spark), d)) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- frames that the retrieval queries share ------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("dataset"), "embedding")


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100, as a query."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best of each query."""
    return ranking.Dense(100).retrieve(_asked_vectors(spark, d), _vectors(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "lang")


def _asked(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit("q0").alias("query_id"), F.lit(text).alias("query"))


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_Q = "SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 100 = 0"
# The best of each query: lists of them are what postprocessors take.
_LISTS = f"""
    WITH q AS ({_Q}), s AS (SELECT q.query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS k FROM s), l AS (SELECT * FROM r WHERE k <= 100)"""
_BM25 = """
    WITH docs AS (SELECT doc_id AS id, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL),
    st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM docs),
    w AS (SELECT id, len(t) AS l, unnest(t) AS term FROM docs),
    tf AS (SELECT id, l, term, count(*) AS c FROM w WHERE term IN ({terms}) GROUP BY ALL),
    df AS (SELECT term, count(*) AS f FROM tf GROUP BY term),
    s0 AS (SELECT tf.id, sum(ln(1 + (n - f + 0.5) / (f + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * l / a))) AS score
          FROM tf JOIN df USING (term) CROSS JOIN st GROUP BY tf.id),
    s AS (SELECT docs.id, coalesce(s0.score, 0) AS score FROM docs LEFT JOIN s0 USING (id))"""
_TERMS = "'oldest', 'snapshot', 'checksum'"

# --- retrieval ------------------------------------------------------------------------


@registered(f"SELECT e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY {_COS} DESC, id LIMIT 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    first = _vectors(spark, d).orderBy("id").limit(1).select(F.lit("q0").alias("query_id"), F.col("embedding").alias("vector"))
    return ranking.Dense(10).retrieve(first, _vectors(spark, d)).select("id", r6("score").alias("score"))


@registered(f"""
    WITH q AS ({_Q}), s AS (SELECT q.query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e, q WHERE e.label = 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS k FROM s)
    SELECT query_id, id, round(score, 6) AS score FROM r WHERE k <= 10""")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    chunks = _vectors(spark, d).withColumn("metadata", F.create_map(F.lit("label"), F.col("dataset")))
    return ranking.Dense(10, where={"label": "3"}).retrieve(_asked_vectors(spark, d), chunks).select("query_id", "id", r6("score").alias("score"))


@registered(f"""
    WITH q AS ({_Q}), s AS (SELECT q.query_id, CAST(e.label AS VARCHAR) AS dataset, e.vec_id AS id, {_COS} AS score FROM embeddings e, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, dataset ORDER BY round(score, 12) DESC, id) AS rank FROM s)
    SELECT query_id, dataset, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def dense_topk_per_dataset(spark: SparkSession, d: str) -> DataFrame:
    found = ranking.top_per_dataset(_asked_vectors(spark, d), _vectors(spark, d), 3)
    return found.select("query_id", "dataset", "id", r6("score").alias("score"), "rank")


@registered(f"""
    WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT query_id, id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def dense_many_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all."""
    return ranking.Dense(10).retrieve(_asked_vectors(spark, d), _vectors(spark, d)).select("query_id", "id", r6("score").alias("score"))


@registered("""
    WITH c AS (SELECT p.uuid, s.id AS dataset, len(p.embedding) AS n, CAST(p.embedding AS DOUBLE[]) AS e FROM pgvector p JOIN datasets s ON s.pg_collection_uuid = p.collection_id
               WHERE len(p.embedding) > 0 AND isfinite(list_sum(CAST(p.embedding AS DOUBLE[]))) AND len(list_filter(p.embedding, lambda x: x <> 0)) > 0),
    q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY uuid) AS k FROM c) WHERE k % 100 = 1),
    s AS (SELECT q.uuid AS query_id, c.uuid AS id, list_cosine_similarity(c.e, q.e) AS score FROM c JOIN q ON c.dataset = q.dataset AND c.n = q.n),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS k FROM s)
    SELECT query_id, id, round(score, 6) AS score FROM r WHERE k <= 10""")
def collection_search(spark: SparkSession, d: str) -> DataFrame:
    """Searches in all collections: every hundredth usable row of each against the rows of that collection that have its dimension."""
    sets = table(spark, d, "datasets").select(F.col("pg_collection_uuid").alias("collection_id"), F.col("id").alias("dataset"))
    usable = ~F.exists("embedding", F.isnan) & F.exists("embedding", lambda x: x != 0)
    chunks = ranking.in_collections(table(spark, d, "pgvector").where(usable).select(F.col("uuid").alias("id"), "collection_id", "embedding"), sets)
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("id"))
    asked = chunks.select(F.col("id").alias("query_id"), "dataset", place.alias("_k"), F.col("embedding").alias("vector")).where("_k % 100 = 1")
    found = ranking.routed_search(asked.select("query_id", "vector"), asked.select("query_id", "dataset"), chunks)
    return found.select("query_id", "id", r6("score").alias("score"))


@registered("""
    SELECT s.id AS dataset, len(p.embedding) AS dims, count(*) AS n FROM pgvector p JOIN datasets s ON s.pg_collection_uuid = p.collection_id
    WHERE p.embedding IS NOT NULL GROUP BY ALL""")
def collection_dimensions(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "datasets").select(F.col("id").alias("dataset"), F.col("pg_collection_uuid").alias("collection_id"))
    return ranking.collection_sizes(ranking.in_collections(table(spark, d, "pgvector").select(F.col("uuid").alias("id"), "collection_id", "embedding"), sets))


@registered(f"{_BM25.format(terms=_TERMS)} SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 20")
def bm25_topn(spark: SparkSession, d: str) -> DataFrame:
    return ranking.BM25(20).retrieve(_asked(spark, "oldest snapshot checksum"), _texts(spark, d)).select("id", r6("score").alias("score"))


@registered(f"""{_BM25.format(terms="'oldest', 'snapshot'").replace("string_split(text, ' ') AS t", "list_filter(string_split(text, ' '), lambda x: lower(x) NOT IN ('a', 'in', 'of', 'the')) AS t")}
    SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 20""")
def bm25_topn_stopwords(spark: SparkSession, d: str) -> DataFrame:
    found = ranking.BM25(20, stopwords=("a", "in", "of", "the")).retrieve(_asked(spark, "oldest snapshot"), _texts(spark, d))
    return found.select("id", r6("score").alias("score"))


@registered("""
    WITH docs AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, unnest(t) AS term FROM docs)
    SELECT term, count(DISTINCT doc_id) AS df, (SELECT count(*) FROM docs) AS n, round((SELECT avg(len(t)) FROM docs), 6) AS avgdl FROM w GROUP BY term""")
def bm25_statistics(spark: SparkSession, d: str) -> DataFrame:
    overall, terms = ranking.bm25_corpus(_texts(spark, d))
    return terms.crossJoin(F.broadcast(overall)).select("term", "df", "n", r6("avgdl").alias("avgdl"))  # one row of statistics


@registered(f"""{_LISTS},
    m AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM l)
    SELECT query_id, id, round(CASE WHEN hi = 0 THEN 0 WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END, 6) AS score FROM m""")
def score_normalize(spark: SparkSession, d: str) -> DataFrame:
    return ranking.normalise_scores(_lists(spark, d)).select("query_id", "id", r6("score").alias("score"))


@registered(f"""
    {_BM25.format(terms="'oldest', 'snapshot'")}, s2 AS (SELECT * FROM ({_BM25.format(terms="'checksum', 'cursor'")} SELECT id, score FROM s)),
    a AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 30), b AS (SELECT * FROM s2 ORDER BY score DESC, id LIMIT 30),
    na AS (SELECT id, 0.7 * CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS x, 'first' AS r FROM a),
    nb AS (SELECT id, 0.3 * CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS x, 'second' AS r FROM b)
    SELECT id, round(sum(x), 6) AS score, string_agg(r, ',' ORDER BY r) AS retrievers FROM (SELECT * FROM na UNION ALL SELECT * FROM nb) GROUP BY id ORDER BY sum(x) DESC, id LIMIT 10""")
def merge_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Two BM25 rankings, each scaled, weighted and summed."""

    class Fixed(ranking.BM25):
        def __init__(self, text: str):
            super().__init__(30)
            self.text = text

        def retrieve(self, queries: DataFrame, chunks: DataFrame) -> DataFrame:
            return super().retrieve(queries.withColumn("query", F.lit(self.text)), chunks)

    merge = ranking.Merge([("first", 0.7, Fixed("oldest snapshot")), ("second", 0.3, Fixed("checksum cursor"))], 10)
    return merge.retrieve(_asked(spark, ""), _texts(spark, d)).select("id", r6("score").alias("score"), "retrievers")


@registered(f"""
    WITH q AS ({_Q}), s AS (SELECT q.query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS k FROM s),
    m AS (SELECT query_id // 300 AS query_id, id, max(round(score, 12)) AS score FROM r WHERE k <= 3 GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM m)
    SELECT CAST(query_id AS VARCHAR) AS query_id, id, round(score, 6) AS score FROM f WHERE k <= 3""")
def subquery_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Three of the query vectors at a time are the subqueries of one query."""
    vectors = _asked_vectors(spark, d)
    parts = vectors.select(F.floor(F.col("query_id") / 300).cast("string").alias("query_id"), (F.col("query_id") / 100 % 3).cast("int").alias("subquery_no"), "vector")
    return ranking.subquery_search(parts.select("query_id").distinct(), parts, _vectors(spark, d)).select("query_id", "id", r6("score").alias("score"))


@registered(f"""
    WITH q AS ({_Q}), s AS (SELECT q.query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e, q WHERE e.label = q.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS k FROM s)
    SELECT query_id, id, round(score, 6) AS score FROM r WHERE k <= 10""")
def route_then_search(spark: SparkSession, d: str) -> DataFrame:
    """Each query goes to the dataset of its own label."""
    routes = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("dataset"))
    found = ranking.routed_search(_asked_vectors(spark, d), routes, _vectors(spark, d))
    return found.select("query_id", "id", r6("score").alias("score"))


@registered(f"{_LISTS} SELECT query_id, id, round(score, 6) AS score FROM l WHERE score >= 0.4 OR k <= 5")
def similarity_keepmin(spark: SparkSession, d: str) -> DataFrame:
    return postprocess.similarity(_lists(spark, d), 0.4, 5).select("query_id", "id", r6("score").alias("score"))


@registered(f"{_LISTS} SELECT query_id, id, round(score, 6) AS score FROM l WHERE k <= 20")
def reduce_topk(spark: SparkSession, d: str) -> DataFrame:
    return postprocess.reduce(_lists(spark, d), 20).select("query_id", "id", r6("score").alias("score"))


@registered(f"""
    {_BM25.format(terms="'oldest', 'snapshot'")},
    e AS (SELECT d.doc_id AS id, {_COS} AS score FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE d.text IS NOT NULL),
    a AS (SELECT id, 0.7 * round(score, 12) AS x, 'basic' AS r FROM (SELECT * FROM e ORDER BY round(score, 12) DESC, id LIMIT 30)), b AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 30),
    n AS (SELECT id, 0.3 * CASE WHEN max(score) OVER () = 0 THEN 0 WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS x, 'bm25' AS r FROM b)
    SELECT id, round(sum(x), 6) AS score, string_agg(r, ',' ORDER BY r) AS retrievers FROM (SELECT * FROM a UNION ALL SELECT * FROM n) GROUP BY id ORDER BY round(sum(x), 9) DESC, id LIMIT 10""")
def merge_dense_and_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Similarities as they are and BM25 scores scaled, weighted and summed; documents have the vector of their number."""
    vectors = _vectors(spark, d).select("id", "embedding")
    chunks = _texts(spark, d).join(vectors, "id")
    first = vectors.orderBy("id").limit(1).select(F.lit("q0").alias("query_id"), F.lit("oldest snapshot").alias("query"), F.col("embedding").alias("vector"))

    class OfAllTexts(ranking.BM25):
        def retrieve(self, queries: DataFrame, chunks: DataFrame) -> DataFrame:
            return super().retrieve(queries, _texts(spark, d))

    merge = ranking.Merge([("basic", 0.7, ranking.Dense(30)), ("bm25", 0.3, OfAllTexts(30))], 10)
    return merge.retrieve(first, chunks).select("id", r6("score").alias("score"), "retrievers")


@registered("""
    WITH l AS (SELECT doc_id AS id, text, (doc_id % 997) / 997.0::DOUBLE AS sim FROM documents WHERE contains(text, 'snapshot')),
    docs AS (SELECT id, sim, string_split(text, ' ') AS t FROM l), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM docs),
    w AS (SELECT id, len(t) AS l, unnest(t) AS term FROM docs), tf AS (SELECT id, l, term, count(*) AS c FROM w WHERE term IN ('oldest', 'cursor') GROUP BY ALL),
    df AS (SELECT term, count(*) AS f FROM tf GROUP BY term),
    s AS (SELECT tf.id, sum(ln(1 + (n - f + 0.5) / (f + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN df USING (term) CROSS JOIN st GROUP BY tf.id),
    b AS (SELECT docs.id, 0.5 * coalesce(s.score, 0) + 0.5 * sim AS score FROM docs LEFT JOIN s USING (id))
    SELECT id, round(score, 6) AS score FROM b ORDER BY b.score DESC, id LIMIT 10""")
def bm25_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).where(F.col("content").contains("snapshot")).select(F.lit("q0").alias("query_id"), "id", "content", (F.col("id") % 997 / F.lit(997.0)).alias("score"))
    out = postprocess.bm25_rerank(rows, _asked(spark, "oldest cursor"), 10)
    return out.select("id", r6("score").alias("score"))


@registered("SELECT doc_id AS id FROM documents WHERE contains(text, 'checksum') AND NOT contains(text, 'cursor')")
def substring_filter(spark: SparkSession, d: str) -> DataFrame:
    return postprocess.content_substring(_texts(spark, d), ["checksum"], ["cursor"]).select("id")


@registered("SELECT doc_id AS id FROM documents WHERE (contains(text, 'snapshot') OR contains(text, 'Tamsel')) AND NOT contains(text, 'console')")
def keyword_predicate(spark: SparkSession, d: str) -> DataFrame:
    return postprocess.keywords(_texts(spark, d), ["snapshot", "Tamsel", "-console"]).select("id")


@registered("""
    SELECT id, list_filter(list_transform(regexp_extract_all(content, '"([^"]*)"', 1), lambda x: trim(x, ' ')), lambda x: x <> '') AS phrases FROM sqlite_vec WHERE content IS NOT NULL""")
def quoted_phrases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sqlite_vec").where("content IS NOT NULL").select("id", S.quoted_phrases(F.col("content")).alias("phrases"))


@registered()
def format_hits_budget(spark: SparkSession, d: str) -> DataFrame:
    """The result lists of two questions of two subqueries each, whole documents in place of the first large hits."""
    asked = {"q0": ("oldest snapshot", "checksum differs"), "q1": ("the failed batch", "cursor moves")}
    texts = _texts(spark, d)
    lists = None
    for query_id, parts in asked.items():
        for k, text in enumerate(parts):
            found = ranking.BM25(10).retrieve(_asked(spark, text), texts).select(F.lit(query_id).alias("query_id"), F.lit(k).alias("subquery_no"), "id", "score")
            lists = found if lists is None else lists.unionByName(found)
    lists = ranking.ranked(lists, ["query_id", "subquery_no"]).join(texts.select("id", "content"), "id")
    rows = lists.select("query_id", "subquery_no", "rank", "content", F.concat(F.lit("doc:"), "id").alias("url"), F.col("id").cast("string").alias("file"), F.octet_length("content").cast("bigint").alias("file_size"))
    sources = texts.select(F.col("id").cast("string").alias("file"), F.col("content").alias("text"))
    return postprocess.format_hits(rows, sources)


# --- ingestion ------------------------------------------------------------------------


@registered("SELECT id FROM sqlite_vec WHERE content <> '' AND len(list_filter(string_split(content, chr(10)), lambda x: NOT starts_with(x, '#'))) > 0")
def markdown_filter(spark: SparkSession, d: str) -> DataFrame:
    return transforms.filter_markdown(table(spark, d, "sqlite_vec")).select("id")


@registered("""
    WITH t AS (SELECT doc_id AS id, string_split(text, ' ') AS w FROM documents WHERE text <> ''),
    i AS (SELECT id, w, unnest(generate_series(0, greatest(CAST(ceil((len(w) - 8) / 24.0) AS BIGINT), 1) - 1)) AS k FROM t)
    SELECT id, CAST(k AS INT) AS "docIndex", array_to_string(list_slice(w, k * 24 + 1, k * 24 + 32), ' ') AS content FROM i""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    return splitters.split_tokens(_texts(spark, d).select("id", "content"), 32, 8)


@registered()
def markdown_split(spark: SparkSession, d: str) -> DataFrame:
    return splitters.split_markdown(table(spark, d, "sqlite_vec").select("id", "content"), 800)


@registered()
def line_pack(spark: SparkSession, d: str) -> DataFrame:
    return splitters.split_lines(_texts(spark, d).select("id", "content"), 400)


_META = "CASE WHEN json_valid(metadata) THEN CAST(metadata AS JSON) END"


@registered(f"""
    WITH m AS (SELECT id, collection_id AS c, json_extract_string({_META}, '$.absPath') AS p, CAST(TRY_CAST(json_extract_string({_META}, '$.docIndex') AS DOUBLE) AS INT) AS i FROM sqlite_vec)
    SELECT id, CASE WHEN p IS NULL OR c IS NULL THEN i ELSE CAST(row_number() OVER (PARTITION BY c, p ORDER BY i ASC NULLS LAST, id) - 1 AS INT) END AS doc_index,
      CASE WHEN p IS NULL OR c IS NULL THEN NULL ELSE CAST(count(*) OVER (PARTITION BY c, p) AS INT) END AS docs_total FROM m""")
def chunk_renumber(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sqlite_vec").select("id", "collection_id", F.get_json_object("metadata", "$.absPath").alias("p"), F.create_map(F.lit("docIndex"), F.get_json_object("metadata", "$.docIndex")).alias("metadata"))
    out = transforms.renumber(rows, ["collection_id", "p"])
    return out.select("id", F.col("metadata")["docIndex"].try_cast("double").cast("int").alias("doc_index"), F.col("metadata")["docsTotal"].cast("int").alias("docs_total"))


@registered()
def page_merge_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sqlite_vec").select(
        F.concat_ws("|", "collection_id", F.get_json_object("metadata", "$.absPath")).alias("file_id"), F.get_json_object("metadata", "$.page").try_cast("double").cast("int").alias("page"), "content"
    )
    rows = rows.where("page IS NOT NULL AND content IS NOT NULL").withColumn("tokens", F.size(S.space_tokens(F.col("content"))))
    return transforms.merge_pages(rows, 400)


@registered(f"""
    SELECT id, json_extract_string({_META}, '$.filename') AS filename, '42' AS added FROM sqlite_vec""")
def metadata_manipulate(spark: SparkSession, d: str) -> DataFrame:
    """One key added, one overwritten, one removed."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    rows = table(spark, d, "sqlite_vec").select("id", F.coalesce(F.from_json(F.when(F.col("metadata").startswith("{") & F.col("metadata").endswith("}"), F.col("metadata")), "map<string,string>"), empty).alias("metadata"))
    out = transforms.manipulate_metadata(rows, [("add", "added", "1"), ("upsert", "added", "42"), ("remove", "absPath")])
    return out.select("id", F.col("metadata")["filename"].alias("filename"), F.col("metadata")["added"].alias("added"))


@registered(f"""
    WITH m AS (SELECT collection_id || '|' || json_extract_string({_META}, '$.absPath') AS file, {_META} AS j FROM sqlite_vec WHERE json_extract_string({_META}, '$.absPath') IS NOT NULL),
    e AS (SELECT file, k AS key, json_extract_string(j, '$.' || k) AS value FROM (SELECT file, j, unnest(json_keys(j)) AS k FROM m)),
    n AS (SELECT file, count(*) AS n FROM m GROUP BY 1), c AS (SELECT file, key, value, count(*) AS c FROM e GROUP BY ALL)
    SELECT file, key, value FROM c JOIN n USING (file) WHERE c = n""")
def common_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What the metadata of all chunks of a file share."""
    meta = F.from_json("metadata", "map<string,string>")
    rows = table(spark, d, "sqlite_vec").select("collection_id", meta.alias("metadata")).where("metadata['absPath'] IS NOT NULL")
    return transforms.common_metadata(rows.select(F.concat_ws("|", "collection_id", F.col("metadata")["absPath"]).alias("file"), "metadata"), ["file"])


@registered(f"""
    SELECT collection_id, json_extract_string({_META}, '$.loader') AS loader, count(*) AS n FROM sqlite_vec
    WHERE json_extract_string({_META}, '$.page') IS NOT NULL GROUP BY ALL""")
def json_field_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sqlite_vec").select("collection_id", S.json_texts(F.col("metadata"), "loader", "page").alias("m"))
    return connectors.counted(rows.where("m.page IS NOT NULL").select("collection_id", "m.loader"), ["collection_id", "loader"])


@registered("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY dataset, absolute_path ORDER BY modified_at DESC NULLS LAST, ingest_id DESC) AS k FROM ingest_opts WHERE absolute_path IS NOT NULL),
    f AS (SELECT dataset, absolute_path, max(modified_at) AS t, count(*) AS c FROM files WHERE absolute_path IS NOT NULL GROUP BY ALL)
    SELECT r.ingest_id, r.dataset, r.absolute_path, r.modified_at FROM r LEFT JOIN f USING (dataset, absolute_path) WHERE k = 1 AND (f.c IS NULL OR r.modified_at > f.t OR (f.t IS NULL AND r.modified_at IS NOT NULL))""")
def dedupe_upsert(spark: SparkSession, d: str) -> DataFrame:
    incoming = table(spark, d, "ingest_opts").where("absolute_path IS NOT NULL").select("ingest_id", "dataset", "absolute_path", "modified_at")
    existing = table(spark, d, "files").where("absolute_path IS NOT NULL")
    return dedupe.upsert(incoming, existing, tie=["ingest_id"])


@registered("""
    SELECT DISTINCT ingest_id FROM ingest_opts i WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.dataset IS NOT DISTINCT FROM i.dataset
      AND f.absolute_path IS NOT DISTINCT FROM i.absolute_path AND f.size IS NOT DISTINCT FROM i.size AND f.modified_at IS NOT DISTINCT FROM i.modified_at)""")
def dedupe_file_metadata(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.by_file_metadata(table(spark, d, "ingest_opts"), table(spark, d, "files")).select("ingest_id").distinct()


@registered("SELECT sha256(content) AS checksum, min(id) AS id FROM sqlite_vec WHERE content IS NOT NULL GROUP BY content")
def dedupe_checksum(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.by_checksum(table(spark, d, "sqlite_vec").where("content IS NOT NULL").select("id", "content")).select("checksum", "id")


@registered("""
    WITH b AS (SELECT dataset, absolute_path, max(modified_at) AS t FROM files WHERE absolute_path IS NOT NULL AND dataset IS NOT NULL GROUP BY ALL),
    a AS (SELECT dataset, absolute_path, max(modified_at) AS t FROM ingest_opts WHERE absolute_path IS NOT NULL AND dataset IS NOT NULL GROUP BY ALL)
    SELECT dataset, absolute_path, CASE WHEN b.absolute_path IS NULL THEN 'insert' WHEN a.absolute_path IS NULL THEN 'delete' ELSE 'update' END AS change
    FROM (SELECT *, 1 AS o FROM b) b FULL JOIN (SELECT *, 1 AS o FROM a) a USING (dataset, absolute_path) WHERE a.o IS NULL OR b.o IS NULL OR a.t IS DISTINCT FROM b.t""".replace("b.absolute_path IS NULL", "b.o IS NULL").replace("a.absolute_path IS NULL", "a.o IS NULL"))
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    newest = lambda name: table(spark, d, name).where("absolute_path IS NOT NULL AND dataset IS NOT NULL").groupBy("dataset", "absolute_path").agg(F.max("modified_at").alias("t"))
    return dedupe.snapshot_diff(newest("files"), newest("ingest_opts"), ["dataset", "absolute_path"], "t")


@registered("""
    SELECT DISTINCT f.id, f.absolute_path FROM files f WHERE starts_with(f.absolute_path, '/data/') AND f.absolute_path NOT IN (SELECT absolute_path FROM ingest_opts WHERE absolute_path IS NOT NULL AND is_duplicate_func_name IS NOT NULL)""")
def prune_prefix(spark: SparkSession, d: str) -> DataFrame:
    keep = table(spark, d, "ingest_opts").where("is_duplicate_func_name IS NOT NULL").select("absolute_path")
    return dedupe.prune(table(spark, d, "files"), keep, "/data/").select("id", "absolute_path").distinct()


@registered(f"""
    SELECT DISTINCT f.dataset, f.name FROM files f WHERE NOT EXISTS (SELECT 1 FROM sqlite_vec v WHERE v.collection_id = f.dataset AND json_extract_string(CASE WHEN json_valid(v.metadata) THEN CAST(v.metadata AS JSON) END, '$.filename') = f.name)""")
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that no chunk of their dataset names."""
    held = table(spark, d, "sqlite_vec").select(F.col("collection_id").alias("dataset"), F.from_json("metadata", "filename string")["filename"].alias("file_id"))
    return dedupe.orphans(table(spark, d, "files").select("dataset", F.col("name").alias("id")), held.where("file_id IS NOT NULL")).select("dataset", F.col("id").alias("name")).distinct()


@registered("SELECT CASE WHEN f.absolute_path IS NULL THEN 'ingested' ELSE 'skipped' END AS outcome, count(*) AS n FROM ingest_opts i LEFT JOIN (SELECT DISTINCT absolute_path FROM files) f ON f.absolute_path = i.absolute_path GROUP BY 1")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.outcome_counts(table(spark, d, "ingest_opts"), table(spark, d, "files"))


@registered("SELECT id, sha1(absolute_path) AS dataset_id FROM files WHERE absolute_path IS NOT NULL")
def path_dataset_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").where("absolute_path IS NOT NULL").select("id", S.path_dataset(F.col("absolute_path")).alias("dataset_id"))


_KNOWN = ", ".join(f"'{e}'" for e in loaders.FIRST_CLASS)


@registered(f"""
    WITH e AS (SELECT lower(regexp_extract(name, '(\\.[^./\\\\]+)$', 1)) AS x FROM files) SELECT CASE WHEN x IN ({_KNOWN}) THEN x ELSE '.txt' END AS ext, count(*) AS n FROM e GROUP BY 1""")
def file_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select(loaders.file_type(F.col("name")).alias("ext")).groupBy("ext").agg(F.count("*").alias("n"))


@registered("""
    WITH k AS (SELECT id, unnest(json_keys(CAST(metadata AS JSON))) AS key, metadata FROM datasets WHERE json_valid(metadata)), v AS (SELECT id, key, json_extract_string(CAST(metadata AS JSON), '$.' || key) AS value FROM k)
    SELECT id, key, value FROM v WHERE value IS NOT NULL AND value NOT IN ('', '-', 'null', 'nil')""")
def dataset_metadata_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "datasets").select("id", S.clean_metadata(F.from_json("metadata", "map<string,string>")).alias("m"))
    return rows.select("id", F.explode("m").alias("key", "value"))


@registered("""
    SELECT id, json_extract_string(CAST(embeddings_provider_config AS JSON), '$.name') AS name, CASE WHEN json_extract_string(CAST(embeddings_provider_config AS JSON), '$.config.apiKey') IS NOT NULL THEN 'REDACTED' END AS api_key
    FROM datasets""")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    config = F.from_json("embeddings_provider_config", "name string, type string, config struct<embeddingModel:string,apiKey:string>")
    out = S.redact_secrets(table(spark, d, "datasets").select("id", config.alias("c")))
    return out.select("id", F.col("c.name").alias("name"), F.col("c.config.apiKey").alias("api_key"))


@registered("""
    SELECT s.id AS dataset, count(DISTINCT f.name) AS files, (SELECT count(*) FROM sqlite_vec v WHERE v.collection_id = s.id) AS chunks
    FROM datasets s LEFT JOIN files f ON f.dataset = s.id GROUP BY s.id""")
def nested_catalog(spark: SparkSession, d: str) -> DataFrame:
    sets, files = table(spark, d, "datasets").select(F.col("id").alias("dataset")), table(spark, d, "files")
    return dedupe.contents_of_datasets(sets, files, table(spark, d, "sqlite_vec").select(F.col("collection_id").alias("dataset")))


@registered()
def structured_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a file as structured JSON with shared metadata moved up, and read back."""
    rows = table(spark, d, "sqlite_vec").select(
        F.from_json("metadata", "map<string,string>").alias("metadata"), "content", "collection_id", F.get_json_object("metadata", "$.docIndex").try_cast("double").cast("int").alias("doc_index")
    )
    rows = rows.where("metadata['absPath'] IS NOT NULL").withColumn("path", F.concat_ws("|", "collection_id", F.col("metadata")["absPath"])).drop("collection_id")
    return loaders.structured(sinks.structured_json(rows)).select("path", "doc_index", "content", F.to_json("metadata").alias("metadata"))


@registered()
def html_clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    return page_markdown(table(spark, d, "documents"), "doc_id", "text", main_only=False)


# --- scalars --------------------------------------------------------------------------


@registered("""
    WITH m AS (SELECT message_id, lower(regexp_extract(to_addr, '@(.+)$', 1)) AS h FROM gmail_messages WHERE to_addr IS NOT NULL)
    SELECT DISTINCT message_id, h AS host, CASE WHEN h IN ('example.com', 'www.example.com') OR (len(string_split(h, '.')) = 3 AND regexp_matches(h, '^www.?\\.example\\.com$')) THEN true ELSE false END AS same FROM m""")
def same_site_links(spark: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.regexp_extract("to_addr", "@(.+)$", 1))
    rows = table(spark, d, "gmail_messages").where("to_addr IS NOT NULL").select("message_id", host.alias("host"))
    return rows.select("message_id", "host", S.same_site(F.col("host"), F.lit("example.com")).alias("same")).distinct()


@registered("SELECT DISTINCT id, 'files.example' || '/' || name || '.html' AS file FROM files WHERE name IS NOT NULL AND regexp_full_match(name, '[A-Za-z0-9._-]+')")
def url_to_path(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "files").where(F.col("name").rlike("^[A-Za-z0-9._-]+$"))
    return rows.select("id", S.url_file(F.concat(F.lit("https://files.example/"), "name")).alias("file")).distinct()


@registered("SELECT p_partkey, CAST(DATE '1900-01-01' + CAST(p_partkey - 2 AS INT) AS DATE) AS day FROM part")
def serial_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.serial_date(F.col("p_partkey")).alias("day"))


_DIGITS = 14  # of base 26, as many as a 64-bit number has
_REST = ", ".join(["p_partkey AS n0", *(f"CASE WHEN n{k} > 0 THEN (n{k} - 1) // 26 ELSE 0 END AS n{k + 1}" for k in range(_DIGITS - 1))])
_LETTERS = " || ".join(f"CASE WHEN n{k} > 0 THEN chr(CAST(65 + (n{k} - 1) % 26 AS INT)) ELSE '' END" for k in reversed(range(_DIGITS)))


@registered(f"SELECT n0 AS n, {_LETTERS} AS letters, n0 AS back FROM (SELECT {_REST} FROM part)")
def a1_letters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("n"), S.column_letters(F.col("p_partkey")).alias("letters"))
    return rows.select("n", "letters", S.column_number(F.col("letters")).alias("back"))


@registered("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc FROM events")
def time_texts(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", S.epoch_ms_text(ms).alias("text"), S.rfc3339(F.col("ts")).alias("rfc"))


@registered("SELECT DISTINCT message_id, trim(string_split(mime_type, ';')[1]) AS media, replace(replace(rtrim(to_base64(encode(to_addr)), '='), '/', '_'), '+', '-') AS token FROM gmail_messages WHERE to_addr IS NOT NULL")
def mail_encodings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gmail_messages").where("to_addr IS NOT NULL")
    return rows.select("message_id", S.media_type(F.col("mime_type")).alias("media"), F.substring(S.share_token(F.col("to_addr")), 3, 10_000).alias("token")).distinct()


@registered("""
    SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS short, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''), chr(10)) AS dense FROM documents WHERE text IS NOT NULL""")
def text_trimming(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", S.truncated(F.col("text"), 500).alias("short"), S.drop_blank_lines(F.col("text")).alias("dense"))


@registered("SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS squares FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.size("embedding").cast("bigint").alias("dims"), r6(S.norm(F.col("embedding")) * S.norm(F.col("embedding"))).alias("squares"))


# --- lookups and connectors -----------------------------------------------------------


@registered("""
    WITH m AS (SELECT DISTINCT message_id, thread_id, subject, sent_at FROM gmail_messages)
    SELECT message_id, subject, sent_at FROM m WHERE sent_at >= TIMESTAMP '2024-01-01' AND contains(subject, 'Search') ORDER BY sent_at DESC, message_id LIMIT 50""")
def mail_range_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gmail_messages").select("message_id", "thread_id", "subject", "sent_at").distinct()
    hit = rows.where(lookup.in_range(F.col("sent_at"), start="2024-01-01") & lookup.contains_all(subject="Search"))
    return lookup.newest(hit, "sent_at", 50, "message_id").select("message_id", "subject", "sent_at")


@registered("SELECT DISTINCT message_id FROM gmail_messages WHERE contains(lower(subject), 'quota') OR contains(lower(message_text), 'quota')")
def either_field_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gmail_messages").where(lookup.either_contains(F.col("subject"), F.col("message_text"), "Quota")).select("message_id").distinct()


@registered("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    return lookup.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 3, 50)


@registered("""
    WITH m AS (SELECT DISTINCT message_id, thread_id, sent_at FROM gmail_messages WHERE thread_id IS NOT NULL),
    p AS (SELECT thread_id, min(message_id) AS parent FROM m GROUP BY 1),
    r AS (SELECT parent, message_id, row_number() OVER (PARTITION BY parent ORDER BY sent_at NULLS FIRST, message_id) AS n FROM m JOIN p USING (thread_id) WHERE message_id <> parent)
    SELECT p.parent AS id, r.message_id AS reply_id, CAST(r.n AS INT) AS reply_no FROM p LEFT JOIN r ON r.parent = p.parent AND r.n <= 3""")
def chat_with_replies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gmail_messages").where("thread_id IS NOT NULL").select("message_id", "thread_id", "sent_at").distinct()
    parents = rows.groupBy("thread_id").agg(F.min("message_id").alias("parent_id"))
    replies = rows.join(parents, "thread_id").select(F.col("message_id").alias("id"), "parent_id", F.col("sent_at").alias("ts"), F.lit("").alias("text"))
    return lookup.with_replies(parents.select(F.col("parent_id").alias("id")), replies).select("id", "reply_id", "reply_no")


@registered("SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def lookup_left_join(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookup.lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey", "n_name", "nation").select("c_custkey", "nation")


@registered("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def calendar_union(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    two = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return lookup.union_all([one, two])


@registered("""
    WITH e AS (SELECT event_type AS calendar, event_id AS id, ts AS start, ts + INTERVAL 1 HOUR AS e FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY calendar ORDER BY start, id) AS n FROM e WHERE start <= TIMESTAMP '2024-01-20' AND e >= TIMESTAMP '2024-01-10')
    SELECT calendar, id FROM r WHERE n <= 100""")
def events_between(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("calendar"), F.col("event_id").alias("id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("end"))
    bound = lambda x: F.lit(x).cast("timestamp_ntz")
    return lookup.events_between([rows], bound("2024-01-10"), bound("2024-01-20")).select("calendar", "id")


@registered("""
    WITH k AS (SELECT DISTINCT to_addr AS a FROM gmail_messages WHERE to_addr IS NOT NULL), o AS (SELECT DISTINCT cc AS a FROM gmail_messages WHERE cc IS NOT NULL),
    n AS (SELECT a, row_number() OVER (ORDER BY a) AS id FROM k), f AS (SELECT a FROM o WHERE a NOT IN (SELECT a FROM k))
    SELECT a AS external_id, id FROM n UNION ALL SELECT a, (SELECT max(id) FROM n) + row_number() OVER (ORDER BY a) FROM f""")
def numbered_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gmail_messages")
    none = spark.createDataFrame([], "external_id string, id bigint")
    known = lookup.numbered_ids(none, rows.where("to_addr IS NOT NULL").select(F.col("to_addr").alias("external_id")))
    return lookup.numbered_ids(known, rows.where("cc IS NOT NULL").select(F.col("cc").alias("external_id")))


@registered("""
    SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10 AND p_size <= 40 AND p_brand IN ('Brand#11', 'Brand#23', 'Brand#12') OR p_retailprice * 2 > 3000""")
def sheet_query(spark: SparkSession, d: str) -> DataFrame:
    return lookup.sheet_query(table(spark, d, "part"), "10 < p_size <= 40 and p_brand in @brands or `p_retailprice` * 2 > 3000", ["p_partkey", "p_name", "p_size"], {"brands": ["Brand#11", "Brand#23", "Brand#12"]})


@registered("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
    g AS (SELECT *, trim(line, ' ') = '' AS b, sum(CASE WHEN trim(line, ' ') = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS gap FROM l)
    SELECT doc_id, CAST(n AS INT) AS n, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY gap) AS INT) AS table_no FROM g WHERE NOT b""")
def blank_row_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lookup.blank_row_tables(rows, "n", F.trim("line") == "", ["doc_id"]).select("doc_id", "n", "table_no")


@registered("""
    WITH RECURSIVE t AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS up, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation),
    p AS (SELECT id, title AS path, 0 AS depth FROM t WHERE up IS NULL UNION ALL SELECT t.id, p.path || '/' || t.title, p.depth + 1 FROM t JOIN p ON t.up = p.id)
    SELECT id, path, CAST(depth AS INT) AS depth FROM p""")
def ancestor_paths(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    low = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"))
    return lookup.ancestor_paths(top.unionByName(low))


@registered("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return connectors.counted(table(spark, d, "documents"), "source", "lang")


# --- SQL ------------------------------------------------------------------------------

_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "benchmark",
    "datasets", "textsplitter_opts", "smartpdf_config", "files", "ingest_opts", "sqlite_vec", "pgvector", "gmail_messages",
)
_NAMES = ", ".join(f"'{t}'" for t in sorted(_TABLES))

# Statements that read the same in both engines.
_STATEMENTS = {
    "sql_inner_join_agg": """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name""",
    "sql_left": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "sql_full": "SELECT n_name, count(DISTINCT s_suppkey) AS suppliers FROM nation FULL JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    "sql_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "sql_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
    "sql_theta": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    "sql_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "sql_group_having": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "sql_distinct_agg": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "sql_rank": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INT) AS place FROM orders",
    "sql_lag_lead": """SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
        lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events""",
    "sql_running_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total FROM orders",
    "sql_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM part",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier",
    "sql_correlated": "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "sql_recursive_cte": """WITH RECURSIVE s AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n, n * n AS square FROM s""",
    "sql_case_dates": """SELECT extract(year FROM o_orderdate) AS y, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, count(*) AS n FROM orders GROUP BY 1""",
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_topk_revenue": """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 20""",
}


def _statement(text: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        sql.register(spark, d, _TABLES)
        return sql.query(spark, text)

    return run


for _name, _text in _STATEMENTS.items():
    _QUERIES[_name] = _statement(_text)
    _SQL[_name] = _text


@registered(f"SELECT unnest([{_NAMES}]) AS name")
def list_tables(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark, d, _TABLES)
    return sql.list_tables(spark).where(F.col("name").isin(*_TABLES))  # the session may hold others


@registered(f"SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ({_NAMES}) AND column_name NOT IN ('props')")
def describe_schema(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark, d, _TABLES)
    return sql.describe(spark, exclude=("props",)).where(F.col("table_name").isin(*_TABLES)).select("table_name", "column_name")


# --- windows over events (extensions) -------------------------------------------------


@registered("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = sync.tumbling_counts(table(spark, d, "events"), "ts", "1 hour", "1 hour", ["event_type"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@registered("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
    k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM k GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = sync.sessions(table(spark, d, "events"), "ts", "30 minutes", "1 hour", "user_id")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


# --- more connectors, sources and state -----------------------------------------------


@registered("SELECT DISTINCT source FROM documents WHERE contains(source, 'look') OR contains(lang, 'es')")
def named_like(spark: SparkSession, d: str) -> DataFrame:
    return connectors.named_like(table(spark, d, "documents").select("source", "lang"), "look", "source").unionByName(connectors.named_like(table(spark, d, "documents").select("source", "lang"), "es", "lang")).select("source").distinct()


@registered("""
    WITH m AS (SELECT DISTINCT message_id, thread_id, sent_at FROM gmail_messages WHERE sent_at IS NOT NULL), c AS (SELECT min(thread_id) AS t FROM m)
    SELECT message_id AS id FROM m, c WHERE thread_id = t AND epoch(sent_at) >= 0 ORDER BY sent_at DESC, id LIMIT 100""")
def history_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gmail_messages").where("sent_at IS NOT NULL").select("message_id", "thread_id", "sent_at").distinct()
    first = F.broadcast(rows.agg(F.min("thread_id").alias("thread_id")))
    own = rows.join(first, "thread_id").select(F.col("message_id").alias("id"), F.lit("c").alias("channel"), F.unix_micros(F.col("sent_at").cast("timestamp")).cast("double").alias("ts"))
    return connectors.history(own, "c", oldest=0).select("id")


@registered("SELECT doc_id AS id, coalesce(source, 'Unassigned') AS assignee FROM documents")
def issue_defaults(spark: SparkSession, d: str) -> DataFrame:
    empty = F.lit(None).cast("string")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), empty.alias("key"), empty.alias("summary"), empty.alias("status"), F.col("source").alias("assignee"), empty.alias("reporter"), empty.alias("created"), empty.alias("updated"))
    return connectors.issue_fields(rows).select("id", "assignee")


@registered("SELECT dataset FROM documents WHERE dataset IS NOT NULL GROUP BY dataset HAVING count(DISTINCT CASE WHEN lang IN ('en', 'fr', 'de') THEN lang END) = 3")
def all_scopes(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "documents").where("dataset IS NOT NULL").groupBy("dataset").agg(F.collect_set("lang").alias("scopes"))
    return sets.where(lookup.has_scopes(F.col("scopes"), ["en", "fr", "de"])).select("dataset")


@registered("""
    WITH m AS (SELECT DISTINCT message_id, thread_id, sent_at FROM gmail_messages WHERE thread_id IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at NULLS FIRST, message_id) AS n FROM m) SELECT thread_id, message_id FROM r WHERE n = 1""")
def first_of_thread(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gmail_messages").where("thread_id IS NOT NULL").select("message_id", "thread_id", "sent_at").distinct()
    return dedupe.first_seen(rows, ["thread_id"], ["sent_at", "message_id"]).select("thread_id", "message_id")


@registered(f"SELECT id, list_sort(json_keys({_META})) AS keys FROM sqlite_vec WHERE len(json_keys({_META})) > 0")
def sorted_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sqlite_vec").select("id", F.from_json("metadata", "map<string,string>").alias("params")).where("size(params) > 0 AND params IS NOT NULL")
    return connectors.task_parameters(rows).select("id", F.transform("params", lambda p: p["key"]).alias("keys"))


@registered("""
    WITH a AS (SELECT to_addr AS k, list(DISTINCT cc) AS v FROM gmail_messages WHERE cc IS NOT NULL AND to_addr IS NOT NULL GROUP BY 1), b AS (SELECT to_addr AS k, list(DISTINCT bcc) AS v FROM gmail_messages WHERE bcc IS NOT NULL AND to_addr IS NOT NULL GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, list_concat(coalesce(list_sort(a.v), []), coalesce(list_sort(b.v), [])) AS v FROM a FULL JOIN b ON a.k = b.k""")
def merged_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gmail_messages").where("to_addr IS NOT NULL")
    part = lambda c: rows.where(F.col(c).isNotNull()).groupBy(F.col("to_addr").alias("k")).agg(F.sort_array(F.collect_set(c)).alias("v"))
    return lookup.merged_lists([part("cc"), part("bcc")], "k", "v")


@registered(f"""
    SELECT collection_id AS dataset, json_extract_string({_META}, '$.filename') AS file_id, count(*) AS n FROM sqlite_vec WHERE json_extract_string({_META}, '$.filename') IS NOT NULL GROUP BY ALL""")
def documents_per_file(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sqlite_vec").select(F.col("collection_id").alias("dataset"), S.json_texts(F.col("metadata"), "filename")["filename"].alias("file_id"))
    return dedupe.documents_per_file(rows)


@registered("SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_type) AS text FROM events GROUP BY user_id")
def transcript_join(spark: SparkSession, d: str) -> DataFrame:
    return loaders.transcript(table(spark, d, "events").select("user_id", "ts", F.col("event_type").alias("text")), "user_id", "ts")


@registered("SELECT url FROM (SELECT to_addr AS url, min(message_id) AS position FROM gmail_messages WHERE NOT contains(to_addr, 'youtube.com') GROUP BY 1) ORDER BY position, url LIMIT 20")
def search_results(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gmail_messages").where("to_addr IS NOT NULL").select(F.col("to_addr").alias("url"), F.col("message_id").alias("position"))
    return loaders.search_results(rows, 20).select("url")


@registered("SELECT uuid FROM pgvector WHERE octet_length(document) <= 400")
def readable_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents within a size limit that are valid UTF-8."""
    return loaders.readable(table(spark, d, "pgvector").select("uuid", F.col("document").alias("data")), 400).select("uuid")


@registered("""
    WITH s AS (SELECT dataset, absolute_path, max(modified_at) AS t FROM files WHERE absolute_path IS NOT NULL AND dataset IS NOT NULL GROUP BY ALL) SELECT * FROM s""")
def merged_state(spark: SparkSession, d: str) -> DataFrame:
    """The state that a sync makes of the ingest attempts when the files are the new snapshot."""
    newest = lambda name: table(spark, d, name).where("absolute_path IS NOT NULL AND dataset IS NOT NULL").groupBy("dataset", "absolute_path").agg(F.max("modified_at").alias("t"))
    before, after, keys = newest("ingest_opts"), newest("files"), ["dataset", "absolute_path"]
    return dedupe.merged_state(before, dedupe.snapshot_diff(before, after, keys, "t"), after, keys)


@registered("""
    SELECT d.doc_id AS url FROM documents d LEFT JOIN (SELECT doc_id, sha256(text) AS c, coalesce(source, lang) AS tag FROM documents WHERE text IS NOT NULL AND lang = 'en') o ON o.doc_id = d.doc_id
    WHERE d.text IS NOT NULL AND o.doc_id IS NULL""")
def content_changes(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose tag and checksum are not in the state of the English ones."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("url"), F.col("source").alias("etag"), F.col("lang").alias("last_modified"), F.col("text").alias("content"))
    state = rows.where("last_modified = 'en'").withColumn("checksum", F.sha2("content", 256)).drop("content")
    return dedupe.content_changes(state, rows).select("url")


@registered("""
    SELECT DISTINCT id, CASE WHEN starts_with(absolute_path, '/data/2023/') THEN 'deep' WHEN starts_with(absolute_path, '/data/') THEN 'top' END AS level FROM files WHERE absolute_path IS NOT NULL""")
def directory_metadata(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").where("absolute_path IS NOT NULL").select("id", F.col("absolute_path").alias("path")).distinct()
    entries = spark.createDataFrame([("/data", {"level": "top"}), ("/data/2023", {"level": "deep"})], "folder string, metadata map<string,string>")
    return transforms.directory_metadata(files, entries).select("id", F.col("metadata")["level"].alias("level")).distinct()


@registered("SELECT message_id FROM (SELECT DISTINCT message_id, sent_at, subject FROM gmail_messages) WHERE subject = 'Sheet import' ORDER BY sent_at DESC NULLS LAST, message_id LIMIT 1")
def mail_by_subject(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array().cast("array<struct<filename:string,attachment_id:string>>")
    rows = table(spark, d, "gmail_messages").select(F.col("message_id").alias("id"), "sent_at", "subject").distinct().withColumn("parts", parts)
    return connectors.mail_by(rows, subject="Sheet import").select(F.col("id").alias("message_id"))


@registered("SELECT r_name AS name, list_sort(list(n_name)) AS statuses FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def types_with_statuses(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    statuses = table(spark, d, "nation").select(F.col("n_regionkey").alias("type_id"), F.col("n_name").alias("status"))
    return connectors.types_with_statuses(types, statuses).select("name", "statuses")


@registered("""
    WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(w) AS tokens, len(list_filter(w, lambda x: lower(x) NOT IN ('the', 'a', 'of'))) AS kept FROM t""")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    words = S.space_tokens(F.col("text"))
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.size(words).cast("bigint").alias("tokens"), F.size(S.without_stopwords(words, ("the", "a", "of"))).cast("bigint").alias("kept"))


@registered()
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all chunks by the built-in provider."""
    return providers.embedded(table(spark, d, "sqlite_vec").select("id", "content"), providers.HashingEmbedder(16)).select("id", "embedding")


@registered()
def document_elements(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as elements, rendered again: tables with their rule, the rest as it is."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    is_row = F.col("text").startswith("| ")
    rows = lines.select("doc_id", "position", F.when(is_row, "row").otherwise("paragraph").alias("kind"), F.lit(0).alias("level"), "text", F.split(F.trim("text"), "\\s*\\|\\s*").alias("cells"))
    return connectors.document_markdown(rows)
