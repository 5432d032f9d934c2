"""Queries of the training-data operators, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.core.runtime import ship, table
from strataline.llm import abuse, encoding, leakage, neardup, pii, scans, splitting, vectors


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, d, "sqlite_vec"), table(spark, d, "textsplitter_opts"))
    return pieces.where(F.size("pieces") > 1).select("id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces_of(splitting.split_oversized(table(spark, d, "sqlite_vec"), table(spark, d, "textsplitter_opts")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_noise(table(spark, d, "sqlite_vec"), table(spark, d, "smartpdf_config"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_pages(table(spark, d, "sqlite_vec"), table(spark, d, "smartpdf_config"))


def _messages_and_chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list]:
    messages, chunks = table(spark, d, "gmail_messages"), table(spark, d, "sqlite_vec")
    texts = messages.select(F.col("message_text").alias("text")).unionByName(chunks.select(F.col("content").alias("text")))
    return messages, chunks, pii.name_lexicon(texts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    messages, chunks, lexicon = _messages_and_chunks(spark, d)
    mail = pii.find_personal(messages, lexicon, "message_id", "message_text").distinct()
    vec = pii.find_personal(chunks, lexicon, "id", "content")
    found = mail.select(F.lit("gmail_messages").alias("src"), "*").unionByName(vec.select(F.lit("sqlite_vec").alias("src"), "*"))
    return found.select("src", "record_id", "kind", "start_pos")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    messages, chunks, lexicon = _messages_and_chunks(spark, d)
    mail = pii.redact_personal(messages, lexicon, "message_id", "message_text").distinct()
    vec = pii.redact_personal(chunks, lexicon, "id", "content")
    return mail.select(F.lit("gmail_messages").alias("src"), "*").unionByName(vec.select(F.lit("sqlite_vec").alias("src"), "*"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, d, "pgvector"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_vectors(table(spark, d, "pgvector"))


def _edited_copies(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "sqlite_vec"), threshold=0.6, shingle=3, least_words=20)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _edited_copies(spark, d)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.components(_edited_copies(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    scores = abuse.abuse_scores(table(spark, d, "documents"), table(spark, d, "labels"))
    return scores.where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, d, "documents"), table(spark, d, "labels"), calibrate=True)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_rates(abuse.abuse_scores(table(spark, d, "documents"), table(spark, d, "labels")))


QUERIES = [p1_found, p1_pieces, p2_found, p2_repaired, p3_found, p3_redacted, p4_found, p4_neighbours, p5_found, p5_groups, p6_ids, p7_found, p8_found, p8_scores, p8_rates]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: (lambda spark, d, q=q: q(ship(spark), d)) for q in QUERIES}


_WORDS = "regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"
_RUNS = "SELECT DISTINCT {key}, array_to_string(list_slice(t, i, i + {n} - 1), ' ') AS s FROM (SELECT {key}, t, unnest(generate_series(1, len(t) - {n} + 1)) AS i FROM {source} WHERE len(t) >= {least})"


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can state, over the whole tables."""
    return {
        "p1_found": """
            SELECT DISTINCT v.id FROM sqlite_vec v LEFT JOIN textsplitter_opts o ON o.dataset = v.collection_id
            WHERE length(v.content) > coalesce(o.chunk_size, 2048)""",
        "p4_found": """
            WITH u AS (SELECT collection_id AS c, uuid, CAST(embedding AS DOUBLE[]) AS e FROM pgvector WHERE len(embedding) > 0),
            v AS (SELECT * FROM u WHERE isfinite(list_sum(e)) AND list_sum(list_transform(e, lambda x: x * x)) > 0),
            p AS (SELECT a.uuid AS x, b.uuid AS y, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.c IS NOT DISTINCT FROM b.c AND len(a.e) = len(b.e) AND a.uuid <> b.uuid),
            r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS k FROM p)
            SELECT DISTINCT least(x, y) AS uuid_a, greatest(x, y) AS uuid_b FROM r WHERE k <= 5 AND s >= 0.90""",
        "p5_found": f"""
            WITH w AS (SELECT id, {_WORDS.format(text="content")} AS t FROM sqlite_vec WHERE content IS NOT NULL),
            s AS ({_RUNS.format(key="id", n=3, source="w", least=20)}), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
            p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
            SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k >= 0.6 * (x.n + y.n - k)""",
        "p7_found": f"""
            WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS t FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format(text="text")} AS t FROM benchmark WHERE text IS NOT NULL),
            ds AS ({_RUNS.format(key="doc_id", n=10, source="d", least=10)}), it AS ({_RUNS.format(key="item_id", n=10, source="i", least=10)})
            SELECT DISTINCT doc_id, item_id FROM ds JOIN it USING (s)""",
    }
