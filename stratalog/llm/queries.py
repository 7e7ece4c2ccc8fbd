"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import canonical, containers, conversations, history, languages, leaks, reading, topn

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = _read(spark, folder, "message_langs")
    detected = languages.detect(_read(spark, folder, "messages").where("search_class = 'dialogue'"), labels)
    return languages.mislabelled(detected, labels)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.rebuild(_read(spark, folder, "messages"), _read(spark, folder, "sessions")).dropped()


def p3_conversations(spark: SparkSession, folder: str) -> DataFrame:
    # the other two give no parents, and no far parent changes their rows
    return conversations.rebuild(_read(spark, folder, "messages"), _read(spark, folder, "sessions"), whole=True).conversations()


def p3_turns(spark: SparkSession, folder: str) -> DataFrame:
    made = conversations.rebuild(_read(spark, folder, "messages"), _read(spark, folder, "sessions")).conversations()
    return made.select("session_id", "turn", "row_id", "speaker")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return topn.best_messages(_read(spark, folder, "messages"), _read(spark, folder, "hit_scores")).select("row_id")


def p4_best(spark: SparkSession, folder: str) -> DataFrame:
    best = topn.best_messages(_read(spark, folder, "messages"), _read(spark, folder, "hit_scores"))
    return best.select("session_id", "search_class", "row_id", "score", "place")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.repeats(*[_read(spark, folder, t) for t in ("artifacts", "payload_pages", "message_sources")])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = canonical.odd_records(_read(spark, folder, "messages"), "messages", "row_id", "text")
    return rows.unionByName(canonical.odd_records(_read(spark, folder, "sessions"), "sessions", "session_id", "title")).select("table_name", "record_key")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return containers.longer_than_one(containers.pack(_read(spark, folder, "documents")))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    packed = containers.pack(_read(spark, folder, "documents"))
    return packed.groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every packing: all items once and whole, none too full, little space unused."""
    packed = containers.pack(_read(spark, folder, "documents"))
    per = packed.groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    full = per.agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > containers.CAPACITY).alias("too_full"), F.count("*").alias("n"))
    return full.select("items", "tokens", "too_full", (F.col("n") <= F.ceil(F.col("tokens") / containers.CAPACITY) * 1.05 + 1).alias("well_filled"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(_read(spark, folder, "documents"), _read(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p8_edited(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.edited(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents").where("kind is null or kind <> 'capture_log'")
    return reading.levels(documents, _read(spark, folder, "reading_labels")).select("doc_id", "level")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p3_found, p3_conversations, p3_turns, p4_found, p4_best, p5_found, p6_found, p7_found, p7_containers, p7_invariants, p8_found, p8_edited, p9_found)}

_TURNS = r"""
        WITH m AS (SELECT *, row_number() OVER (PARTITION BY session_id, coalesce(local_identity, 'row:' || row_id) ORDER BY row_id) AS k FROM messages),
        d AS (SELECT *, CASE WHEN lower(trim(role)) IN ('user', 'human', 'customer', 'prompter') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot', 'model', 'chatbot') THEN 'assistant' END AS speaker FROM m WHERE k = 1),
        t AS (SELECT session_id, row_id, speaker, row_number() OVER (PARTITION BY session_id ORDER BY ordinal, row_id) - 1 AS turn, lead(speaker) OVER (PARTITION BY session_id ORDER BY ordinal, row_id) AS following FROM d WHERE speaker IS NOT NULL AND search_class = 'dialogue' AND regexp_matches(text, '[\p{L}\p{N}\p{P}\p{S}]')),
        f AS (SELECT session_id, count(*) AS n, count(DISTINCT ordinal) AS u, min(ordinal) AS lo, max(ordinal) AS hi FROM d GROUP BY session_id),
        g AS (SELECT session_id, bool_or(speaker = 'user' AND coalesce(following, 'user') = 'user') AS open FROM t GROUP BY session_id),
        r AS (SELECT session_id, CASE WHEN open IS NULL THEN 'empty' WHEN NOT (n = u AND lo = 0 AND hi = n - 1) THEN 'broken' WHEN open THEN 'no_reply' END AS reason FROM sessions LEFT JOIN f USING (session_id) LEFT JOIN g USING (session_id))"""
_BEST = """
        WITH m AS (SELECT *, row_number() OVER (PARTITION BY session_id, coalesce(local_identity, 'row:' || row_id) ORDER BY row_id) AS k FROM messages),
        s AS (SELECT row_id, score, row_number() OVER (PARTITION BY row_id ORDER BY scored_at DESC NULLS LAST, score DESC NULLS LAST) AS k FROM hit_scores),
        r AS (SELECT m.row_id, session_id, search_class, score, row_number() OVER (PARTITION BY session_id, search_class ORDER BY score DESC, ordinal, m.row_id) AS place
              FROM m JOIN s USING (row_id) WHERE m.k = 1 AND s.k = 1 AND score IS NOT NULL AND NOT isnan(score) AND search_class IN ('dialogue', 'evidence'))"""

ORACLE: dict[str, str] = {
    "p3_found": f"{_TURNS} SELECT session_id, reason FROM r WHERE reason IS NOT NULL",
    "p3_turns": f"{_TURNS} SELECT session_id, turn, row_id, speaker FROM t WHERE session_id IN (SELECT session_id FROM r WHERE reason IS NULL)",
    "p4_found": f"{_BEST} SELECT row_id FROM r WHERE place <= 3",
    "p4_best": f"{_BEST} SELECT session_id, search_class, row_id, score, place FROM r WHERE place <= 3",
    "p5_found": r"""
        WITH s AS (SELECT DISTINCT artifact_id, source_object_sha256 AS o FROM payload_pages JOIN message_sources USING (page_id)),
        n AS (SELECT artifact_id, count(*) AS n FROM s GROUP BY artifact_id),
        c AS (SELECT x.artifact_id AS a, y.artifact_id AS b, count(*) AS k FROM s x JOIN s y ON x.o = y.o AND x.artifact_id < y.artifact_id GROUP BY x.artifact_id, y.artifact_id),
        d AS (SELECT artifact_id, regexp_replace(lower(sha256), '^\s*(sha-?256\s*[:=]?\s*)?|\s+$', '', 'g') AS digest FROM artifacts)
        SELECT a AS first_artifact_id, b AS second_artifact_id FROM c JOIN n na ON na.artifact_id = a JOIN n nb ON nb.artifact_id = b WHERE k >= 0.8 * (na.n + nb.n - k)
        UNION SELECT x.artifact_id, y.artifact_id FROM d x JOIN d y ON x.digest = y.digest AND x.artifact_id < y.artifact_id""",
    "p7_invariants": """
        WITH d AS (SELECT coalesce(strlen(text), 0) + 1 AS size FROM documents)
        SELECT sum(ceil(size / 8192.0))::BIGINT AS items, sum(size)::BIGINT AS tokens, 0::BIGINT AS too_full, true AS well_filled FROM d""",
    "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) + 1 > 8192",
}
