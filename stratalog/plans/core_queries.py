"""Queries of the skew operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.operators.quantiles import heavy_keys, keyed_quantiles

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    messages = spark.read.parquet(f"{folder}/messages.parquet")
    return heavy_keys(messages, "session_id", 0.05).select("session_id")


def p2_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    messages = spark.read.parquet(f"{folder}/messages.parquet")
    return keyed_quantiles(messages, "session_id", "create_time", (0.1, 0.5, 0.9))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_quantiles)}

ORACLE: dict[str, str] = {
    "p2_found": "SELECT session_id FROM messages WHERE session_id IS NOT NULL GROUP BY session_id HAVING count(*) >= 0.05 * (SELECT count(*) FROM messages)",
    "p2_quantiles": """
        WITH v AS (SELECT session_id, create_time AS v, row_number() OVER (PARTITION BY session_id ORDER BY create_time) AS k, count(*) OVER (PARTITION BY session_id) AS n FROM messages WHERE create_time IS NOT NULL),
        q AS (SELECT session_id, min(v) FILTER (WHERE k = greatest(1, ceil(0.1 * n))) AS q10, min(v) FILTER (WHERE k = greatest(1, ceil(0.5 * n))) AS q50, min(v) FILTER (WHERE k = greatest(1, ceil(0.9 * n))) AS q90 FROM v GROUP BY session_id)
        SELECT m.session_id, count(*) AS n_rows, count(create_time) AS n_values, any_value(q10) AS q10, any_value(q50) AS q50, any_value(q90) AS q90 FROM messages m LEFT JOIN q USING (session_id) GROUP BY m.session_id""",
}
