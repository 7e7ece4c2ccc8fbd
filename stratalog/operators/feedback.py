"""Feedback on searches: records, their references, patterns, replicas; and searches through controlled concepts."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.digest import canonical_json
from stratalog.operators.audit import conflicting, duplicates
from stratalog.shared import children, write_text, written
from stratalog.sources.strict_json import loads

OUTCOMES = ("improved", "same", "worse", "no_signal", "blocked")


def feedback_ref(record: dict[str, Any]) -> str:
    """The first 32 hexadecimal digits of a record's SHA-256, from its canonical JSON."""
    return hashlib.sha256(("feedback-v1\n" + canonical_json(record)).encode()).hexdigest()[:32]


def append_new(rows: DataFrame, store: str, key: str = "feedback_ref") -> DataFrame:
    """Adds the records that the store lacks; each key with RECORDED or UNCHANGED. The store is a folder of parquet parts.

    A batch's records and their status are written before its name is
    published, so readers of :func:`stored` see it wholly or not at all;
    nothing is collected.
    """
    spark = rows.sparkSession
    name = f"{len(_names(spark, store)):09d}"
    own, known = rows.dropDuplicates([key]), stored(spark, store)
    seen = own.select(key).where(F.lit(False)) if known is None else known.select(key)
    state = own.join(seen.withColumn("_k", F.lit(1)), key, "left").withColumn("status", F.when(F.col("_k").isNull(), "RECORDED").otherwise("UNCHANGED")).drop("_k")
    state = written(state, "feedback")
    state.where("status = 'RECORDED'").drop("status").write.mode("overwrite").parquet(f"{store}/part={name}")
    if not write_text(spark, f"{store}/_names/{name}.json", json.dumps({"key": key})):
        raise RuntimeError("another writer came first; try again")
    return state.select(key, "status")


def _names(spark: SparkSession, store: str) -> list[str]:
    return [n.removesuffix(".json") for n in children(spark, f"{store}/_names") if n.endswith(".json") and not n.startswith(".")]


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The records of a store of :func:`append_new`, None if it has none yet."""
    names = _names(spark, store)
    return spark.read.parquet(*[f"{store}/part={n}" for n in names]) if names else None


def read_feedback(spark: SparkSession, store: str, ref: str) -> dict[str, Any] | None:
    """The record of a reference, checked against it once more; None if the store hasn't it. The store has ``feedback_ref`` and ``payload``."""
    known = stored(spark, store)
    row = None if known is None else known.where(F.col("feedback_ref") == ref).select("payload").first()
    if row is None:
        return None
    body = loads(row["payload"])
    if feedback_ref(body) != ref:
        raise ValueError("the record isn't the one its reference names")
    return body


def patterns(episodes: DataFrame) -> DataFrame:
    """Per failure class, operator and version: episodes, eligible ones, and outcomes of the eligible ones."""
    ok = F.coalesce("aggregation_eligible", F.lit(False))
    counts = [F.count_if(ok & (F.col("outcome") == o)).alias(o) for o in OUTCOMES]
    return episodes.groupBy(F.concat_ws("::", "failure_class", "operator_name", "operator_version").alias("pattern")).agg(F.count("*").alias("observed"), F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("ineligible"), *counts)


def refreshed(seeds: DataFrame, live: DataFrame, key: str = "episode_id") -> DataFrame:
    """Seeds and live records in one table; an id that occurs twice fails the job."""
    out = seeds.unionByName(live)
    if not duplicates(out, [key]).isEmpty():
        raise ValueError(f"{key} occurs twice")
    return out.orderBy(key)


def reconcile(left: DataFrame, right: DataFrame, key: str = "feedback_ref", payload: str = "payload") -> DataFrame:
    """What each of two replicas lacks (``missing_in``); unequal payloads under one key fail the job."""
    if not conflicting(left, right, key, payload).isEmpty():
        raise ValueError("the replicas disagree on a record")
    a = left.select(key).distinct().join(right, key, "left_anti").withColumn("missing_in", F.lit("right"))
    return a.unionByName(right.select(key).distinct().join(left, key, "left_anti").withColumn("missing_in", F.lit("left")))


def normal_form(name):
    """A concept's form as it is compared: lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def matching_concepts(concepts: DataFrame, queries: DataFrame) -> DataFrame:
    """The concepts whose label or alias is the query. ``concepts``: concept_id, preferred_label, aliases; ``queries``: query."""
    forms = concepts.select("concept_id", F.explode(F.array_union(F.array("preferred_label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).select("concept_id", normal_form(F.col("form")).alias("form")).distinct()
    return queries.withColumn("form", normal_form(F.col("query"))).join(forms, "form").select("query", "concept_id").distinct()


def decision(concepts: int, direct: int, recall: int, alias: int) -> str:
    """What a reconciled search answers by its counts: several concepts are ambiguous; direct hits come before aliases, aliases before recall. The rows are :func:`stratalog.operators.reconcile.reconciled_search`'s."""
    if concepts > 1:
        return "AMBIGUOUS"
    if direct:
        return "DIRECT"
    if alias:
        return "ALIAS"
    return "RECALL" if recall else "UNKNOWN"
