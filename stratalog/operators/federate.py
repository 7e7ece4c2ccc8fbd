"""Searching several shards: which to ask, how to merge, what the answer covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators.search import exact_groups, ranked

FUSION_K = 60
LISTED = 32


def select_shards(catalog: DataFrame, provider: str | None = None, session: str | None = None, from_time: float | None = None, to_time: float | None = None) -> DataFrame:
    """The shards that may hold answers, by id. Unknown bounds and unknown session lists exclude nothing."""
    out = catalog
    if provider is not None:
        out = out.where(F.col("provider") == provider)
    if session is not None:
        out = out.where(F.col("session_ids").isNull() | F.array_contains("session_ids", session))
    if from_time is not None:
        out = out.where(F.col("time_max").isNull() | (F.col("time_max") >= from_time))
    if to_time is not None:
        out = out.where(F.col("time_min").isNull() | (F.col("time_min") <= to_time))
    return out.orderBy("shard_id")


def listing(catalog: DataFrame, most: int = LISTED) -> DataFrame:
    """The first shards by id, and whether there are more."""
    total = catalog.count()
    return catalog.orderBy("shard_id").limit(most).select("shard_id", "provider", "time_min", "time_max").withColumn("truncated", F.lit(total > most))


def shard_hits(found: DataFrame, budget: int) -> DataFrame:
    """Each shard's own answer: its best ``budget`` matches with ``shard_rank``."""
    order = ["score", "session_id", "ordinal", "row_id"]
    place = F.row_number().over(Window.partitionBy("shard_id").orderBy(*order)).cast("bigint")
    return found.withColumn("shard_rank", place).where(F.col("shard_rank") <= budget)


def merged_order(rank: str = "shard_rank") -> list[Column]:
    return [F.desc(F.lit(1.0) / (FUSION_K + F.col(rank))), F.col("shard_id"), F.col("session_id"), F.col("ordinal"), F.col("row_id")]


def merge_flat(hits: DataFrame, limit: int) -> DataFrame:
    """All shards' hits in one order, by reciprocal rank and then by shard and place; ``result_rank``."""
    return ranked(hits.orderBy(*merged_order()).limit(limit), merged_order(), "result_rank")


def merge_groups(hits: DataFrame, limit: int) -> DataFrame:
    """Exact-text groups over all shards; a text found by several shards is one group with all occurrences."""
    rows = ranked(hits, merged_order(), "merged_rank")
    return exact_groups(rows, "merged_rank", limit, occurrence=("shard_id", "session_id", "ordinal", "message_id", "shard_rank"))


def merge_status(outcomes: DataFrame) -> DataFrame:
    """One row for shard outcomes (shard_id, ok, results): PARTIAL if a shard failed, else FOUND or NO_SIGNAL."""
    out = outcomes.agg(F.count("*").alias("selected"), F.count_if(F.col("ok")).alias("answered"), F.sum(F.when(F.col("ok"), F.col("results")).otherwise(0)).alias("results"))
    status = F.when(F.col("answered") < F.col("selected"), "PARTIAL").when(F.coalesce("results", F.lit(0)) > 0, "FOUND").otherwise("NO_SIGNAL")
    return out.select("selected", "answered", F.coalesce("results", F.lit(0)).cast("bigint").alias("results"), status.alias("status"))


def window_coverage(catalog: DataFrame, selected: DataFrame, to_time: float) -> DataFrame:
    """How much of a time window the selected shards cover: counts, whether all bounds are known, the latest time, the fit."""
    eligible = catalog.count()
    out = selected.agg(F.count("*").alias("selected"), F.coalesce(F.bool_and(F.col("time_min").isNotNull() & F.col("time_max").isNotNull()), F.lit(False)).alias("bounds_known"), F.max("time_max").alias("observed_to"))
    fit = F.when(F.col("selected") == 0, "NONE").when(~F.col("bounds_known"), "UNKNOWN").when(F.col("observed_to") >= to_time, "COVERED").otherwise("SHORT")
    return out.select(F.lit(eligible).cast("bigint").alias("eligible"), "selected", "bounds_known", "observed_to", fit.alias("fit"))


def source_currentness(catalog: DataFrame, now: float, most_age: float) -> DataFrame:
    """verified or stale only if all shards of a provider carry the same complete watermark; unknown otherwise."""
    mark = F.struct("observed_through", "watermark_status", "accepted_set_sha256")
    whole = F.col("observed_through").isNotNull() & F.col("accepted_set_sha256").isNotNull()
    out = catalog.groupBy("provider").agg(F.countDistinct(mark).alias("marks"), F.bool_and(whole).alias("whole"), F.max("observed_through").alias("observed_through"), F.max("watermark_status").alias("watermark_status"))
    state = F.when(~F.col("whole") | (F.col("marks") > 1), "unknown").when((F.col("watermark_status") == "verified") & (F.col("observed_through") >= now - most_age), "verified").otherwise("stale")
    return out.select("provider", state.alias("currentness"))


def overlay_watermarks(catalog: DataFrame, marks: DataFrame) -> DataFrame:
    """The catalog with the providers' watermarks; a mark for an unknown provider fails the job."""
    unknown = marks.join(catalog, "provider", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("a watermark names a provider that no shard has")
    return catalog.join(F.broadcast(marks), "provider", "left")  # a row a provider


def health(catalog: DataFrame) -> DataFrame:
    """Shards and ready shards; no state counts as ready."""
    return catalog.agg(F.count("*").alias("shards"), F.count_if(F.coalesce("state", F.lit("READY")) == "READY").alias("ready"))


def catalog_of(sessions: DataFrame, homes: DataFrame, keys: Sequence[str] = ("provider", "shard_id")) -> DataFrame:
    """A catalog row a shard: sessions and time bounds. ``homes`` gives each session's provider and shard."""
    own = sessions.join(homes, "session_id")
    return own.groupBy(*keys).agg(F.count("*").alias("session_count"), F.min("first_message_time").alias("time_min"), F.max("last_message_time").alias("time_max"))
