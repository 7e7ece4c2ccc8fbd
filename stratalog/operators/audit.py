"""Comparisons of sets and tables, and integrity checks as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.digest import set_digest


def overlap(authority: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """One row: counts of the two key sets, of common and one-sided keys, and EMPTY, DISJOINT, FULL or PARTIAL for the candidate."""
    a = authority.select(key).distinct().withColumn("_a", F.lit(1))
    b = candidate.select(key).distinct().withColumn("_b", F.lit(1))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = a.join(b, key, "full").agg(F.count("_a").alias("authority"), F.count("_b").alias("candidate"), F.count_if(both).alias("common"), F.count_if(F.col("_b").isNull()).alias("only_authority"), F.count_if(F.col("_a").isNull()).alias("only_candidate"))
    return out.withColumn("state", F.when(F.col("candidate") == 0, "EMPTY").when(F.col("common") == 0, "DISJOINT").when(F.col("common") == F.col("candidate"), "FULL").otherwise("PARTIAL"))


def overlap_by(authority: DataFrame, candidate: DataFrame, key: str, group: str) -> DataFrame:
    """:func:`overlap` of the candidate's keys for each of its groups."""
    known = authority.select(key).distinct().withColumn("_a", F.lit(1))
    own = candidate.select(group, key).distinct().join(known, key, "left")
    out = own.groupBy(group).agg(F.count("*").alias("candidate"), F.count("_a").alias("common"))
    return out.withColumn("state", F.when(F.col("common") == 0, "DISJOINT").when(F.col("common") == F.col("candidate"), "FULL").otherwise("PARTIAL"))


def digests_by(df: DataFrame, key: str, group: str) -> DataFrame:
    """An order-independent digest of each group's keys. For groups whose keys fit a task, such as shards and days."""
    return df.groupBy(group).agg(F.countDistinct(key).alias("keys"), set_digest(F.col(key)).alias("digest"))


def membership_gap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has, with the ``side`` they are on."""
    one = left.select(key).distinct().join(right, key, "left_anti").withColumn("side", F.lit("left"))
    return one.unionByName(right.select(key).distinct().join(left, key, "left_anti").withColumn("side", F.lit("right")))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose reference doesn't resolve."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def misplaced_pages(pages: DataFrame, routes: DataFrame) -> DataFrame:
    """Pages whose session isn't the one their artifact was routed to."""
    own = pages.select("page_id", "artifact_id", "session_id").join(routes.select("artifact_id", "projected_session_id"), "artifact_id")
    return own.where(F.col("session_id") != F.col("projected_session_id")).select("page_id", "artifact_id").distinct()


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with multiplicity that only one of two tables of the same columns has."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def conflicting(left: DataFrame, right: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys of both tables with unequal payloads; null equals null."""
    a, b = left.select(key, F.col(payload).alias("_l")), right.select(key, F.col(payload).alias("_r"))
    return a.join(b, key).where(~F.col("_l").eqNullSafe(F.col("_r"))).select(key).distinct()


def split_pending(inbox: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Each inbox key with ``pending`` or ``accepted``."""
    done = accepted.select(key).distinct().withColumn("_done", F.lit(1))
    return inbox.select(key).distinct().join(done, key, "left").select(key, F.when(F.col("_done").isNull(), "pending").otherwise("accepted").alias("state"))


def page_lists(pages: DataFrame) -> DataFrame:
    """Per artifact: its pages in order of capture as text, and those that say another follows (null if none does)."""
    in_order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("capture_sequence", "page_id"))), lambda p: p["page_id"].cast("string")), ",")
    more = F.sort_array(F.collect_list(F.when(F.col("has_next_page"), F.col("page_id"))))
    return pages.groupBy("artifact_id").agg(in_order.alias("pages"), F.when(F.count_if("has_next_page") > 0, more).alias("continued"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row a table with its number of rows."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, df in tables.items()])


def verify(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """A row a check: its name, how many rows violate it, and whether it holds. The first that fails is the reason."""
    rows = [df.agg(F.lit(i).alias("step"), F.lit(name).alias("check_name"), F.count("*").alias("violations")) for i, (name, df) in enumerate(checks)]
    return reduce(DataFrame.unionByName, rows).withColumn("holds", F.col("violations") == 0)


def projection_checks(t: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
    """The checks of a whole projection, in the order in which they count."""
    m, a = t["messages"], t["artifacts"]
    return [
        ("routes have artifacts", orphans(t["artifact_routes"], a, "artifact_id", "artifact_id")),
        ("artifacts have routes", orphans(a, t["artifact_routes"], "artifact_id", "artifact_id")),
        ("pages have artifacts", orphans(t["payload_pages"], a, "artifact_id", "artifact_id")),
        ("pages are where their artifact is", misplaced_pages(t["payload_pages"], t["artifact_routes"])),
        ("sources have messages", orphans(t["message_sources"], m, "message_row_id", "row_id")),
        ("sources have pages", orphans(t["message_sources"], t["payload_pages"], "page_id", "page_id")),
        ("messages have sessions", orphans(m, t["sessions"], "session_id", "session_id")),
        ("identities are unique", duplicates(m, ["session_id", "local_identity"])),
        ("ordinals are unique", duplicates(m, ["session_id", "ordinal"])),
        ("digests are unique", duplicates(a, ["sha256"])),
    ]
