"""Folding accepted artifacts into sessions, messages and their provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators.skew import numbered

# Content types that are never shown.
HIDDEN_TYPES = ("thoughts", "reasoning_recap", "model_editable_context")
COMPLETE, PARTIAL = "COMPLETE_EXPOSED_CONVERSATION", "PARTIAL_SESSION_SLICE"


def message_class(role: Column, content_type: Column) -> Column:
    """hidden, evidence, dialogue or trace, from the role and the type of the content."""
    return (
        F.when((role == "system") | content_type.isin(*HIDDEN_TYPES), "hidden")
        .when(role == "tool", "evidence")
        .when(role.isin("user", "assistant") & (content_type == "text"), "dialogue")
        .otherwise("trace")
    )


def identity(message_id: Column, artifact_sha: Column, sequence: Column, position: Column) -> Column:
    """The local identity: that of the message, or of its place where it has none."""
    return F.coalesce(F.concat(F.lit("id:"), message_id), F.concat_ws(":", F.lit("anon"), artifact_sha, sequence, position))


def merge_messages(rows: DataFrame) -> DataFrame:
    """Occurrences of a message merged: least time, greatest provider order, number of distinct digests (more than one is a conflict)."""
    return rows.groupBy("session_id", "local_identity").agg(F.min("create_time").alias("create_time"), F.max("provider_order").alias("provider_order"), F.countDistinct("canonical_message_sha256").alias("digests"), F.min("row_id").alias("row_id"), F.count("*").alias("occurrences"))


def conflicts(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("digests") > 1)


def assert_none(violations: DataFrame, what: str) -> None:
    """Fails the job, naming one row, if there are violations."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")


def ordinals(merged: DataFrame) -> DataFrame:
    """The 0-based place of each message in its session: provider order, then time, then identity; nulls last.

    A session of any size is spread over partitions.
    """
    order = [F.col("provider_order").asc_nulls_last(), F.col("create_time").asc_nulls_last(), F.col("local_identity")]
    return numbered(merged, ["session_id"], order, "ordinal")


def session_bounds(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages and time bounds of every session, with those that have no message."""
    per = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"))
    return sessions.select("session_id").join(per, "session_id", "left").select("session_id", F.coalesce("messages", F.lit(0)).cast("bigint").alias("messages"), "first_time", "last_time")


def chosen_titles(sessions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The title of the artifact with the latest observed time (none is last), then the least digest; '' without an artifact."""
    key = F.struct(F.col("observed_max_time").isNotNull().alias("known"), F.col("observed_max_time").alias("at"))
    best = artifacts.groupBy("session_id").agg(F.max(key).alias("_key"))
    tied = artifacts.join(best, "session_id").where(F.struct(F.col("observed_max_time").isNotNull().alias("known"), F.col("observed_max_time").alias("at")).eqNullSafe(F.col("_key")))
    title = tied.groupBy("session_id").agg(F.min(F.struct("sha256", "artifact_id", "observed_title")).alias("t"))
    return sessions.select("session_id").join(title, "session_id", "left").select("session_id", F.coalesce("t.observed_title", F.lit("")).alias("title"), F.col("t.artifact_id").alias("artifact_id"))


def provenance(messages: DataFrame, sources: DataFrame, pages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each message's paths to artifacts: row_id, page_id, page_position, artifact_id."""
    own = messages.select("row_id", "session_id").join(sources.withColumnRenamed("message_row_id", "row_id"), "row_id")
    return own.join(pages.select("page_id", "artifact_id"), "page_id").join(artifacts.select("artifact_id"), "artifact_id", "left_semi").select("row_id", "session_id", "page_id", "page_position", "artifact_id")


def complete_sessions(sessions: DataFrame, messages: DataFrame, paths: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Whether one complete artifact covers all of a session's messages. A session without messages is covered by any complete artifact."""
    total = messages.groupBy("session_id").agg(F.count("*").alias("total"))
    full = artifacts.where(F.col("coverage_state") == COMPLETE).select("artifact_id", F.col("session_id").alias("home"))
    covered = paths.join(full, "artifact_id").where(F.col("home") == F.col("session_id")).select("session_id", "artifact_id", "row_id").distinct().groupBy("session_id", "artifact_id").agg(F.count("*").alias("covered"))
    best = covered.groupBy("session_id").agg(F.max("covered").alias("covered"))
    some = full.select(F.col("home").alias("session_id")).distinct().withColumn("has_complete", F.lit(True))
    out = sessions.select("session_id").join(total, "session_id", "left").join(best, "session_id", "left").join(some, "session_id", "left")
    whole = F.coalesce("has_complete", F.lit(False)) & (F.coalesce("covered", F.lit(0)) == F.coalesce("total", F.lit(0)))
    return out.select("session_id", F.when(whole, COMPLETE).otherwise(PARTIAL).alias("coverage_state"))


def artifact_coverage(pages: DataFrame) -> DataFrame:
    """COMPLETE iff an artifact's oldest page says that none came before it. Pages go by least time (none last), then by sequence."""
    first = F.min(F.struct(F.col("min_create_time").isNull().alias("untimed"), F.col("min_create_time").alias("at"), F.col("capture_sequence").alias("sequence"), F.col("has_previous_page").alias("more"))).alias("p")
    return pages.groupBy("artifact_id").agg(first).select("artifact_id", F.when(~F.col("p.more"), COMPLETE).otherwise(PARTIAL).alias("coverage"))


def routed(artifacts: DataFrame, members: DataFrame, branches: DataFrame) -> DataFrame:
    """The branch of each artifact that is consistent with all its discriminating evidence.

    ``members``: artifact_id, item. ``branches``: branch_id, item. Items that
    all branches have tell nothing. An artifact that exactly one branch
    explains wholly is BRANCH_MATCH, any other UNRESOLVED.
    """
    n = branches.select("branch_id").distinct().count()
    telling = branches.groupBy("item").agg(F.countDistinct("branch_id").alias("b")).where(F.col("b") < n).select("item")
    own = members.distinct().join(telling, "item")
    total = own.groupBy("artifact_id").agg(F.count("*").alias("total"))
    met = own.join(branches.distinct(), "item").groupBy("artifact_id", "branch_id").agg(F.count("*").alias("met"))
    whole = met.join(total, "artifact_id").where(F.col("met") == F.col("total")).groupBy("artifact_id").agg(F.count("*").alias("n"), F.min("branch_id").alias("branch_id"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    return artifacts.select("artifact_id").join(whole, "artifact_id", "left").select("artifact_id", F.when(one, F.col("branch_id")).alias("branch_id"), F.when(one, "BRANCH_MATCH").otherwise("UNRESOLVED").alias("route_state"))


def families(routes: DataFrame) -> DataFrame:
    """Per accepted conversation: distinct projected sessions, whether its own session is among them, artifacts."""
    return routes.groupBy("accepted_session_id").agg(F.countDistinct("projected_session_id").alias("branches"), F.bool_or(F.col("projected_session_id") == F.col("accepted_session_id")).alias("has_base"), F.count("*").alias("artifacts"))


def provider_of_session(artifacts: DataFrame, providers: dict[str, str]) -> DataFrame:
    """The provider of each session by its artifacts' adapters: one known provider, or UNRESOLVED for none, or CONFLICT for several."""
    known = F.create_map(*[F.lit(x) for kv in providers.items() for x in kv])
    out = artifacts.groupBy("session_id").agg(F.countDistinct(F.try_element_at(known, F.col("source_adapter"))).alias("n"), F.min(F.try_element_at(known, F.col("source_adapter"))).alias("provider"))
    return out.select("session_id", F.when(F.col("n") == 1, F.col("provider")).when(F.col("n") == 0, "UNRESOLVED").otherwise("CONFLICT").alias("provider"))


def searchable_volume(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Searchable messages and their UTF-8 bytes in every session."""
    can = (F.col("search_class") != "hidden") & (F.col("text") != "")
    per = messages.groupBy("session_id").agg(F.count_if(can).alias("searchable_messages"), F.sum(F.when(can, F.octet_length("text")).otherwise(0)).cast("bigint").alias("searchable_bytes"))
    return sessions.select("session_id").join(per, "session_id", "left").na.fill(0)


def serving_messages(messages: DataFrame) -> DataFrame:
    """What a shard serves: searchable classes, with the message's id or else its identity; ``copies`` above 1 is a collision."""
    own = messages.where(F.col("search_class").isin("dialogue", "evidence", "trace") & (F.col("text") != "")).withColumn("serving_id", F.coalesce("message_id", "local_identity"))
    return own.groupBy("session_id", "serving_id").agg(F.count("*").alias("copies"), F.min("row_id").alias("row_id"))


def first_of(groups: list[DataFrame], key: list[str], limit: int) -> DataFrame:
    """Bounded result lists joined, each key kept where it comes first; needs a ``position`` in each."""
    tagged = [g.withColumn("_branch", F.lit(i)) for i, g in enumerate(groups)]
    every = reduce(DataFrame.unionByName, tagged)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_branch", "position"))
    out = every.withColumn("_k", place).where("_k = 1").drop("_k").orderBy("_branch", "position", *key).limit(limit)
    return out.withColumnRenamed("_branch", "branch")


def aliases(named: DataFrame, kind: str, canonical: str, alias: str) -> DataFrame:
    """A node a (kind, canonical) with its sorted distinct ``aliases``."""
    return named.groupBy(kind, canonical).agg(F.sort_array(F.collect_set(alias)).alias("aliases"))


def import_counters(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """Per artifact: its messages, and those by user, assistant and others, each message once."""
    own = paths.select("artifact_id", "row_id").distinct().join(messages.select("row_id", "role"), "row_id")
    role = F.lower(F.trim("role"))
    return own.groupBy("artifact_id").agg(F.count("*").alias("messages"), F.count_if(role == "user").alias("users"), F.count_if(role == "assistant").alias("assistants"), F.count_if(~F.coalesce(role.isin("user", "assistant"), F.lit(False))).alias("others"))


def session_order(ranked_rows: DataFrame, rank: str = "candidate_rank") -> DataFrame:
    """The sessions of a bounded ranked list by their first row: session_id, first_rank, session_place."""
    per = ranked_rows.groupBy("session_id").agg(F.min(rank).alias("first_rank"))
    return per.withColumn("session_place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first_rank")).cast("bigint"))


def with_group_size(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Rows with how many rows their group has."""
    return rows.withColumn(name, F.count("*").over(Window.partitionBy(by)))


# Shapes of identifiers.
SHAPES = {"hex32": r"\A[0-9a-f]{32}\z", "hex40": r"\A[0-9a-f]{40}\z", "hex64": r"\A[0-9a-f]{64}\z", "hex": r"\A[0-9a-f]+\z", "slug": r"\A[a-z0-9]+(-[a-z0-9]+)*\z", "id": r"\A[A-Za-z0-9._:-]{1,128}\z"}


def identity_shape(value: Column) -> Column:
    """The first shape an identifier has, ``none`` for none, null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, pattern in SHAPES.items():
        out = out.when(value.rlike(pattern), F.lit(name))
    return out.otherwise("none")


def promoted(messages: DataFrame) -> DataFrame:
    """Rows of one message with one content (message_id, digest) in several artifacts as one: a dialogue row with a text stands for them, else evidence, else what there is; then the lowest row_id. ``linked`` says how many there were."""
    rank = F.when((F.col("search_class") == "dialogue") & (F.col("text") != ""), 0).when(F.col("search_class") == "evidence", 1).otherwise(2)
    own = messages.where(F.col("message_id").isNotNull())
    best = F.min(F.struct(rank.alias("rank"), "row_id", "session_id", "search_class")).alias("b")
    return own.groupBy("message_id", "canonical_message_sha256").agg(best, F.count("*").alias("linked")).select("message_id", "canonical_message_sha256", "b.row_id", "b.session_id", "b.search_class", "linked")


def closure(routes: DataFrame, sessions: DataFrame) -> DataFrame:
    """``artifact_id`` of all artifacts that bear on some sessions: those routed to them and those of the same accepted conversations, whose branches decide together."""
    met = routes.join(sessions.select(F.col("session_id").alias("projected_session_id")).distinct(), "projected_session_id", "left_semi")
    return routes.join(met.select("accepted_session_id").distinct(), "accepted_session_id", "left_semi").select("artifact_id").distinct()
