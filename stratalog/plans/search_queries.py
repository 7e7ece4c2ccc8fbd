"""Queries on matching, ranking, grouping and merging, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.text import content_fp, jaccard, query_units, tokens
from stratalog.operators import federate as fed
from stratalog.operators import search as s
from stratalog.operators.index import index_of
from stratalog.operators.skew import lagged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

STRICT, RECALL, PHRASE = "wrong title shard", "probabilistic wrong-title zimewick", "evidentiary status of superseded captures"
TIME_FROM, TIME_TO = 1672700000.0, 1673000000.0
LONG_SESSION = "c71ef758-7ee4-4223-7a4471e27242"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def index(spark: SparkSession, folder: str):
    """The index of the messages; made at the first call and kept while the table doesn't change."""
    return index_of(spark, f"{folder}/messages.parquet")


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def scored_sql(text: str, mode: str, extra: str = "*") -> str:
    """CTEs up to ``scored``: the matches of a query with their score."""
    units = [tuple(u) for u in query_units(text)]
    if mode == "phrase":
        units = [tuple(w for u in units for w in u)]
    fs = []
    for i, u in enumerate(units):
        if len(u) == 1:
            fs.append(f"len([x FOR x IN w IF x = '{u[0]}']) AS f{i}")
        else:
            phrase = "[" + ", ".join(f"'{w}'" for w in u) + "]"
            fs.append(f"len([i FOR i IN range(1, greatest(len(w) - {len(u)} + 2, 1)) IF w[i:i + {len(u) - 1}] = {phrase}]) AS f{i}")
    n = range(len(units))
    sep = " OR " if mode == "recall" else " AND "
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in n)
    return f"""docs AS (SELECT *, {WORDS} AS w FROM messages WHERE search_class <> 'hidden' AND text <> ''),
        freq AS (SELECT *, len(w) AS dl, {", ".join(fs)} FROM docs),
        stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in n)} FROM freq),
        scored AS (SELECT freq.*, round(-({score}), 6) AS score FROM freq, stats WHERE {sep.join(f"f{i} > 0" for i in n)})"""


BY = "score, session_id, ordinal, row_id"
SCOPED = "search_class IN ('dialogue', 'evidence')"


def candidates_sql(text: str, mode: str, where: str, budget: int, cap: int | None = None) -> str:
    """CTEs up to ``candidates``."""
    capped = f"capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score, ordinal, row_id) AS place FROM scored WHERE {where}) WHERE place <= {cap})" if cap else f"capped AS (SELECT * FROM scored WHERE {where})"
    return f"""{scored_sql(text, mode)}, {capped},
        candidates AS (SELECT *, row_number() OVER (ORDER BY {BY}) AS candidate_rank FROM (SELECT * FROM capped ORDER BY {BY} LIMIT {budget}))"""


def rows(df: DataFrame, *more: str) -> DataFrame:
    return df.select("row_id", "session_id", *big("ordinal"), "score", *more)


HIT = "row_id, session_id, ordinal::BIGINT AS ordinal, score"


@query("bm25_scores", f"WITH {scored_sql(STRICT, 'recall')} SELECT {HIT} FROM scored")
def bm25_scores(spark, folder):
    return rows(s.scored(table(spark, folder, "messages"), STRICT, "recall"))


@query("strict_flat_search", f"WITH {candidates_sql(STRICT, 'strict', SCOPED, 30)} SELECT {HIT}, candidate_rank FROM candidates WHERE candidate_rank <= 10")
def strict_flat_search(spark, folder):
    return rows(index(spark, folder).flat(s.Request(STRICT)), "candidate_rank")


@query("recall_flat_search", f"WITH {candidates_sql(RECALL, 'recall', SCOPED, 60, 3)} SELECT {HIT}, candidate_rank FROM candidates WHERE candidate_rank <= 20")
def recall_flat_search(spark, folder):
    return rows(index(spark, folder).flat(s.Request(RECALL, "recall", limit=20)), "candidate_rank")


@query("phrase_search", f"WITH {scored_sql(PHRASE, 'phrase')} SELECT {HIT} FROM scored")
def phrase_search(spark, folder):
    return rows(index(spark, folder).scored(PHRASE, "phrase"))


@query("scope_filter_search", f"WITH {candidates_sql(STRICT, 'strict', "search_class IN ('evidence', 'trace')", 300)} SELECT {HIT}, candidate_rank FROM candidates")
def scope_filter_search(spark, folder):
    return rows(index(spark, folder).candidates(s.Request(STRICT, scopes=("evidence", "trace"), limit=100)), "candidate_rank")


@query("session_scoped_search", f"WITH {candidates_sql(RECALL, 'recall', f"{SCOPED} AND session_id = '{LONG_SESSION}'", 300, 100)} SELECT {HIT}, candidate_rank FROM candidates")
def session_scoped_search(spark, folder):
    return rows(index(spark, folder).candidates(s.Request(RECALL, "recall", session=LONG_SESSION, limit=100)), "candidate_rank")


@query("time_window_search", f"WITH {candidates_sql(STRICT, 'strict', f'{SCOPED} AND (create_time IS NULL OR create_time BETWEEN {TIME_FROM} AND {TIME_TO})', 300)} SELECT {HIT}, candidate_rank FROM candidates")
def time_window_search(spark, folder):
    return rows(index(spark, folder).candidates(s.Request(STRICT, from_time=TIME_FROM, to_time=TIME_TO, limit=100)), "candidate_rank")


@query("time_bounded_lookup", f"WITH {scored_sql(STRICT, 'strict')} SELECT {HIT} FROM scored WHERE create_time < {TIME_TO} ORDER BY {BY} LIMIT 50")
def time_bounded_lookup(spark, folder):
    return rows(index(spark, folder).before(STRICT, TIME_TO, 50))


def _any(words) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


@query("historical_marker_filter", f"SELECT row_id FROM messages WHERE {_any(s.DIRECT_MARKERS)} OR (contains(lower(text), '{s.FIND_WORD}') AND ({_any(s.HISTORY_MARKERS)}))")
def historical_marker_filter(spark, folder):
    return table(spark, folder, "messages").where(s.looks_back(F.col("text"))).select("row_id")


@query("term_document_frequency", f"""WITH docs AS (SELECT row_id, {WORDS} AS w FROM messages WHERE search_class <> 'hidden' AND text <> ''), t AS (SELECT DISTINCT row_id, unnest(w) AS term FROM docs)
    SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM docs) + 1.0) / (count(*) + 1.0)) + 1, 6) AS idf FROM t GROUP BY term""")
def term_document_frequency(spark, folder):
    return s.term_statistics(table(spark, folder, "messages"))


GROUPS = "SELECT row_number() OVER (ORDER BY min({rank})) AS group_rank, text, count(*) AS occurrence_count, min({rank}) AS first_rank, string_agg(row_id::VARCHAR, ',' ORDER BY {rank}) AS row_ids FROM {source} GROUP BY text"


def _groups(df: DataFrame, rank: str, limit: int) -> DataFrame:
    out = s.exact_groups(df, rank, limit, occurrence=("row_id",))
    return out.select("group_rank", "text", "occurrence_count", F.element_at("occurrences", 1)["rank"].alias("first_rank"), F.array_join(F.transform("occurrences", lambda o: o["row_id"].cast("string")), ",").alias("row_ids"))


@query("strict_grouped_search", f"WITH {candidates_sql('short note', 'strict', SCOPED, 300)} SELECT * FROM ({GROUPS.format(rank='candidate_rank', source='candidates')}) ORDER BY first_rank LIMIT 100")
def strict_grouped_search(spark, folder):
    r = s.Request("short note", limit=100)
    return _groups(index(spark, folder).candidates(r), "candidate_rank", 100)


@query("recall_grouped_search", f"WITH {candidates_sql(RECALL, 'recall', SCOPED, 60, 3)} SELECT * FROM ({GROUPS.format(rank='candidate_rank', source='candidates')}) ORDER BY first_rank LIMIT 20")
def recall_grouped_search(spark, folder):
    return _groups(index(spark, folder).candidates(s.Request(RECALL, "recall", limit=20)), "candidate_rank", 20)


@query("per_session_cap", f"WITH {scored_sql(RECALL, 'recall')} SELECT {HIT} FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score, ordinal, row_id) AS place FROM scored) WHERE place <= 3")
def per_session_cap(spark, folder):
    return rows(s.per_session(index(spark, folder).scored(RECALL, "recall"), 3))


RERANK = f"""{candidates_sql(STRICT, 'recall', SCOPED, 60, 3)},
    covered AS (SELECT *, [q FOR q IN ['wrong', 'title', 'shard'] IF list_contains(w, q)] AS c FROM candidates),
    per AS (SELECT session_id, len(list_distinct(flatten(list(c)))) AS cover, count(*) FILTER (WHERE search_class = 'dialogue') AS talk, min(score) AS best FROM covered GROUP BY session_id),
    sr AS (SELECT *, row_number() OVER (ORDER BY cover DESC, talk DESC, best, session_id) AS session_rank FROM per),
    rr AS (SELECT covered.*, session_rank, row_number() OVER (PARTITION BY session_id ORDER BY score, ordinal, row_id) AS row_index FROM covered JOIN sr USING (session_id))"""


@query("recall_rerank_interleave", f"WITH {RERANK} SELECT row_id, session_rank, row_index, row_number() OVER (ORDER BY row_index, session_rank) AS result_rank FROM rr ORDER BY row_index, session_rank LIMIT 20")
def recall_rerank_interleave(spark, folder):
    found = index(spark, folder).candidates(s.Request(STRICT, "recall", limit=20))
    return s.rerank(found, STRICT, 20).select("row_id", "session_rank", "row_index", "result_rank")


@query("exact_text_groups_documents", "SELECT md5(text) AS text_md5, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_text_groups_documents(spark, folder):
    return table(spark, folder, "documents").where("text is not null").groupBy("text").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1").select(F.md5("text").alias("text_md5"), "copies", "first_doc")


@query("candidate_projection", f"WITH {candidates_sql(STRICT, 'strict', SCOPED, 30)} SELECT session_id, coalesce(message_id, local_identity) AS message_id, ordinal::BIGINT AS ordinal, score AS backend_score, 'lower_better' AS backend_score_order FROM candidates")
def candidate_projection(spark, folder):
    found = index(spark, folder).candidates(s.Request(STRICT))
    return found.select("session_id", F.coalesce("message_id", "local_identity").alias("message_id"), *big("ordinal"), F.col("score").alias("backend_score"), F.lit("lower_better").alias("backend_score_order"))


@query("topk_diversity_before_after", f"""WITH {candidates_sql('short note', 'strict', SCOPED, 300)}, g AS (SELECT text, min(candidate_rank) AS first_rank FROM candidates GROUP BY text ORDER BY first_rank LIMIT 10)
    SELECT (SELECT count(DISTINCT text) FROM candidates WHERE candidate_rank <= 10) AS unique_before, (SELECT count(*) FROM g) AS unique_after, (SELECT count(*) FROM candidates) AS candidates""")
def topk_diversity_before_after(spark, folder):
    found = index(spark, folder).candidates(s.Request("short note", limit=100))
    per = found.groupBy("text").agg(F.min("candidate_rank").alias("r"), F.count("*").alias("n"))
    return per.agg(F.count_if(F.col("r") <= 10).alias("unique_before"), F.least(F.count("*"), F.lit(10)).alias("unique_after"), F.sum("n").alias("candidates"))


# shards: a session's provider is the adapter of its first artifact, its shard goes by the first character of its id
HOMES = """homes AS (SELECT session_id, coalesce(min_by(source_adapter, artifact_id), 'unknown') AS provider FROM (SELECT session_id FROM sessions) LEFT JOIN artifacts USING (session_id) GROUP BY session_id),
    placed AS (SELECT *, provider || CASE WHEN session_id < '8' THEN '-0001' ELSE '-0002' END AS shard_id FROM homes),
    catalog AS (SELECT provider, shard_id, count(*) AS session_count, min(first_message_time) AS time_min, max(last_message_time) AS time_max FROM sessions JOIN placed USING (session_id) GROUP BY provider, shard_id)"""


def homes(spark, folder) -> DataFrame:
    first = table(spark, folder, "artifacts").groupBy("session_id").agg(F.min_by("source_adapter", "artifact_id").alias("provider"))
    own = table(spark, folder, "sessions").select("session_id").join(first, "session_id", "left").withColumn("provider", F.coalesce("provider", F.lit("unknown")))
    return own.withColumn("shard_id", F.concat("provider", F.when(F.col("session_id") < "8", "-0001").otherwise("-0002")))


def catalog(spark, folder) -> DataFrame:
    return fed.catalog_of(table(spark, folder, "sessions"), homes(spark, folder))


@query("shard_catalog", f"WITH {HOMES} SELECT * FROM catalog")
def shard_catalog(spark, folder):
    return catalog(spark, folder)


@query("shard_pruning", f"WITH {HOMES} SELECT shard_id, provider FROM catalog WHERE provider = 'chatgpt-export' AND (time_max IS NULL OR time_max >= {TIME_FROM}) AND (time_min IS NULL OR time_min <= {TIME_TO})")
def shard_pruning(spark, folder):
    shards = catalog(spark, folder).withColumn("session_ids", F.lit(None).cast("array<string>"))
    return fed.select_shards(shards, "chatgpt-export", LONG_SESSION, TIME_FROM, TIME_TO).select("shard_id", "provider")


SHARD_HITS = f"""{HOMES}, {scored_sql('short note', 'strict')},
    hits AS (SELECT * FROM (SELECT scored.*, shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY {BY}) AS shard_rank FROM scored JOIN placed USING (session_id) WHERE {SCOPED}) WHERE shard_rank <= 30),
    merged AS (SELECT *, row_number() OVER (ORDER BY 1.0 / (60 + shard_rank) DESC, shard_id, session_id, ordinal, row_id) AS merged_rank FROM hits)"""


def _hits(spark, folder) -> DataFrame:
    found = s.in_scope(index(spark, folder).scored("short note"), s.Request("short note"))
    return fed.shard_hits(found.join(homes(spark, folder).select("session_id", "shard_id"), "session_id"), 30)


@query("federated_flat_merge", f"WITH {SHARD_HITS} SELECT row_id, shard_id, shard_rank, merged_rank AS result_rank FROM merged WHERE merged_rank <= 50")
def federated_flat_merge(spark, folder):
    return fed.merge_flat(_hits(spark, folder), 50).select("row_id", "shard_id", "shard_rank", "result_rank")


@query("federated_grouped_merge", f"""WITH {SHARD_HITS} SELECT row_number() OVER (ORDER BY min(merged_rank)) AS group_rank, text, count(*) AS occurrence_count, string_agg(shard_id || '#' || shard_rank, ',' ORDER BY merged_rank) AS places FROM merged GROUP BY text ORDER BY min(merged_rank) LIMIT 20""")
def federated_grouped_merge(spark, folder):
    most = 30 * catalog(spark, folder).count()  # each shard's answer is bounded
    out = fed.merge_groups(index(spark, folder).documents(_hits(spark, folder), most), 20)
    return out.select("group_rank", "text", "occurrence_count", F.array_join(F.transform("occurrences", lambda o: F.concat_ws("#", o["shard_id"], o["shard_rank"].cast("string"))), ",").alias("places"))


@query("federated_partial_status", f"""WITH {SHARD_HITS}, o AS (SELECT c.shard_id, c.provider <> 'unknown' AS ok, count(h.row_id) AS results FROM catalog c LEFT JOIN hits h ON c.shard_id = h.shard_id GROUP BY ALL)
    SELECT count(*) AS selected, count(*) FILTER (WHERE ok) AS answered, coalesce(sum(results) FILTER (WHERE ok), 0)::BIGINT AS results, CASE WHEN bool_and(ok) THEN CASE WHEN sum(results) > 0 THEN 'FOUND' ELSE 'NO_SIGNAL' END ELSE 'PARTIAL' END AS status FROM o""")
def federated_partial_status(spark, folder):
    per = _hits(spark, folder).groupBy("shard_id").agg(F.count("*").alias("results"))
    outcomes = catalog(spark, folder).select("shard_id", (F.col("provider") != "unknown").alias("ok")).join(per, "shard_id", "left").na.fill(0, ["results"])
    return fed.merge_status(outcomes)


@query("coverage_window_fit", f"""WITH {HOMES}, p AS (SELECT * FROM catalog WHERE time_max IS NULL OR time_max >= {TIME_FROM})
    SELECT (SELECT count(*) FROM catalog) AS eligible, count(*) AS selected, coalesce(bool_and(time_min IS NOT NULL AND time_max IS NOT NULL), false) AS bounds_known, max(time_max) AS observed_to,
    CASE WHEN count(*) = 0 THEN 'NONE' WHEN NOT bool_and(time_min IS NOT NULL AND time_max IS NOT NULL) THEN 'UNKNOWN' WHEN max(time_max) >= {TIME_TO} THEN 'COVERED' ELSE 'SHORT' END AS fit FROM p""")
def coverage_window_fit(spark, folder):
    own = catalog(spark, folder)
    return fed.window_coverage(own, fed.select_shards(own, from_time=TIME_FROM), TIME_TO)


@query("source_currentness", f"""WITH {HOMES}, marks AS (SELECT *, CASE WHEN provider = 'deepseek-export' THEN time_max ELSE {TIME_TO} END AS seen, CASE WHEN provider <> 'unknown' THEN md5(provider) END AS sha FROM catalog)
    SELECT provider, CASE WHEN NOT bool_and(seen IS NOT NULL AND sha IS NOT NULL) OR count(DISTINCT (seen, sha)) > 1 THEN 'unknown' WHEN max(seen) >= {TIME_FROM} THEN 'verified' ELSE 'stale' END AS currentness FROM marks GROUP BY provider""")
def source_currentness(spark, folder):
    seen = F.when(F.col("provider") == "deepseek-export", F.col("time_max")).otherwise(TIME_TO)
    sha = F.when(F.col("provider") != "unknown", F.md5("provider"))
    own = catalog(spark, folder).select("provider", seen.alias("observed_through"), F.lit("verified").alias("watermark_status"), sha.alias("accepted_set_sha256"))
    return fed.source_currentness(own, TIME_TO, TIME_TO - TIME_FROM)


@query("shard_health", f"WITH {HOMES} SELECT count(*) AS shards, count(*) FILTER (WHERE provider <> 'unknown') AS ready FROM catalog")
def shard_health(spark, folder):
    return fed.health(catalog(spark, folder).withColumn("state", F.when(F.col("provider") == "unknown", "BUILDING")))


@query("auto_mode_search", f"WITH {candidates_sql(RECALL, 'recall', SCOPED, 60, 3)} SELECT group_rank, text, occurrence_count FROM ({GROUPS.format(rank='candidate_rank', source='candidates')}) ORDER BY first_rank LIMIT 20")
def auto_mode_search(spark, folder):
    return index(spark, folder).search(s.Request(RECALL, "auto", limit=20)).groups.select("group_rank", "text", "occurrence_count")


@query("content_fingerprint_dups", r"SELECT md5(trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g'))) AS fp, count(*) AS copies FROM messages WHERE text IS NOT NULL GROUP BY fp HAVING count(*) > 1")
def content_fingerprint_dups(spark, folder):
    return table(spark, folder, "messages").where("text is not null").groupBy(content_fp(F.col("text")).alias("fp")).agg(F.count("*").alias("copies")).where("copies > 1")


@query("token_jaccard_neighbours", f"""WITH t AS (SELECT session_id, ordinal, row_id, list_distinct({WORDS}) AS w, lag(list_distinct({WORDS})) OVER (PARTITION BY session_id ORDER BY ordinal, row_id) AS p FROM messages WHERE search_class = 'dialogue')
    SELECT row_id, round(CASE WHEN len(w) + len(p) = 0 THEN 1.0 ELSE len(list_intersect(w, p))::DOUBLE / len(list_distinct(list_concat(w, p))) END, 6) AS overlap FROM t WHERE p IS NOT NULL""")
def token_jaccard_neighbours(spark, folder):
    own = table(spark, folder, "messages").where("search_class = 'dialogue'").select("session_id", "ordinal", "row_id", F.array_distinct(tokens(F.col("text"))).alias("w"))
    own = lagged(own, ["session_id"], [F.col("ordinal"), F.col("row_id")], ["w"], "p").where("p is not null")
    return own.select("row_id", F.round(jaccard(F.col("w"), F.col("p.w")), 6).alias("overlap"))
