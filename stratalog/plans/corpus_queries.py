"""Queries on the projection, its audits, evaluation, browsing, trees and telemetry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions.digest import set_digest
from stratalog.functions.text import WORD, folded_tokens, iso_epoch, tokens, utc_day
from stratalog.operators import allocate, audit, browse, corpus, evaluate, feedback, trees
from stratalog.operators import search as s
from stratalog.operators.index import index_of
from stratalog.operators.skew import numbered
from stratalog.plans.search_queries import HOMES, LONG_SESSION, RECALL, SCOPED, STRICT, WORDS, big, candidates_sql, index, scored_sql, table
from stratalog.plans.search_queries import homes as _homes
from stratalog.streaming import telemetry

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- projection

ROLE = "CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant' WHEN lower(trim(role)) IN ('system', 'developer') THEN 'system' WHEN lower(trim(role)) IN ('tool', 'function') THEN 'tool' ELSE 'unknown' END"


def _role():
    r = F.lower(F.trim("role"))
    return F.when(r.isin("user", "human"), "user").when(r.isin("assistant", "ai", "bot", "model"), "assistant").when(r.isin("system", "developer"), "system").when(r.isin("tool", "function"), "tool").otherwise("unknown")


@query("message_class", f"""SELECT row_id, CASE WHEN r = 'system' OR content_type IN ('thoughts', 'reasoning_recap', 'model_editable_context') THEN 'hidden' WHEN r = 'tool' THEN 'evidence' WHEN r IN ('user', 'assistant') AND content_type = 'text' THEN 'dialogue' ELSE 'trace' END AS class FROM (SELECT *, {ROLE} AS r FROM messages)""")
def message_class(spark, folder):
    return table(spark, folder, "messages").select("row_id", corpus.message_class(_role(), F.col("content_type")).alias("class"))


MERGED = "merged AS (SELECT session_id, local_identity, min(create_time) AS create_time, max(provider_order) AS provider_order, count(DISTINCT canonical_message_sha256) AS digests, min(row_id) AS row_id, count(*) AS occurrences FROM messages GROUP BY session_id, local_identity)"


@query("message_merge", f"WITH {MERGED} SELECT * FROM merged")
def message_merge(spark, folder):
    return corpus.merge_messages(table(spark, folder, "messages"))


@query("message_conflicts", f"WITH {MERGED} SELECT session_id, local_identity, digests FROM merged WHERE digests > 1")
def message_conflicts(spark, folder):
    return corpus.conflicts(corpus.merge_messages(table(spark, folder, "messages"))).select("session_id", "local_identity", "digests")


@query("message_ordinals", f"WITH {MERGED} SELECT row_id, row_number() OVER (PARTITION BY session_id ORDER BY provider_order NULLS LAST, create_time NULLS LAST, local_identity) - 1 AS ordinal FROM merged")
def message_ordinals(spark, folder):
    return corpus.ordinals(corpus.merge_messages(table(spark, folder, "messages"))).select("row_id", "ordinal")


@query("session_bounds", "SELECT s.session_id, count(row_id) AS messages, min(create_time) AS first_time, max(create_time) AS last_time FROM sessions s LEFT JOIN messages m ON m.session_id = s.session_id GROUP BY s.session_id")
def session_bounds(spark, folder):
    return corpus.session_bounds(table(spark, folder, "sessions"), table(spark, folder, "messages"))


@query("session_title_choice", """WITH r AS (SELECT session_id, observed_title, artifact_id, row_number() OVER (PARTITION BY session_id ORDER BY observed_max_time DESC NULLS LAST, sha256, artifact_id) AS k FROM artifacts)
    SELECT s.session_id, coalesce(observed_title, '') AS title, artifact_id FROM sessions s LEFT JOIN r ON r.session_id = s.session_id AND k = 1""")
def session_title_choice(spark, folder):
    return corpus.chosen_titles(table(spark, folder, "sessions"), table(spark, folder, "artifacts"))


PATHS = "paths AS (SELECT m.row_id, m.session_id, p.page_id, x.page_position, a.artifact_id FROM messages m JOIN message_sources x ON x.message_row_id = m.row_id JOIN payload_pages p ON p.page_id = x.page_id JOIN artifacts a ON a.artifact_id = p.artifact_id)"


def _paths(spark, folder):
    return corpus.provenance(*[table(spark, folder, t) for t in ("messages", "message_sources", "payload_pages", "artifacts")])


@query("provenance_paths", f"WITH {PATHS} SELECT row_id, session_id, page_id, page_position::BIGINT AS page_position, artifact_id FROM paths")
def provenance_paths(spark, folder):
    return _paths(spark, folder).select("row_id", "session_id", "page_id", *big("page_position"), "artifact_id")


@query("session_complete_coverage", f"""WITH {PATHS}, t AS (SELECT session_id, count(*) AS total FROM messages GROUP BY session_id),
    f AS (SELECT artifact_id, session_id FROM artifacts WHERE coverage_state = '{corpus.COMPLETE}'),
    c AS (SELECT session_id, max(n) AS covered FROM (SELECT p.session_id, p.artifact_id, count(DISTINCT row_id) AS n FROM paths p JOIN f ON f.artifact_id = p.artifact_id AND f.session_id = p.session_id GROUP BY ALL) GROUP BY session_id)
    SELECT s.session_id, CASE WHEN s.session_id IN (SELECT session_id FROM f) AND coalesce(covered, 0) = coalesce(total, 0) THEN '{corpus.COMPLETE}' ELSE '{corpus.PARTIAL}' END AS coverage_state
    FROM sessions s LEFT JOIN t ON t.session_id = s.session_id LEFT JOIN c ON c.session_id = s.session_id""")
def session_complete_coverage(spark, folder):
    return corpus.complete_sessions(table(spark, folder, "sessions"), table(spark, folder, "messages"), _paths(spark, folder), table(spark, folder, "artifacts"))


@query("artifact_coverage", f"""SELECT artifact_id, CASE WHEN NOT has_previous_page THEN '{corpus.COMPLETE}' ELSE '{corpus.PARTIAL}' END AS coverage FROM (
    SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY min_create_time IS NULL, min_create_time, capture_sequence, has_previous_page) AS k FROM payload_pages) WHERE k = 1""")
def artifact_coverage(spark, folder):
    return corpus.artifact_coverage(table(spark, folder, "payload_pages"))


@query("artifact_dedupe", r"SELECT regexp_replace(lower(trim(sha256, E' \n\t')), '^sha256:', '') AS digest, min(artifact_id) AS artifact_id, count(*) AS copies FROM artifacts GROUP BY digest")
def artifact_dedupe(spark, folder):
    digest = F.regexp_replace(F.lower(F.regexp_replace("sha256", r"^\s+|\s+$", "")), "^sha256:", "")
    return table(spark, folder, "artifacts").groupBy(digest.alias("digest")).agg(F.min("artifact_id").alias("artifact_id"), F.count("*").alias("copies"))


@query("family_completeness", "SELECT accepted_session_id, count(DISTINCT projected_session_id) AS branches, bool_or(projected_session_id = accepted_session_id) AS has_base, count(*) AS artifacts FROM artifact_routes GROUP BY accepted_session_id")
def family_completeness(spark, folder):
    return corpus.families(table(spark, folder, "artifact_routes"))


@query("branch_routing", """WITH b AS (SELECT DISTINCT r.projected_session_id AS branch_id, x.source_object_sha256 AS item, r.accepted_session_id AS family FROM artifact_routes r JOIN payload_pages p USING (artifact_id) JOIN message_sources x USING (page_id) WHERE route_state <> 'UNRESOLVED' AND r.accepted_session_id IN (SELECT accepted_session_id FROM artifact_routes WHERE route_state = 'BRANCH_MATCH')),
    bb AS (SELECT DISTINCT branch_id, item FROM b), n AS (SELECT count(DISTINCT branch_id) AS n FROM bb), t AS (SELECT item FROM bb GROUP BY item HAVING count(DISTINCT branch_id) < (SELECT n FROM n)),
    m AS (SELECT DISTINCT artifact_id, source_object_sha256 AS item FROM payload_pages JOIN message_sources USING (page_id)), o AS (SELECT * FROM m WHERE item IN (SELECT item FROM t)),
    total AS (SELECT artifact_id, count(*) AS total FROM o GROUP BY artifact_id), met AS (SELECT artifact_id, branch_id, count(*) AS met FROM o JOIN bb USING (item) GROUP BY ALL),
    w AS (SELECT artifact_id, count(*) AS n, min(branch_id) AS branch_id FROM met JOIN total USING (artifact_id) WHERE met = total GROUP BY artifact_id)
    SELECT a.artifact_id, CASE WHEN w.n = 1 THEN w.branch_id END AS branch_id, CASE WHEN w.n = 1 THEN 'BRANCH_MATCH' ELSE 'UNRESOLVED' END AS route_state FROM artifacts a LEFT JOIN w USING (artifact_id)""")
def branch_routing(spark, folder):
    routes, pages, sources = (table(spark, folder, t) for t in ("artifact_routes", "payload_pages", "message_sources"))
    members = pages.select("page_id", "artifact_id").join(sources.select("page_id", F.col("source_object_sha256").alias("item")), "page_id").select("artifact_id", "item").distinct()
    split = routes.where("route_state = 'BRANCH_MATCH'").select("accepted_session_id").distinct()
    homes = routes.where("route_state <> 'UNRESOLVED'").join(split, "accepted_session_id", "left_semi").select("artifact_id", F.col("projected_session_id").alias("branch_id"))
    branches = members.join(homes, "artifact_id").select("branch_id", "item").distinct()
    return corpus.routed(table(spark, folder, "artifacts"), members, branches)


PROVIDERS = {"chatgpt-export": "chatgpt", "deepseek-export": "deepseek", "xai-export": "xai", "speed-booster-export": "chatgpt"}


@query("session_provider", f"""WITH p AS (SELECT session_id, CASE source_adapter {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROVIDERS.items())} END AS provider FROM artifacts)
    SELECT session_id, CASE count(DISTINCT provider) WHEN 1 THEN min(provider) WHEN 0 THEN 'UNRESOLVED' ELSE 'CONFLICT' END AS provider FROM p GROUP BY session_id""")
def session_provider(spark, folder):
    return corpus.provider_of_session(table(spark, folder, "artifacts"), PROVIDERS)


VOLUME = "volume AS (SELECT s.session_id, count(*) FILTER (WHERE search_class <> 'hidden' AND text <> '') AS searchable_messages, coalesce(sum(strlen(text)) FILTER (WHERE search_class <> 'hidden' AND text <> ''), 0)::BIGINT AS searchable_bytes FROM sessions s LEFT JOIN messages m ON m.session_id = s.session_id GROUP BY s.session_id)"


def _volume(spark, folder):
    return corpus.searchable_volume(table(spark, folder, "sessions"), table(spark, folder, "messages"))


@query("searchable_volume", f"WITH {VOLUME} SELECT * FROM volume")
def searchable_volume(spark, folder):
    return _volume(spark, folder)


@query("serving_id_collisions", "SELECT session_id, coalesce(message_id, local_identity) AS serving_id, count(*) AS copies, min(row_id) AS row_id FROM messages WHERE search_class IN ('dialogue', 'evidence', 'trace') AND text <> '' GROUP BY ALL HAVING count(*) > 1")
def serving_id_collisions(spark, folder):
    return corpus.serving_messages(table(spark, folder, "messages")).where("copies > 1")


@query("provenance_resolvable", f"WITH {candidates_sql(STRICT, 'strict', SCOPED, 300)}, {PATHS} SELECT row_id, row_id IN (SELECT row_id FROM paths) AS resolvable FROM candidates")
def provenance_resolvable(spark, folder):
    found = index(spark, folder).candidates(s.Request(STRICT, limit=100)).select("row_id")
    known = _paths(spark, folder).select("row_id").distinct().withColumn("k", F.lit(True))
    return found.join(known, "row_id", "left").select("row_id", F.coalesce("k", F.lit(False)).alias("resolvable"))


@query("accepted_epochs", "SELECT artifact_id, epoch(accepted_at::TIMESTAMPTZ) AS accepted_epoch FROM artifacts")
def accepted_epochs(spark, folder):
    return table(spark, folder, "artifacts").select("artifact_id", iso_epoch(F.col("accepted_at")).alias("accepted_epoch"))


# --- audits

@query("artifact_overlap", """WITH a AS (SELECT DISTINCT artifact_id FROM payload_pages), b AS (SELECT DISTINCT artifact_id FROM artifact_routes WHERE route_state = 'DIRECT'), j AS (SELECT a.artifact_id AS a, b.artifact_id AS b FROM a FULL JOIN b USING (artifact_id)),
    c AS (SELECT count(a) AS authority, count(b) AS candidate, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS common, count(*) FILTER (WHERE b IS NULL) AS only_authority, count(*) FILTER (WHERE a IS NULL) AS only_candidate FROM j)
    SELECT *, CASE WHEN candidate = 0 THEN 'EMPTY' WHEN common = 0 THEN 'DISJOINT' WHEN common = candidate THEN 'FULL' ELSE 'PARTIAL' END AS state FROM c""")
def artifact_overlap(spark, folder):
    return audit.overlap(table(spark, folder, "payload_pages"), table(spark, folder, "artifact_routes").where("route_state = 'DIRECT'"), "artifact_id")


@query("provider_overlap", """WITH r AS (SELECT DISTINCT artifact_id FROM artifact_routes), c AS (SELECT source_adapter, count(*) AS candidate, count(r.artifact_id) AS common FROM (SELECT DISTINCT source_adapter, artifact_id FROM artifacts) LEFT JOIN r USING (artifact_id) GROUP BY source_adapter)
    SELECT *, CASE WHEN common = 0 THEN 'DISJOINT' WHEN common = candidate THEN 'FULL' ELSE 'PARTIAL' END AS state FROM c""")
def provider_overlap(spark, folder):
    return audit.overlap_by(table(spark, folder, "artifact_routes"), table(spark, folder, "artifacts"), "artifact_id", "source_adapter")


@query("set_digest_by_day", "SELECT strftime(timezone('UTC', accepted_at::TIMESTAMPTZ), '%Y-%m-%d') AS day, count(DISTINCT ledger_sha256) AS keys, sha256(string_agg(DISTINCT ledger_sha256 || chr(10), '' ORDER BY ledger_sha256 || chr(10))) AS digest FROM artifacts GROUP BY day")
def set_digest_by_day(spark, folder):
    return audit.digests_by(table(spark, folder, "artifacts").withColumn("day", utc_day(F.col("accepted_at")).cast("string")), "ledger_sha256", "day")


@query("ledger_membership_gap", "SELECT artifact_id, 'left' AS side FROM artifacts WHERE artifact_id NOT IN (SELECT artifact_id FROM payload_pages) UNION ALL SELECT DISTINCT artifact_id, 'right' AS side FROM payload_pages WHERE artifact_id NOT IN (SELECT artifact_id FROM artifacts)")
def ledger_membership_gap(spark, folder):
    return audit.membership_gap(table(spark, folder, "artifacts"), table(spark, folder, "payload_pages"), "artifact_id")


@query("unrouted_artifacts", "SELECT artifact_id FROM artifacts WHERE artifact_id NOT IN (SELECT artifact_id FROM artifact_routes)")
def unrouted_artifacts(spark, folder):
    return audit.orphans(table(spark, folder, "artifacts"), table(spark, folder, "artifact_routes"), "artifact_id", "artifact_id").select("artifact_id")


@query("orphan_routes", "SELECT artifact_id, projected_session_id FROM artifact_routes WHERE projected_session_id NOT IN (SELECT session_id FROM sessions)")
def orphan_routes(spark, folder):
    return audit.orphans(table(spark, folder, "artifact_routes"), table(spark, folder, "sessions"), "projected_session_id", "session_id").select("artifact_id", "projected_session_id")


@query("misplaced_pages", "SELECT DISTINCT p.page_id, p.artifact_id FROM payload_pages p JOIN artifact_routes r USING (artifact_id) WHERE p.session_id <> r.projected_session_id")
def misplaced_pages(spark, folder):
    return audit.misplaced_pages(table(spark, folder, "payload_pages"), table(spark, folder, "artifact_routes"))


@query("pages_off_their_conversation", "SELECT DISTINCT p.page_id, p.artifact_id FROM payload_pages p JOIN artifact_routes r USING (artifact_id) WHERE p.session_id <> r.accepted_session_id")
def pages_off_their_conversation(spark, folder):
    """Pages of branches and of artifacts that found none: their session isn't the conversation's own."""
    return audit.misplaced_pages(table(spark, folder, "payload_pages"), table(spark, folder, "artifact_routes").withColumn("projected_session_id", F.col("accepted_session_id")))


@query("duplicate_identity", "SELECT session_id, local_identity, count(*) AS copies FROM messages GROUP BY ALL HAVING count(*) > 1")
def duplicate_identity(spark, folder):
    return audit.duplicates(table(spark, folder, "messages"), ["session_id", "local_identity"])


@query("index_coverage_gap", "SELECT row_id FROM messages WHERE search_class <> 'hidden' AND text <> '' AND row_id NOT IN (SELECT row_id FROM hit_scores)")
def index_coverage_gap(spark, folder):
    return s.indexable(table(spark, folder, "messages")).join(table(spark, folder, "hit_scores"), "row_id", "left_anti").select("row_id")


@query("inbox_pending_accepted", "SELECT DISTINCT artifact_id, CASE WHEN artifact_id IN (SELECT artifact_id FROM artifact_routes) THEN 'accepted' ELSE 'pending' END AS state FROM artifacts")
def inbox_pending_accepted(spark, folder):
    return audit.split_pending(table(spark, folder, "artifacts"), table(spark, folder, "artifact_routes"), "artifact_id")


@query("replica_diff", """WITH l AS (SELECT session_id, coverage_state FROM sessions), r AS (SELECT session_id, min(coverage_state) AS coverage_state FROM artifacts GROUP BY session_id)
    SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""")
def replica_diff(spark, folder):
    right = table(spark, folder, "artifacts").groupBy("session_id").agg(F.min("coverage_state").alias("coverage_state"))
    return audit.symmetric_difference(table(spark, folder, "sessions").select("session_id", "coverage_state"), right)


@query("replica_conflicts", "SELECT DISTINCT s.session_id FROM sessions s JOIN artifacts a USING (session_id) WHERE s.coverage_state IS DISTINCT FROM a.coverage_state")
def replica_conflicts(spark, folder):
    return audit.conflicting(table(spark, folder, "sessions"), table(spark, folder, "artifacts"), "session_id", "coverage_state")


@query("projection_equality", f"""WITH v AS (SELECT s.session_id, min(create_time) AS t0, max(create_time) AS t1 FROM sessions s LEFT JOIN messages m ON m.session_id = s.session_id GROUP BY s.session_id)
    SELECT session_id FROM sessions s JOIN v USING (session_id) WHERE s.first_message_time IS DISTINCT FROM t0 OR s.last_message_time IS DISTINCT FROM t1""")
def projection_equality(spark, folder):
    kept = table(spark, folder, "sessions").select("session_id", F.col("first_message_time").alias("first_time"), F.col("last_message_time").alias("last_time"))
    derived = corpus.session_bounds(table(spark, folder, "sessions"), table(spark, folder, "messages")).drop("messages")
    return kept.exceptAll(derived).select("session_id")


@query("projection_checks", """SELECT 'routes have artifacts' AS check_name, count(*) AS violations FROM artifact_routes WHERE artifact_id NOT IN (SELECT artifact_id FROM artifacts)
    UNION ALL SELECT 'artifacts have routes', count(*) FROM artifacts WHERE artifact_id NOT IN (SELECT artifact_id FROM artifact_routes)
    UNION ALL SELECT 'pages have artifacts', count(*) FROM payload_pages WHERE artifact_id NOT IN (SELECT artifact_id FROM artifacts)
    UNION ALL SELECT 'pages are where their artifact is', count(*) FROM payload_pages p JOIN artifact_routes r USING (artifact_id) WHERE p.session_id <> r.projected_session_id
    UNION ALL SELECT 'sources have messages', count(*) FROM message_sources WHERE message_row_id NOT IN (SELECT row_id FROM messages)
    UNION ALL SELECT 'sources have pages', count(*) FROM message_sources WHERE page_id NOT IN (SELECT page_id FROM payload_pages)
    UNION ALL SELECT 'messages have sessions', count(*) FROM messages WHERE session_id NOT IN (SELECT session_id FROM sessions)
    UNION ALL SELECT 'identities are unique', count(*) FROM (SELECT 1 FROM messages GROUP BY session_id, local_identity HAVING count(*) > 1)
    UNION ALL SELECT 'ordinals are unique', count(*) FROM (SELECT 1 FROM messages GROUP BY session_id, ordinal HAVING count(*) > 1)
    UNION ALL SELECT 'digests are unique', count(*) FROM (SELECT 1 FROM artifacts GROUP BY sha256 HAVING count(*) > 1)""")
def projection_checks(spark, folder):
    names = ("sessions", "messages", "artifacts", "artifact_routes", "payload_pages", "message_sources")
    return audit.verify(audit.projection_checks({t: table(spark, folder, t) for t in names})).select("check_name", "violations")


@query("table_counts", "SELECT 'messages' AS table_name, count(*) AS n FROM messages UNION ALL SELECT 'sessions', count(*) FROM sessions UNION ALL SELECT 'artifacts', count(*) FROM artifacts")
def table_counts(spark, folder):
    return audit.table_counts({t: table(spark, folder, t) for t in ("messages", "sessions", "artifacts")})


@query("family_closure_digest", "SELECT accepted_session_id, sha256(string_agg(DISTINCT sha256 || chr(10), '' ORDER BY sha256 || chr(10))) AS digest FROM artifact_routes JOIN artifacts USING (artifact_id) GROUP BY accepted_session_id")
def family_closure_digest(spark, folder):
    own = table(spark, folder, "artifact_routes").join(table(spark, folder, "artifacts").select("artifact_id", "sha256"), "artifact_id")
    return own.groupBy("accepted_session_id").agg(set_digest(F.col("sha256")).alias("digest"))


# --- evaluation: each evaluation item's names are a query, its passage's documents the targets

QUERY_TERMS = r"q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(query_text), '[\p{L}\p{N}]+'))) AS term FROM eval_items), posts AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM posts WHERE term IN (SELECT term FROM q) GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM posts)"
GATED = f"""{QUERY_TERMS}, w AS (SELECT q.query_id, q.term, df, ln((n + 1.0) / (df + 1.0)) + 1 AS idf FROM q JOIN df USING (term), n),
    gate AS (SELECT DISTINCT query_id, doc_id FROM w JOIN posts USING (term) WHERE df BETWEEN 1 AND 128),
    sc AS (SELECT query_id, doc_id, round(sum(idf), 6) AS score FROM w JOIN posts USING (term) JOIN gate USING (query_id, doc_id) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


def documents_index(spark, folder):
    """The index of the documents that have a word."""
    return index_of(spark, f"{folder}/documents.parquet", "doc_id", lambda df: df.where(F.col("text").rlike(WORD)))


def _terms(spark, folder):
    return table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))


def _gated(spark, folder):
    own = documents_index(spark, folder)
    return evaluate.df_gated(own.postings().select("term", "doc_id"), _terms(spark, folder), own.n_docs)


@query("df_gated_retrieval", f"WITH {GATED} SELECT query_id, doc_id, score, rank FROM ranked")
def df_gated_retrieval(spark, folder):
    return _gated(spark, folder)


# a case's target: the first document that holds the first eight words of its passage side by side
TARGETS = r"""pt AS (SELECT item_id AS case_id, list_slice(regexp_extract_all(lower(passage), '[\p{L}\p{N}]+'), 1, 8) AS k FROM eval_items),
    dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), ds AS (SELECT doc_id, unnest([w[i:i + 7] FOR i IN range(1, greatest(len(w) - 6, 1))]) AS k FROM dw),
    targets AS (SELECT case_id, min(doc_id) AS target_fp FROM pt LEFT JOIN ds ON ds.k = pt.k AND len(pt.k) = 8 GROUP BY case_id)"""
RANKS = f"{GATED}, {TARGETS}, ranks AS (SELECT t.case_id, min(r.rank) FILTER (WHERE r.doc_id = t.target_fp) AS target_rank FROM targets t LEFT JOIN ranked r ON r.query_id = t.case_id GROUP BY t.case_id)"


def _gold(spark, folder):
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("case_id"), F.slice(tokens(F.col("passage")), 1, 8).alias("w"))
    heads = items.select("case_id", F.when(F.size("w") == 8, F.array_join("w", " ")).alias("head"))
    own = table(spark, folder, "documents").select("doc_id", F.explode(F.array(tokens(F.col("text")))).alias("w")).where(F.size("w") >= 8)
    runs = own.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))).alias("head"))
    met = runs.join(F.broadcast(heads.where("head is not null")), "head").groupBy("case_id").agg(F.min("doc_id").alias("target_fp"))  # 200 evaluation items
    return heads.select("case_id").join(met, "case_id", "left")


def _ranks(spark, folder):
    rows = _gated(spark, folder).select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("fp"), "rank")
    return evaluate.target_ranks(rows, _gold(spark, folder))


@query("gold_target_ranks", f"WITH {RANKS} SELECT case_id, target_rank FROM ranks")
def gold_target_ranks(spark, folder):
    return _ranks(spark, folder)


METRICS = "count(*) AS cases, " + ", ".join(f"round(avg(coalesce((target_rank <= {k})::INT::DOUBLE, 0)), 6) AS r_at_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0 / target_rank, 0)), 6) AS mrr"


@query("retrieval_metrics", f"WITH {RANKS} SELECT {METRICS} FROM ranks")
def retrieval_metrics(spark, folder):
    return evaluate.retrieval_metrics(_ranks(spark, folder))


@query("retrieval_metrics_by_language", f"WITH {RANKS} SELECT query_lang, {METRICS} FROM ranks JOIN eval_items ON item_id = case_id GROUP BY query_lang")
def retrieval_metrics_by_language(spark, folder):
    own = _ranks(spark, folder).join(table(spark, folder, "eval_items").select(F.col("item_id").alias("case_id"), "query_lang"), "case_id")
    return evaluate.retrieval_metrics(own, ["query_lang"])


@query("candidate_ranker_separation", f"""WITH {RANKS} SELECT count(*) AS cases, count(target_rank) AS reachable, count(*) FILTER (WHERE target_rank <= 10) AS top, count(*) FILTER (WHERE target_rank IS NULL AND target_rank <= 10) AS impossible, round(count(*) FILTER (WHERE target_rank <= 10) / nullif(count(target_rank), 0), 6) AS top_of_reachable, round(sum(coalesce(1.0 / target_rank, 0)) / count(*), 6) AS mrr FROM ranks""")
def candidate_ranker_separation(spark, folder):
    return evaluate.separation(_ranks(spark, folder).withColumn("reachable", F.col("target_rank").isNotNull()))


FAR = "4611686018427387904"


@query("policy_compare", f"""WITH {RANKS}, o AS (SELECT case_id, CASE WHEN case_id % 3 = 0 THEN target_rank + 1 WHEN case_id % 3 = 1 THEN target_rank END AS target_rank FROM ranks WHERE case_id % 10 <> 9),
    j AS (SELECT r.case_id AS a, o.case_id AS b, coalesce(r.target_rank, {FAR}) AS x, coalesce(o.target_rank, {FAR}) AS y FROM ranks r FULL JOIN o ON r.case_id = o.case_id)
    SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND y < x) AS improved, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND y = x) AS same, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND y > x) AS worse, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS mismatch FROM j""")
def policy_compare(spark, folder):
    ranks = _ranks(spark, folder)
    other = ranks.where("case_id % 10 <> 9").withColumn("target_rank", F.when(F.col("case_id") % 3 == 0, F.col("target_rank") + 1).when(F.col("case_id") % 3 == 1, F.col("target_rank")))
    return evaluate.compare(ranks, other)


@query("concentration", f"WITH {candidates_sql(RECALL, 'recall', SCOPED, 300, 3)}, p AS (SELECT session_id, count(*) AS n FROM candidates GROUP BY session_id) SELECT sum(n)::BIGINT AS n_rows, count(*) AS groups, round(max(n) / sum(n), 6) AS max_share FROM p")
def concentration(spark, folder):
    return evaluate.concentration(index(spark, folder).candidates(s.Request(RECALL, "recall", limit=100)))


CURVE = f"""{scored_sql(RECALL, 'recall')}, pl AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score, ordinal, row_id) AS place FROM scored), caps AS (SELECT unnest([1, 3, 7, 30]) AS cap),
    ea AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY score, session_id, ordinal, row_id) AS k FROM pl, caps WHERE place <= cap), pe AS (SELECT cap, session_id, count(*) AS n FROM ea WHERE k <= 120 GROUP BY ALL),
    cu AS (SELECT cap, sum(n)::BIGINT AS n_rows, count(*) AS sessions, round(max(n) / sum(n), 6) AS max_share FROM pe GROUP BY cap)"""


@query("cap_curve", f"WITH {CURVE} SELECT cap::BIGINT AS cap, n_rows, sessions, max_share, n_rows - lag(n_rows) OVER (ORDER BY cap) AS gained_rows FROM cu")
def cap_curve(spark, folder):
    found = index(spark, folder).scored(RECALL, "recall")
    return evaluate.cap_curve(found, (1, 3, 7, 30), 120, s.ORDER)


@query("challenger_selection", f"""WITH {RANKS}, p AS (SELECT case_id % 5 AS cap, round(avg(coalesce((target_rank <= 10)::INT::DOUBLE, 0)), 6) AS r_at_10, round(count(target_rank) / count(*), 6) AS recall FROM ranks GROUP BY cap) SELECT cap, r_at_10, recall FROM p WHERE r_at_10 >= 0.0 ORDER BY r_at_10 DESC, recall DESC, cap LIMIT 1""")
def challenger_selection(spark, folder):
    points = _ranks(spark, folder).groupBy((F.col("case_id") % 5).alias("cap")).agg(F.round(F.avg(F.coalesce((F.col("target_rank") <= 10).cast("double"), F.lit(0.0))), 6).alias("r_at_10"), F.round(F.count("target_rank") / F.count("*"), 6).alias("recall"))
    return evaluate.choose_challenger(points, 0.0)


VIEW_A, VIEW_B = "wrong title", "short note"


def _view(text: str, name: str) -> str:
    return f"{name} AS (WITH {scored_sql(text, 'strict')} SELECT row_id, session_id, ordinal, row_number() OVER (ORDER BY score, session_id, ordinal, row_id) AS rank FROM (SELECT * FROM scored ORDER BY score, session_id, ordinal, row_id LIMIT 300))"


def _view_rows(spark, folder, text):
    found = index(spark, folder).scored(text)
    return s.ranked(found.orderBy(*s.ORDER).limit(300), s.ORDER, "rank").select("row_id", "session_id", "ordinal", "rank")


BY_RANKS = "rrf DESC, least(full_rank, sparse_rank), full_rank NULLS LAST, sparse_rank NULLS LAST, session_id, ordinal, row_id"


@query("rrf_fusion", f"""WITH {_view(VIEW_A, 'va')}, {_view(VIEW_B, 'vb')}, f AS (SELECT row_id, session_id, ordinal, va.rank AS full_rank, vb.rank AS sparse_rank, coalesce(1 / (60 + va.rank), 0) + coalesce(1 / (60 + vb.rank), 0) AS rrf FROM va FULL JOIN vb USING (row_id, session_id, ordinal))
    SELECT row_id, full_rank, sparse_rank, round(rrf, 9) AS rrf, row_number() OVER (ORDER BY {BY_RANKS}) AS fused_rank FROM f ORDER BY {BY_RANKS} LIMIT 30""")
def rrf_fusion(spark, folder):
    fused = evaluate.fuse_rrf(_view_rows(spark, folder, VIEW_A), _view_rows(spark, folder, VIEW_B), ["session_id", "ordinal", "row_id"])
    return fused.select("row_id", "full_rank", "sparse_rank", "rrf", "fused_rank")


# the greedy choice as a recursion over a list of chosen places, with all pairs' overlaps as a matrix
MMR = rf"""{candidates_sql(STRICT, 'strict', SCOPED, 300)}, g AS (SELECT text, min(candidate_rank) AS first_rank FROM candidates GROUP BY text ORDER BY first_rank LIMIT 100),
    o AS (SELECT row_number() OVER (ORDER BY first_rank) AS i, list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+')) AS w FROM g),
    pairs AS (SELECT a.i, b.i AS j, CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) END AS v FROM o a, o b),
    m AS (SELECT list(r ORDER BY i) AS m, count(*) AS n FROM (SELECT i, list(v ORDER BY j) AS r FROM pairs GROUP BY i)),
    pick AS (SELECT 0 AS step, []::BIGINT[] AS chosen UNION ALL
        SELECT step + 1, list_append(chosen, -(list_sort([{{'v': 0.2::DOUBLE * (CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - (x - 1)::DOUBLE / (n - 1) END) - 0.8::DOUBLE * coalesce(list_max([m[x][c] FOR c IN chosen]), 0.0::DOUBLE), 'k': -x}} FOR x IN range(1, n + 1) IF NOT list_contains(chosen, x)])[-1]).k)
        FROM pick, m WHERE step < least(20, n))"""


@query("mmr_select", f"WITH RECURSIVE {MMR} SELECT unnest(chosen)::BIGINT AS rank, generate_subscripts(chosen, 1)::BIGINT AS mmr_rank FROM pick WHERE step = (SELECT max(step) FROM pick)")
def mmr_select(spark, folder):
    found = index(spark, folder).candidates(s.Request(STRICT, limit=100))
    groups = s.exact_groups(found, limit=100)
    return evaluate.mmr_select(groups.select(F.col("group_rank").alias("rank"), folded_tokens(F.col("text")).alias("words")), 20, 0.2)


DENSE = STRICT.split()
COVERS = f"""d AS (SELECT row_id, {WORDS} AS w FROM messages WHERE search_class <> 'hidden' AND text <> ''), o AS (SELECT row_id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pos) AS n FROM o WHERE t IN ({', '.join(f"'{w}'" for w in DENSE)})),
    l AS (SELECT *, {', '.join(f"max(CASE WHEN t = '{w}' THEN pos END) OVER h AS a{i}, max(CASE WHEN t = '{w}' THEN n END) OVER h AS n{i}" for i, w in enumerate(DENSE))} FROM k WINDOW h AS (PARTITION BY row_id ORDER BY pos)),
    c AS (SELECT row_id, least({', '.join(f'a{i}' for i in range(len(DENSE)))}) AS b, min(pos) AS e, min(n) AS ne, min(least({', '.join(f'n{i}' for i in range(len(DENSE)))})) AS nb FROM l WHERE {' AND '.join(f'a{i} IS NOT NULL' for i in range(len(DENSE)))} GROUP BY ALL)"""


@query("cover_density_scores", f"WITH {COVERS} SELECT row_id, round(sum(0.1::DOUBLE / (1 + (e - b) - (ne - nb))), 6) AS density FROM c GROUP BY row_id")
def cover_density_scores(spark, folder):
    return index(spark, folder).density(STRICT).select("row_id", F.round("density", 6).alias("density"))


_GLUE = ", ".join(f"'{w}'" for w in (*evaluate.FRAMING, *evaluate.CLOSED_CLASS))
FEATURES = rf"""pos AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(query_text), '[\p{{L}}\p{{N}}]+'))) AS token, regexp_extract_all(lower(query_text), '[\p{{L}}\p{{N}}]+') AS w FROM eval_items),
    posts AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
    features AS (SELECT query_id, token, (list_position(w, token) - 1)::BIGINT AS ordinal, round(ln(((SELECT count(DISTINCT doc_id) FROM posts) + 1.0) / (coalesce(df, 0) + 1.0)) + 1, 6) AS idf,
        CASE WHEN token IN ({_GLUE}) THEN 'glue' WHEN regexp_matches(token, '\p{{Nd}}') THEN 'identifier' WHEN regexp_full_match(token, '[a-z]+') THEN 'technical' ELSE 'other' END AS kind FROM pos LEFT JOIN df ON term = token)"""


def _features(spark, folder):
    w = tokens(F.col("query_text"))
    own = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(w)).alias("token"), w.alias("w"))
    documents = documents_index(spark, folder)
    n, df = documents.n_docs, documents.frequencies().withColumnRenamed("term", "token")
    idf = F.round(F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1, 6)
    return own.join(df, "token", "left").select("query_id", "token", (F.array_position("w", F.col("token")) - 1).cast("bigint").alias("ordinal"), idf.alias("idf"), evaluate.token_kind(F.col("token"), F.col("token")).alias("kind"))


@query("sparse_view_planner", f"""WITH {FEATURES}, g AS (SELECT *, bool_and(kind = 'glue') OVER (PARTITION BY query_id) AS all_glue FROM features),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE kind WHEN 'identifier' THEN 0 WHEN 'technical' THEN 1 WHEN 'nominal' THEN 2 WHEN 'qualifier' THEN 3 WHEN 'other' THEN 4 ELSE 5 END, idf DESC, ordinal) AS k FROM g WHERE all_glue OR kind <> 'glue')
    SELECT query_id, token, ordinal, kind, row_number() OVER (PARTITION BY query_id ORDER BY ordinal) AS place FROM k WHERE k <= 5""")
def sparse_view_planner(spark, folder):
    return evaluate.plan_sparse_view(_features(spark, folder))


@query("glue_ratio_selector", f"WITH {FEATURES} SELECT query_id, round(avg((kind = 'glue')::INT::DOUBLE), 6) AS glue_ratio, CASE WHEN round(avg((kind = 'glue')::INT::DOUBLE), 6) >= 0.5 THEN 'sparse' ELSE 'full' END AS view FROM features GROUP BY query_id")
def glue_ratio_selector(spark, folder):
    return evaluate.select_view(_features(spark, folder))


@query("latency_percentiles", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(list_sort(list(value))[least(floor(count(value) * 0.95)::BIGINT, count(value) - 1) + 1], 6) AS p95_at FROM events GROUP BY event_type")
def latency_percentiles(spark, folder):
    return evaluate.percentiles(table(spark, folder, "events"), "value", ["event_type"])


# --- feedback and reconciliation

EPISODES = "e AS (SELECT event_type || '::op::' || (user_id % 3) AS pattern, CASE WHEN value < 10 THEN 'improved' WHEN value < 30 THEN 'same' WHEN value < 60 THEN 'worse' ELSE 'no_signal' END AS outcome, event_id % 4 <> 0 AS ok FROM events)"


@query("feedback_patterns", f"WITH {EPISODES} SELECT pattern, count(*) AS observed, count(*) FILTER (WHERE ok) AS eligible, count(*) FILTER (WHERE NOT ok) AS ineligible, {', '.join(f"count(*) FILTER (WHERE ok AND outcome = '{o}') AS {o}" for o in feedback.OUTCOMES)} FROM e GROUP BY pattern")
def feedback_patterns(spark, folder):
    v = F.col("value")
    own = table(spark, folder, "events").select(F.col("event_type").alias("failure_class"), F.lit("op").alias("operator_name"), (F.col("user_id") % 3).cast("string").alias("operator_version"), F.when(v < 10, "improved").when(v < 30, "same").when(v < 60, "worse").otherwise("no_signal").alias("outcome"), (F.col("event_id") % 4 != 0).alias("aggregation_eligible"))
    return feedback.patterns(own)


@query("alias_concept_match", r"""WITH forms AS (SELECT DISTINCT session_id AS concept_id, trim(regexp_replace(lower(title), '\s+', ' ', 'g'), ' ') AS form FROM sessions WHERE title IS NOT NULL UNION SELECT DISTINCT session_id, trim(regexp_replace(lower(observed_title), '\s+', ' ', 'g'), ' ') FROM artifacts WHERE observed_title IS NOT NULL)
    SELECT DISTINCT a.observed_title AS query, f.concept_id FROM artifacts a JOIN forms f ON f.form = trim(regexp_replace(lower(a.observed_title), '\s+', ' ', 'g'), ' ') WHERE a.observed_title <> ''""")
def alias_concept_match(spark, folder):
    a = table(spark, folder, "artifacts")
    names = a.groupBy("session_id").agg(F.collect_set("observed_title").alias("aliases"))
    every = table(spark, folder, "sessions").select("session_id", "title").join(names, "session_id", "left")
    concepts = every.select(F.col("session_id").alias("concept_id"), F.col("title").alias("preferred_label"), "aliases").where("preferred_label is not null or aliases is not null")
    return feedback.matching_concepts(concepts, a.where("observed_title <> ''").select(F.col("observed_title").alias("query")).distinct())


@query("keyed_union_first", f"""WITH {_view(VIEW_A, 'va')}, {_view(VIEW_B, 'vb')}, u AS (SELECT row_id, rank AS position, 0 AS branch FROM va UNION ALL SELECT row_id, rank, 1 FROM vb), k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY branch, position) AS k FROM u)
    SELECT row_id, position, branch::BIGINT AS branch FROM k WHERE k = 1 ORDER BY branch, position, row_id LIMIT 400""")
def keyed_union_first(spark, folder):
    views = [_view_rows(spark, folder, t).withColumnRenamed("rank", "position") for t in (VIEW_A, VIEW_B)]
    return corpus.first_of(views, ["row_id"], 400).select("row_id", "position", *big("branch"))


# --- browsing and allocation

PAGE = f"own AS (SELECT ordinal, coalesce(message_id, local_identity) AS message_id, search_class, text, length(text) AS n FROM messages WHERE session_id = '{LONG_SESSION}' AND search_class <> 'hidden' AND text <> '')"


@query("session_page", f"""WITH {PAGE}, t AS (SELECT *, sum(n) OVER (ORDER BY ordinal, message_id) AS run, row_number() OVER (ORDER BY ordinal, message_id) AS k FROM (SELECT * FROM own ORDER BY ordinal, message_id LIMIT 20))
    SELECT ordinal::BIGINT AS ordinal, message_id, search_class, substr(text, 1, 4000) AS text, 0::BIGINT AS text_offset, n::BIGINT AS text_total_chars, n <= 4000 AS complete_message FROM t WHERE run <= 4000 OR k = 1""")
def session_page(spark, folder):
    return browse.read_page(table(spark, folder, "messages"), LONG_SESSION).select(*big("ordinal"), "message_id", "search_class", "text", "text_offset", "text_total_chars", "complete_message")


@query("char_budget_page", f"""WITH {PAGE}, o AS (SELECT * FROM own WHERE ordinal >= 500), t AS (SELECT *, sum(n) OVER (ORDER BY ordinal, message_id) AS run, row_number() OVER (ORDER BY ordinal, message_id) AS k FROM (SELECT * FROM o ORDER BY ordinal, message_id LIMIT 20))
    SELECT ordinal::BIGINT AS ordinal, message_id, substr(text, 1, 30) AS text, n::BIGINT AS text_total_chars, n <= 30 AS complete_message FROM t WHERE run <= 30 OR k = 1""")
def char_budget_page(spark, folder):
    page = browse.read_page(table(spark, folder, "messages"), LONG_SESSION, browse.Position(499, "~"), max_chars=30)
    return page.select(*big("ordinal"), "message_id", "text", "text_total_chars", "complete_message")


TARGET, HARD = 4_000_000, 400_000_000
SIZED = f"{HOMES}, {VOLUME}, sized AS (SELECT provider, session_id, first_accepted_at, searchable_bytes + searchable_messages * {allocate.BYTES_PER_MESSAGE} AS size FROM volume JOIN homes USING (session_id) JOIN (SELECT session_id, first_accepted_at FROM sessions) USING (session_id))"
ALLOCATED = f"""{SIZED}, seq AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY first_accepted_at NULLS LAST, session_id) AS k FROM sized),
    alloc AS (SELECT provider, session_id, k, 1 AS shard, size AS used, size FROM seq WHERE k = 1 UNION ALL SELECT s.provider, s.session_id, s.k, CASE WHEN a.used > 0 AND a.used + s.size > {TARGET} THEN a.shard + 1 ELSE a.shard END, CASE WHEN a.used > 0 AND a.used + s.size > {TARGET} THEN s.size ELSE a.used + s.size END, s.size FROM alloc a JOIN seq s ON s.provider = a.provider AND s.k = a.k + 1)"""


def _allocated(spark, folder):
    own = _volume(spark, folder).join(_homes(spark, folder).select("session_id", "provider"), "session_id").join(table(spark, folder, "sessions").select("session_id", "first_accepted_at"), "session_id")
    # the SQL lays out every session, whatever its size
    return allocate.allocate(allocate.estimated_size(own), TARGET, HARD, keep_over=True)


@query("shard_allocation", f"WITH RECURSIVE {ALLOCATED} SELECT provider, session_id, shard::BIGINT AS shard, size::BIGINT AS size FROM alloc")
def shard_allocation(spark, folder):
    return _allocated(spark, folder)


@query("shard_summary", f"WITH RECURSIVE {ALLOCATED} SELECT provider, shard::BIGINT AS shard, count(*) AS sessions, sum(size)::BIGINT AS size, (greatest(0, {TARGET} - sum(size)) * 1000 // {TARGET})::BIGINT AS headroom_tenths FROM alloc GROUP BY provider, shard")
def shard_summary(spark, folder):
    return allocate.allocation_summary(_allocated(spark, folder), TARGET)


# --- trees: a session's messages by place, every seventh answering the one three places before

NODES = "nodes AS (SELECT session_id AS tree_id, n AS node_id, CASE WHEN n = 0 THEN NULL WHEN n % 7 = 6 THEN n - 3 ELSE n - 1 END AS parent_id, create_time FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal, row_id) - 1 AS n FROM messages))"


def _nodes(spark, folder, *more):
    own = table(spark, folder, "messages").select(F.col("session_id").alias("tree_id"), "ordinal", "row_id", "create_time", *more)
    own = numbered(own, ["tree_id"], [F.col("ordinal"), F.col("row_id")], "node_id").drop("ordinal", "row_id")
    return own.withColumn("parent_id", F.when(F.col("node_id") == 0, None).when(F.col("node_id") % 7 == 6, F.col("node_id") - 3).otherwise(F.col("node_id") - 1))


@query("tree_leaves", f"WITH {NODES} SELECT tree_id, node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.tree_id = n.tree_id AND c.parent_id = n.node_id)")
def tree_leaves(spark, folder):
    return trees.leaves(_nodes(spark, folder))


@query("tree_depths", f"WITH RECURSIVE {NODES}, d AS (SELECT tree_id, node_id, node_id AS root_id, 0::BIGINT AS depth FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.tree_id, n.node_id, d.root_id, d.depth + 1 FROM d JOIN nodes n ON n.tree_id = d.tree_id AND n.parent_id = d.node_id) SELECT * FROM d")
def tree_depths(spark, folder):
    return trees.depths(_nodes(spark, folder))


# the same trees without their traces: what hung below one reaches no root
GAPS = f"{NODES.replace('create_time FROM (SELECT *', 'create_time, search_class FROM (SELECT *')}, kept AS (SELECT * FROM nodes WHERE search_class <> 'trace')"


@query("tree_integrity", f"""WITH RECURSIVE {GAPS}, d AS (SELECT tree_id, node_id FROM kept WHERE parent_id IS NULL UNION ALL SELECT n.tree_id, n.node_id FROM d JOIN kept n ON n.tree_id = d.tree_id AND n.parent_id = d.node_id),
    c AS (SELECT k.tree_id, count(*) FILTER (WHERE parent_id IS NULL) AS roots, count(*) AS nodes, count(*) FILTER (WHERE d.node_id IS NULL) AS unreachable FROM kept k LEFT JOIN d ON d.tree_id = k.tree_id AND d.node_id = k.node_id GROUP BY k.tree_id)
    SELECT *, roots = 1 AND unreachable = 0 AS sound FROM c""")
def tree_integrity(spark, folder):
    return trees.integrity(_nodes(spark, folder, "search_class").where("search_class <> 'trace'"))


@query("default_children", f"""WITH {NODES}, f AS (SELECT tree_id, parent_id, min(create_time) AS t, count(*) AS children FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL)
    SELECT f.tree_id, f.parent_id, children, min(node_id) AS child_id, count(*) AS tied FROM f JOIN nodes n ON n.tree_id = f.tree_id AND n.parent_id = f.parent_id AND n.create_time IS NOT DISTINCT FROM t GROUP BY ALL""")
def default_children(spark, folder):
    return trees.default_children(_nodes(spark, folder))


@query("claim_evidence_spans", "SELECT row_id AS claim_id, coalesce(substr(text, 5, 7) = (CASE WHEN row_id % 3 = 0 THEN 'changed' ELSE substr(text, 5, 7) END), false) AS holds FROM messages")
def claim_evidence_spans(spark, folder):
    m = table(spark, folder, "messages").select("row_id", "text")
    claims = m.select(F.col("row_id").alias("claim_id"), "row_id", F.lit(4).alias("start"), F.lit(7).alias("length"), F.when(F.col("row_id") % 3 == 0, "changed").otherwise(F.substring("text", 5, 7)).alias("evidence"))
    return trees.evidence_spans(claims, m)


@query("inference_rounds", "WITH n AS (SELECT projected_session_id AS node_id FROM artifact_routes UNION SELECT accepted_session_id FROM artifact_routes), d AS (SELECT DISTINCT projected_session_id AS node_id FROM artifact_routes WHERE projected_session_id <> accepted_session_id) SELECT node_id, CASE WHEN node_id IN (SELECT node_id FROM d) THEN 1 ELSE 0 END::BIGINT AS round FROM n")
def inference_rounds(spark, folder):
    routes = table(spark, folder, "artifact_routes")
    needs = routes.where("projected_session_id <> accepted_session_id").select(F.col("projected_session_id").alias("node_id"), F.col("accepted_session_id").alias("source_id"))
    nodes = routes.select(F.col("projected_session_id").alias("node_id")).union(routes.select("accepted_session_id")).distinct()
    return trees.resolve(nodes, needs)


# --- telemetry

@query("events_per_window", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL")
def events_per_window(spark, folder):
    return telemetry.events_per_window(table(spark, folder, "events"))


@query("latency_by_window", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(sum(value) / count(value), 6) AS mean FROM events GROUP BY ALL")
def latency_by_window(spark, folder):
    return telemetry.latency_by_window(table(spark, folder, "events"))


@query("status_snapshot", "SELECT event_type, max(ts) AS last_seen, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def status_snapshot(spark, folder):
    return telemetry.status_snapshot(table(spark, folder, "events"))
