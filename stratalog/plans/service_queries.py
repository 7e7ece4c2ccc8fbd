"""Queries of reconciled search, ingest, trees and services, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions.digest import line_digest
from stratalog.functions.text import finite, guarded, slug, tokens
from stratalog.operators import audit, corpus, evaluate, federate, feedback, ingest, trees
from stratalog.operators import search as s
from stratalog.operators.generations import Store, generation_id
from stratalog.operators.index import index_of
from stratalog.operators.reconcile import reconciled_search
from stratalog.operators.skew import numbered
from stratalog.plans.corpus_queries import COVERS, PATHS
from stratalog.plans.search_queries import BY, HOMES, RECALL, SCOPED, STRICT, TIME_TO, candidates_sql, catalog, homes, index, scored_sql, table
from stratalog.shared import shared_path
from stratalog.sources.staging import stage, staged
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


# --- reconciled search: three cases, one a state

CONCEPTS = [("c1", "wrong title shard", ["zzqqx ledger"]), ("c2", "mixed", ["qqzzx one", "short note"]), ("c3", "other", ["qqzzx one"])]
CASES = {"direct": ("short note", False), "alias": ("zzqqx ledger", False), "recall": ("zzqqx probabilistic", True), "both": ("wrong title shard", True), "none": ("zzqqx", True), "ambiguous": ("qqzzx one", True)}


def _flat(name: str, text: str, mode: str, cap: int | None = None) -> str:
    """A search's rows, each message once."""
    return f"""{name} AS (WITH {candidates_sql(text, mode, SCOPED, 60, cap)} SELECT row_id, key, row_number() OVER (ORDER BY candidate_rank) AS position FROM (SELECT *, (session_id, coalesce(message_id, local_identity), ordinal) AS key FROM candidates WHERE candidate_rank <= 20
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY candidate_rank) = 1))"""


@query("reconciled_search", f"""WITH {_flat('a', 'short note', 'strict')}, {_flat('b', 'wrong title shard', 'strict')}, {_flat('c', 'zzqqx probabilistic', 'recall', 3)}, {_flat('d', 'qqzzx one', 'recall', 3)}, {_flat('e', 'wrong title shard', 'recall', 3)},
    u AS (SELECT row_id, position, 0 AS g FROM b UNION ALL SELECT row_id, position, 1 FROM e WHERE key NOT IN (SELECT key FROM b)),
    v AS (SELECT row_id, row_number() OVER (ORDER BY g, position) AS position, g FROM u),
    rows AS (SELECT 'direct' AS name, row_id, position, 'DIRECT_LEXICAL' AS basis FROM a UNION ALL SELECT 'alias', row_id, position, 'CONTROLLED_ALIAS_EXPANSION' FROM b UNION ALL SELECT 'recall', row_id, position, 'RECALL_ONLY' FROM c
        UNION ALL SELECT 'ambiguous', row_id, position, 'AMBIGUOUS_RECALL' FROM d UNION ALL SELECT 'both', row_id, position, CASE g WHEN 0 THEN 'DIRECT_LEXICAL' ELSE 'RECALL_ONLY' END FROM v WHERE position <= 20)
    SELECT name, CASE name WHEN 'direct' THEN 'DIRECT_LEXICAL' WHEN 'alias' THEN 'RECONCILED_CANDIDATE' WHEN 'recall' THEN 'RECALL_CANDIDATE' WHEN 'ambiguous' THEN 'AMBIGUOUS_CONCEPT' ELSE CASE WHEN (SELECT count(*) FROM u WHERE g = 1) > 0 THEN 'DIRECT_WITH_RECALL_CANDIDATES' ELSE 'DIRECT_LEXICAL' END END AS state, row_id, position, basis FROM rows""")
def reconciled(spark, folder):
    concepts = spark.createDataFrame(CONCEPTS, "concept_id string, preferred_label string, aliases array<string>")
    out = None
    for name, (text, recall) in CASES.items():
        r = reconciled_search(index(spark, folder), concepts, s.Request(text, limit=20), recall)
        rows = r.rows.select(F.lit(name).alias("name"), F.lit(r.state).alias("state"), "row_id", "position", F.col("retrieval_basis").alias("basis"))
        out = rows if out is None else out.unionByName(rows)
    return out


PARITY = (("short note", "strict"), (STRICT, "strict"), (RECALL, "recall"), (STRICT, "recall"), (STRICT, "phrase"))


@query("search_parity", " UNION ALL ".join(f"SELECT '{t}' AS query, '{m}' AS mode, (WITH {scored_sql(t, m)} SELECT count(*) FROM scored) AS both, 0::BIGINT AS only_scan, 0::BIGINT AS only_index" for t, m in PARITY))
def search_parity(spark, folder):
    """Scan and index answer alike, row by row and score by score."""
    out = None
    for text, mode in PARITY:
        scan = s.scored(table(spark, folder, "messages"), text, mode).select("row_id", "score", F.lit(1).alias("_a"))
        own = index(spark, folder).scored(text, mode).select("row_id", "score", F.lit(1).alias("_b"))
        both = scan.join(own, ["row_id", "score"], "full").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_scan"), F.count_if(F.col("_a").isNull()).alias("only_index"))
        rows = both.select(F.lit(text).alias("query"), F.lit(mode).alias("mode"), "both", "only_scan", "only_index")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- a shard's pinned generation, ranked by cover density

OF_SHARD = "session_id < '8'"


def _pinned(spark, folder):
    """The messages of one shard as a READY generation that is pinned, and their index."""
    at = shared_path(spark, "generations")
    store, sha = Store(spark, at), "a" * 64
    generation = generation_id(sha)
    sessions, messages = table(spark, folder, "sessions").where(OF_SHARD), s.indexable(table(spark, folder, "messages").where(OF_SHARD))
    store.load(generation, sessions, messages, sha)
    store.mark_ready(generation, sha, sessions.count(), messages.count())
    store.activate(generation, None)
    return generation, store.path(generation, "messages") if store.pinned(generation) else None


SHARD_COVERS = COVERS.replace("search_class <> 'hidden'", f"search_class <> 'hidden' AND {OF_SHARD}")
SHARD_RANKED = f"""{SHARD_COVERS}, dn AS (SELECT row_id, round(sum(0.1::DOUBLE / (1 + (e - b) - (ne - nb))), 6) AS density FROM c GROUP BY row_id),
    hits AS (SELECT m.*, density, row_number() OVER (ORDER BY density DESC, session_id, ordinal, m.row_id) AS shard_rank FROM dn JOIN messages m USING (row_id) WHERE {SCOPED}), top AS (SELECT * FROM hits WHERE shard_rank <= 60)"""


def _shard_hits(spark, folder):
    generation, at = _pinned(spark, folder)
    own = index_of(spark, at)
    r = s.Request(STRICT, limit=20)
    found = s.in_scope(own.density(STRICT).withColumn("density", F.round("density", 6)), r)
    order = [F.desc("density"), F.col("session_id"), F.col("ordinal"), F.col("row_id")]
    few = own.documents(found.orderBy(*order).limit(60), 60)
    return s.ranked(few, order, "shard_rank").withColumn("generation_id", F.lit(generation))


@query("shard_generation_search", f"WITH {SHARD_RANKED} SELECT row_id, density, shard_rank, '{generation_id('a' * 64)}' AS generation_id, 'FOUND' AS status FROM top WHERE shard_rank <= 20")
def shard_generation_search(spark, folder):
    return _shard_hits(spark, folder).where("shard_rank <= 20").select("row_id", "density", "shard_rank", "generation_id", F.lit("FOUND").alias("status"))


@query("shard_grouped_generation", f"WITH {SHARD_RANKED} SELECT row_number() OVER (ORDER BY min(shard_rank)) AS group_rank, text, count(*) AS occurrence_count, string_agg(row_id::VARCHAR, ',' ORDER BY shard_rank) AS row_ids FROM top GROUP BY text ORDER BY min(shard_rank) LIMIT 20")
def shard_grouped_generation(spark, folder):
    out = s.exact_groups(_shard_hits(spark, folder), "shard_rank", 20, occurrence=("row_id",))
    return out.select("group_rank", "text", "occurrence_count", F.array_join(F.transform("occurrences", lambda o: o["row_id"].cast("string")), ",").alias("row_ids"))


@query("search_answer_row", f"""WITH {candidates_sql(STRICT, 'strict', SCOPED, 300)}, g AS (SELECT text, min(candidate_rank) AS r FROM candidates GROUP BY text), n AS (SELECT count(*) AS candidates FROM candidates)
    SELECT n.candidates, coalesce(x.groups, []) AS groups FROM n LEFT JOIN (SELECT list(md5(text) ORDER BY r) AS groups FROM g HAVING count(*) > 0) x ON true""")
def search_answer_row(spark, folder):
    """One row whatever was found: the number of candidates, joined with the list of groups or an empty one."""
    found = index(spark, folder).candidates(s.Request(STRICT, limit=100))
    groups = s.exact_groups(found).agg(F.transform(F.sort_array(F.collect_list(F.struct("group_rank", F.md5("text").alias("t")))), lambda g: g["t"]).alias("groups"))
    one = found.agg(F.count("*").alias("candidates")).withColumn("_one", F.lit(1))
    return one.join(groups.withColumn("_one", F.lit(1)), "_one", "left").select("candidates", F.coalesce("groups", F.array().cast("array<string>")).alias("groups"))


@query("session_order", f"WITH {candidates_sql(RECALL, 'recall', SCOPED, 300, 3)}, p AS (SELECT session_id, min(candidate_rank) AS first_rank FROM candidates GROUP BY session_id) SELECT *, row_number() OVER (ORDER BY first_rank) AS session_place FROM p")
def session_order(spark, folder):
    return corpus.session_order(index(spark, folder).candidates(s.Request(RECALL, "recall", limit=100)))


@query("candidates_with_session_size", f"WITH {candidates_sql(RECALL, 'recall', SCOPED, 300, 3)} SELECT row_id, count(*) OVER (PARTITION BY session_id) AS in_session FROM candidates")
def candidates_with_session_size(spark, folder):
    return corpus.with_group_size(index(spark, folder).candidates(s.Request(RECALL, "recall", limit=100)), "session_id", "in_session").select("row_id", "in_session")


MARKED = ("superseded",), "wrong", ("title", "shard")


@query("marker_filter", "SELECT row_id FROM messages WHERE contains(lower(text), 'superseded') OR (contains(lower(text), 'wrong') AND (contains(lower(text), 'title') OR contains(lower(text), 'shard')))")
def marker_filter(spark, folder):
    return table(spark, folder, "messages").where(s.looks_back(F.col("text"), *MARKED)).select("row_id")


# --- catalog

@query("catalog_listing", f"WITH {HOMES} SELECT shard_id, provider, time_min, time_max, (SELECT count(*) FROM catalog) > 3 AS truncated FROM catalog ORDER BY shard_id LIMIT 3")
def catalog_listing(spark, folder):
    return federate.listing(catalog(spark, folder), 3)


@query("watermark_overlay", f"WITH {HOMES}, w AS (SELECT provider, max(time_max) AS observed_through, 'verified' AS watermark_status FROM catalog WHERE provider <> 'unknown' GROUP BY provider) SELECT c.shard_id, c.provider, observed_through, watermark_status FROM catalog c LEFT JOIN w USING (provider)")
def watermark_overlay(spark, folder):
    own = catalog(spark, folder)
    marks = own.where("provider <> 'unknown'").groupBy("provider").agg(F.max("time_max").alias("observed_through"), F.lit("verified").alias("watermark_status"))
    return federate.overlay_watermarks(own, marks).select("shard_id", "provider", "observed_through", "watermark_status")


@query("federated_strict_timeboxed", f"""WITH {HOMES}, {scored_sql(STRICT, 'strict')} SELECT row_id, shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY {BY}) AS shard_rank FROM scored JOIN placed USING (session_id) WHERE {SCOPED} AND create_time < {TIME_TO} QUALIFY shard_rank <= 10""")
def federated_strict_timeboxed(spark, folder):
    found = s.in_scope(index(spark, folder).scored(STRICT), s.Request(STRICT)).where(F.col("create_time") < TIME_TO)
    return federate.shard_hits(found.join(homes(spark, folder).select("session_id", "shard_id"), "session_id"), 10).select("row_id", "shard_id", "shard_rank")


# --- ingest

def _occurrences(spark, folder):
    paths = corpus.provenance(*[table(spark, folder, t) for t in ("messages", "message_sources", "payload_pages", "artifacts")])
    own = paths.join(table(spark, folder, "messages").select("row_id", "local_identity", "create_time", "provider_order", F.col("canonical_message_sha256").alias("digest")), "row_id")
    return own.join(table(spark, folder, "artifacts").select("artifact_id", "accepted_at"), "artifact_id").withColumn("sha256", F.concat(F.lit("a"), F.col("artifact_id").cast("string")))


OCC = f"""{PATHS}, occ AS (SELECT p.artifact_id, p.session_id, m.local_identity, m.canonical_message_sha256 AS digest FROM paths p JOIN messages m USING (row_id)),
    b AS (SELECT *, CASE WHEN artifact_id % 2 = 0 THEN 1 ELSE 2 END AS batch FROM occ),
    r1 AS (SELECT DISTINCT artifact_id FROM (SELECT artifact_id FROM b WHERE batch = 1 GROUP BY artifact_id, session_id, local_identity HAVING count(DISTINCT digest) > 1)),
    ok1 AS (SELECT * FROM b WHERE batch = 1 AND artifact_id NOT IN (SELECT artifact_id FROM r1)),
    r2 AS (SELECT DISTINCT artifact_id FROM (SELECT artifact_id FROM b WHERE artifact_id NOT IN (SELECT artifact_id FROM ok1) GROUP BY artifact_id, session_id, local_identity HAVING count(DISTINCT digest) > 1
        UNION ALL SELECT x.artifact_id FROM b x JOIN ok1 y ON x.session_id = y.session_id AND x.local_identity = y.local_identity AND x.digest <> y.digest WHERE x.artifact_id NOT IN (SELECT artifact_id FROM ok1))),
    ok2 AS (SELECT * FROM b WHERE artifact_id NOT IN (SELECT artifact_id FROM r2) AND artifact_id NOT IN (SELECT artifact_id FROM ok1)), ok AS (SELECT * FROM ok1 UNION ALL SELECT * FROM ok2),
    n1 AS (SELECT count(DISTINCT artifact_id) AS n FROM b WHERE batch = 1), n2 AS (SELECT count(DISTINCT artifact_id) AS n FROM b), k1 AS (SELECT count(DISTINCT artifact_id) AS n FROM ok1), k2 AS (SELECT count(DISTINCT artifact_id) AS n FROM ok2)"""


@query("ingest_receipts", f"""WITH {OCC} SELECT 1::BIGINT AS version, n1.n AS artifacts, k1.n AS accepted, 0::BIGINT AS unchanged, n1.n - k1.n AS rejected, (SELECT count(DISTINCT (session_id, local_identity)) FROM ok1) AS messages, CASE WHEN n1.n > k1.n THEN 'DEGRADED' ELSE 'COMPLETE' END AS state FROM n1, k1
    UNION ALL SELECT 2, n2.n, k2.n, k1.n, n2.n - k1.n - k2.n, (SELECT count(DISTINCT (session_id, local_identity)) FROM ok), CASE WHEN n2.n = k1.n THEN 'UNCHANGED' WHEN n2.n - k1.n - k2.n > 0 THEN 'DEGRADED' ELSE 'COMPLETE' END FROM n2, k1, k2""")
def ingest_receipts(spark, folder):
    """Half of the artifacts, then all of them: the second ingest finds the first half unchanged."""
    own = _occurrences(spark, folder)
    c = ingest.Corpus(spark)
    c.ingest(own.where("artifact_id % 2 = 0"))
    c.ingest(own)
    return c.receipts().select("version", "artifacts", "accepted", "unchanged", "rejected", "messages", "state")


@query("corpus_status", f"WITH {OCC} SELECT count(DISTINCT artifact_id) AS artifacts, count(DISTINCT session_id) AS sessions, count(DISTINCT (session_id, local_identity)) AS messages FROM ok1")
def corpus_status(spark, folder):
    c = ingest.Corpus(spark)
    c.ingest(_occurrences(spark, folder).where("artifact_id % 2 = 0"))
    return c.status().select("artifacts", "sessions", "messages")


@query("rebuild_gap", f"WITH {PATHS}, p AS (SELECT DISTINCT m.session_id, m.local_identity FROM paths x JOIN messages m USING (row_id)), k AS (SELECT DISTINCT session_id, local_identity FROM messages) SELECT 'projection' AS side, k.session_id, k.local_identity FROM k ANTI JOIN p USING (session_id, local_identity) UNION ALL SELECT 'ledger', p.session_id, p.local_identity FROM p ANTI JOIN k USING (session_id, local_identity)")
def rebuild_gap(spark, folder):
    """The projection made anew of what artifacts hold against the stored one, in both directions."""
    keys = ["session_id", "local_identity"]
    made = ingest.project(_occurrences(spark, folder)).select(*keys)
    kept = table(spark, folder, "messages").select(*keys).distinct()
    return made.exceptAll(kept).withColumn("side", F.lit("ledger")).unionByName(kept.exceptAll(made).withColumn("side", F.lit("projection")))


@query("shard_replay", f"""WITH {PATHS}, r AS (SELECT * FROM artifact_routes), sh AS (SELECT session_id FROM sessions WHERE session_id < '8'), cl AS (SELECT DISTINCT artifact_id FROM r WHERE accepted_session_id IN (SELECT accepted_session_id FROM r WHERE projected_session_id IN (SELECT session_id FROM sh))),
    p AS (SELECT DISTINCT m.session_id, m.local_identity FROM paths x JOIN messages m USING (row_id) WHERE artifact_id IN (SELECT artifact_id FROM cl) AND m.session_id IN (SELECT session_id FROM sh)), k AS (SELECT DISTINCT session_id, local_identity FROM messages WHERE session_id IN (SELECT session_id FROM sh))
    SELECT 'projection' AS side, k.session_id, k.local_identity FROM k ANTI JOIN p USING (session_id, local_identity) UNION ALL SELECT 'ledger', p.session_id, p.local_identity FROM p ANTI JOIN k USING (session_id, local_identity)""")
def shard_replay(spark, folder):
    """A shard's messages made anew of the artifacts that bear on it against the stored ones."""
    keys, sessions = ["session_id", "local_identity"], table(spark, folder, "sessions").where(OF_SHARD).select("session_id")
    own = _occurrences(spark, folder).join(corpus.closure(table(spark, folder, "artifact_routes"), sessions), "artifact_id", "left_semi")
    made = ingest.project(own).join(sessions, "session_id", "left_semi").select(*keys)
    kept = table(spark, folder, "messages").join(sessions, "session_id", "left_semi").select(*keys).distinct()
    return made.exceptAll(kept).withColumn("side", F.lit("ledger")).unionByName(kept.exceptAll(made).withColumn("side", F.lit("projection")))


@query("linked_promotion", """WITH o AS (SELECT *, CASE WHEN search_class = 'dialogue' AND text <> '' THEN 0 WHEN search_class = 'evidence' THEN 1 ELSE 2 END AS p FROM messages WHERE message_id IS NOT NULL)
    SELECT message_id, canonical_message_sha256, row_id, session_id, search_class, count(*) OVER (PARTITION BY message_id, canonical_message_sha256) AS linked FROM o QUALIFY row_number() OVER (PARTITION BY message_id, canonical_message_sha256 ORDER BY p, row_id) = 1""")
def linked_promotion(spark, folder):
    return corpus.promoted(table(spark, folder, "messages"))


def _bytes(text: str) -> str:
    return f"list_sum([strlen(x) FOR x IN list_distinct(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))])"


_PARTS = ["text", *[f"left(text, length(text) // {2**k})" for k in range(1, 13)]]


@query("guarded_lexemes", f"WITH g AS (SELECT doc_id, CASE {' '.join(f'WHEN coalesce({_bytes(x)}, 0) <= 1500 THEN {x}' for x in _PARTS)} ELSE '' END AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM g) SELECT doc_id, length(t)::BIGINT AS kept_chars, len(list_distinct(w)) AS lexemes, len(w) AS places FROM w")
def guarded_lexemes(spark, folder):
    own = table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(F.array(guarded(F.col("text"), 1500))).alias("t"))
    own = own.withColumn("w", F.explode(F.array(tokens(F.col("t")))))
    return own.select("doc_id", F.length("t").cast("bigint").alias("kept_chars"), F.size(F.array_distinct("w")).cast("bigint").alias("lexemes"), F.size("w").cast("bigint").alias("places"))


@query("staged_items", "SELECT item_id, query_lang, query_text, passage FROM eval_items")
def staged_items(spark, folder):
    own = table(spark, folder, "eval_items").select("item_id", "query_lang", "query_text", "passage")
    at = shared_path(spark, "staged")
    stage(own, at)
    return staged(spark, at, own.schema)


@query("ingest_order", """WITH o AS (SELECT a.artifact_id, coalesce(accepted_session_id, 'artifact:' || a.artifact_id) AS unit FROM artifacts a LEFT JOIN artifact_routes r USING (artifact_id)), f AS (SELECT DISTINCT accepted_session_id AS unit FROM artifact_routes WHERE route_state = 'BRANCH_MATCH')
    SELECT artifact_id, o.unit, CASE WHEN f.unit IS NULL THEN 1 ELSE 0 END AS family FROM o LEFT JOIN f ON o.unit = f.unit""")
def ingest_order(spark, folder):
    return ingest.ingest_order(table(spark, folder, "artifacts"), table(spark, folder, "artifact_routes")).select("artifact_id", "unit", "family")


SNAPSHOT = {
    "sessions": ("session_id", "title", "coverage_state"), "messages": ("row_id", "session_id", "ordinal", "local_identity", "canonical_message_sha256", "search_class"), "artifacts": ("artifact_id", "sha256", "ledger_sha256", "session_id"),
    "artifact_routes": ("artifact_id", "accepted_session_id", "projected_session_id", "route_state"), "payload_pages": ("page_id", "artifact_id", "session_id", "capture_sequence"), "message_sources": ("message_row_id", "page_id", "page_position", "source_object_sha256"),
    "message_langs": ("row_id", "lang"), "eval_items": ("item_id", "passage"), "documents": ("doc_id", "lang", "source", "text"),
}


@query("semantic_snapshot", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, coalesce(sum(('0x' || substr(sha256(concat_ws('|', {', '.join(f"coalesce({c}::VARCHAR, '')" for c in cs)})), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR AS digest FROM {t}" for t, cs in SNAPSHOT.items()))
def semantic_snapshot(spark, folder):
    """Nine row sets, each with a digest that doesn't depend on the order of the rows."""
    out = None
    for name, columns in SNAPSHOT.items():
        rows = line_digest(table(spark, folder, name), columns).select(F.lit(name).alias("table_name"), "rows", "digest")
        out = rows if out is None else out.unionByName(rows)
    return out


DECISIONS = "d AS (SELECT row_id, CASE WHEN score IS NULL OR isnan(score) THEN 'skip' WHEN score >= 5 THEN 'accept' ELSE 'reject' END AS decision FROM hit_scores), p AS (SELECT row_id, count(DISTINCT decision) AS k, min(decision) AS decision FROM d GROUP BY row_id)"


def _decisions(spark, folder):
    v = F.col("score")
    return table(spark, folder, "hit_scores").select("row_id", F.when(v.isNull() | F.isnan(v), "skip").when(v >= 5, "accept").otherwise("reject").alias("decision"))


@query("frozen_decisions", f"WITH {DECISIONS} SELECT row_id, decision, row_number() OVER (ORDER BY row_id) AS place FROM (SELECT * FROM p WHERE k = 1 AND decision = 'accept' ORDER BY row_id LIMIT 50)")
def frozen_decisions(spark, folder):
    return ingest.freeze(_decisions(spark, folder), "row_id", "decision", ["row_id"], 50).select("row_id", "decision", "place")


@query("decision_conflicts", f"WITH {DECISIONS} SELECT row_id, k AS decisions FROM p WHERE k > 1")
def decision_conflicts(spark, folder):
    return ingest.decision_conflicts(_decisions(spark, folder), "row_id", "decision")


@query("import_counters", f"WITH {PATHS}, o AS (SELECT DISTINCT artifact_id, row_id FROM paths) SELECT artifact_id, count(*) AS messages, count(*) FILTER (WHERE lower(trim(role)) = 'user') AS users, count(*) FILTER (WHERE lower(trim(role)) = 'assistant') AS assistants, count(*) FILTER (WHERE coalesce(lower(trim(role)) NOT IN ('user', 'assistant'), true)) AS others FROM o JOIN messages USING (row_id) GROUP BY artifact_id")
def import_counters(spark, folder):
    paths = corpus.provenance(*[table(spark, folder, t) for t in ("messages", "message_sources", "payload_pages", "artifacts")])
    return corpus.import_counters(paths, table(spark, folder, "messages"))


@query("node_aliases", "SELECT source_adapter, session_id, list_sort(list(DISTINCT observed_title)) AS aliases FROM artifacts WHERE observed_title IS NOT NULL GROUP BY ALL")
def node_aliases(spark, folder):
    return corpus.aliases(table(spark, folder, "artifacts").where("observed_title is not null"), "source_adapter", "session_id", "observed_title")


@query("discovery_summary", "SELECT count(*) AS sessions, min(first_message_time) AS first_time, max(last_message_time) AS last_time, coalesce(sum(('0x' || substr(sha256(session_id), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR AS digest FROM sessions")
def discovery_summary(spark, folder):
    own = table(spark, folder, "sessions")
    bounds = own.agg(F.count("*").alias("sessions"), F.min("first_message_time").alias("first_time"), F.max("last_message_time").alias("last_time"))
    return bounds.withColumn("_one", F.lit(1)).join(line_digest(own, ["session_id"]).select("digest", F.lit(1).alias("_one")), "_one").drop("_one")


@query("identity_shapes", """WITH i AS (SELECT 'message_id' AS field, message_id AS v FROM messages UNION ALL SELECT 'digest', canonical_message_sha256 FROM messages UNION ALL SELECT 'session', session_id FROM sessions UNION ALL SELECT 'adapter', source_adapter FROM artifacts UNION ALL SELECT 'sha256', sha256 FROM artifacts UNION ALL SELECT 'title', observed_title FROM artifacts)
    SELECT field, CASE WHEN v IS NULL THEN NULL WHEN regexp_matches(v, '^[0-9a-f]{32}$') THEN 'hex32' WHEN regexp_matches(v, '^[0-9a-f]{40}$') THEN 'hex40' WHEN regexp_matches(v, '^[0-9a-f]{64}$') THEN 'hex64' WHEN regexp_matches(v, '^[0-9a-f]+$') THEN 'hex' WHEN regexp_matches(v, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'slug' WHEN regexp_matches(v, '^[A-Za-z0-9._:-]{1,128}$') THEN 'id' ELSE 'none' END AS shape, count(*) AS n FROM i GROUP BY ALL""")
def identity_shapes(spark, folder):
    m, a = table(spark, folder, "messages"), table(spark, folder, "artifacts")
    of = lambda df, field, c: df.select(F.lit(field).alias("field"), F.col(c).alias("v"))
    own = of(m, "message_id", "message_id").unionByName(of(m, "digest", "canonical_message_sha256")).unionByName(of(table(spark, folder, "sessions"), "session", "session_id")).unionByName(of(a, "adapter", "source_adapter")).unionByName(of(a, "sha256", "sha256")).unionByName(of(a, "title", "observed_title"))
    return own.groupBy("field", corpus.identity_shape(F.col("v")).alias("shape")).agg(F.count("*").alias("n"))


@query("file_slugs", "SELECT artifact_id, trim(regexp_replace(observed_title, '[^A-Za-z0-9._-]+', '-', 'g'), '-') AS slug FROM artifacts WHERE observed_title IS NOT NULL")
def file_slugs(spark, folder):
    return table(spark, folder, "artifacts").where("observed_title is not null").select("artifact_id", slug(F.col("observed_title")).alias("slug"))


@query("finite_scores", "SELECT coalesce(isfinite(score), false) AS ok, count(*) AS n FROM hit_scores GROUP BY ok")
def finite_scores(spark, folder):
    return table(spark, folder, "hit_scores").groupBy(finite(F.col("score")).alias("ok")).agg(F.count("*").alias("n"))


@query("feedback_replicas", "SELECT artifact_id, 'right' AS missing_in FROM payload_pages WHERE artifact_id % 3 <> 0 AND artifact_id NOT IN (SELECT artifact_id FROM payload_pages WHERE artifact_id % 5 <> 0) GROUP BY artifact_id UNION ALL SELECT artifact_id, 'left' FROM payload_pages WHERE artifact_id % 5 <> 0 AND artifact_id NOT IN (SELECT artifact_id FROM payload_pages WHERE artifact_id % 3 <> 0) GROUP BY artifact_id")
def feedback_replicas(spark, folder):
    own = table(spark, folder, "payload_pages").select("artifact_id", F.col("artifact_id").cast("string").alias("payload"))
    return feedback.reconcile(own.where("artifact_id % 3 <> 0"), own.where("artifact_id % 5 <> 0"), "artifact_id")


@query("refreshed_episodes", "SELECT event_id, event_type FROM events")
def refreshed_episodes(spark, folder):
    own = table(spark, folder, "events").select("event_id", "event_type")
    return feedback.refreshed(own.where("event_id % 2 = 0"), own.where("event_id % 2 <> 0"), "event_id")


RULES = {
    "search": {"k": (True, telemetry.counted(50))}, "click": {"k": (True, telemetry.counted(90))}, "view": {"k": (False, telemetry.counted())}, "purchase": {"k": (True, telemetry.counted()), "sku": (True, telemetry.counted())}, "error": {},
}


@query("event_sanitizer", """WITH e AS (SELECT event_type, (props::JSON ->> 'k')::INT AS k FROM events)
    SELECT event_type, CASE WHEN event_type NOT IN ('search', 'click', 'view', 'purchase', 'error') THEN 'unknown event' WHEN event_type = 'error' THEN 'unknown field' WHEN event_type = 'search' AND NOT k BETWEEN 0 AND 50 THEN 'bad k' WHEN event_type = 'click' AND NOT k BETWEEN 0 AND 90 THEN 'bad k' WHEN event_type = 'purchase' THEN 'no sku' END AS fault, count(*) AS events FROM e GROUP BY ALL""")
def event_sanitizer(spark, folder):
    return telemetry.sanitized(table(spark, folder, "events"), RULES).groupBy("event_type", "fault").agg(F.count("*").alias("events"))


@query("label_sanitizer", "SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS label, CASE WHEN s BETWEEN 200 AND 299 THEN '2xx' WHEN s BETWEEN 400 AND 499 THEN '4xx' WHEN s BETWEEN 500 AND 599 THEN '5xx' ELSE 'other' END AS status_class, count(*) AS events FROM (SELECT event_type, user_id % 500 + 150 AS s FROM events) GROUP BY ALL")
def label_sanitizer(spark, folder):
    own = table(spark, folder, "events").select(telemetry.safe_label(F.col("event_type"), ("view", "click")).alias("label"), telemetry.status_class(F.col("user_id") % 500 + 150).alias("status_class"))
    return own.groupBy("label", "status_class").agg(F.count("*").alias("events"))


# --- trees: a session's messages in trees of fifty, every seventh answering the one three places before

SMALL = "sn AS (SELECT session_id || ':' || (k // 50) AS tree_id, k % 50 AS node_id, CASE WHEN k % 50 = 0 THEN NULL WHEN k % 50 % 7 = 6 THEN k % 50 - 3 ELSE k % 50 - 1 END AS parent_id, (k % 50)::DOUBLE AS create_time FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal, row_id) - 1 AS k FROM messages))"
CLIMB = f"{SMALL}, pa AS (SELECT tree_id, node_id AS leaf_id, node_id, parent_id FROM sn l WHERE NOT EXISTS (SELECT 1 FROM sn c WHERE c.tree_id = l.tree_id AND c.parent_id = l.node_id) UNION ALL SELECT pa.tree_id, leaf_id, sn.node_id, sn.parent_id FROM pa JOIN sn ON sn.tree_id = pa.tree_id AND sn.node_id = pa.parent_id), paths AS (SELECT tree_id, leaf_id, node_id, parent_id, row_number() OVER (PARTITION BY tree_id, leaf_id ORDER BY node_id) - 1 AS place FROM pa)"


def _small_trees(spark, folder):
    own = table(spark, folder, "messages").select("session_id", "ordinal", "row_id")
    own = numbered(own, ["session_id"], [F.col("ordinal"), F.col("row_id")], "k")
    n = F.col("k") % 50
    return own.select(F.concat_ws(":", "session_id", F.floor(F.col("k") / 50)).alias("tree_id"), n.alias("node_id"), F.when(n == 0, None).when(n % 7 == 6, n - 3).otherwise(n - 1).alias("parent_id"), n.cast("double").alias("create_time"))


@query("tree_paths", f"WITH RECURSIVE {CLIMB} SELECT tree_id, leaf_id, node_id, place FROM paths")
def tree_paths(spark, folder):
    return trees.leaf_paths(_small_trees(spark, folder))


@query("tree_variants", f"""WITH RECURSIVE {CLIMB}, ch AS (SELECT tree_id, parent_id, count(*) AS n, min(node_id) AS usual FROM sn WHERE parent_id IS NOT NULL GROUP BY ALL),
    odd AS (SELECT p.tree_id, leaf_id, string_agg(p.parent_id || '>' || p.node_id, chr(10) ORDER BY place) AS choices FROM paths p JOIN ch ON ch.tree_id = p.tree_id AND ch.parent_id = p.parent_id AND n > 1 AND p.node_id <> usual GROUP BY ALL)
    SELECT p.tree_id, CASE WHEN choices IS NULL THEN p.tree_id ELSE p.tree_id || '~branch-' || substr(sha256(choices), 1, 12) END AS branch_id, p.leaf_id, place, node_id FROM paths p LEFT JOIN odd ON odd.tree_id = p.tree_id AND odd.leaf_id = p.leaf_id""")
def tree_variants(spark, folder):
    return trees.variants(_small_trees(spark, folder))


@query("tree_topological", f"WITH RECURSIVE {SMALL}, d AS (SELECT tree_id, node_id, 0::BIGINT AS depth FROM sn WHERE parent_id IS NULL UNION ALL SELECT sn.tree_id, sn.node_id, depth + 1 FROM d JOIN sn ON sn.tree_id = d.tree_id AND sn.parent_id = d.node_id) SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY depth, node_id) - 1 AS place FROM d")
def tree_topological(spark, folder):
    return trees.topological(_small_trees(spark, folder))


@query("language_metrics_with_total", "WITH r AS (SELECT query_lang, item_id % 12 AS a, item_id % 9 AS b FROM eval_items) SELECT coalesce(query_lang, 'all') AS query_lang, count(*) AS cases, count(*) FILTER (WHERE b < a) AS improved, count(*) FILTER (WHERE b > a) AS worse FROM r GROUP BY ROLLUP (query_lang)")
def language_metrics_with_total(spark, folder):
    own = table(spark, folder, "eval_items").select("query_lang", (F.col("item_id") % 12).alias("before"), (F.col("item_id") % 9).alias("after"))
    return evaluate.changes_by(own, "query_lang", "before", "after")


@query("page_order", "SELECT artifact_id, string_agg(page_id::VARCHAR, ',' ORDER BY capture_sequence, page_id) AS pages, list(page_id ORDER BY page_id) FILTER (WHERE has_next_page) AS continued FROM payload_pages GROUP BY artifact_id")
def page_order(spark, folder):
    return audit.page_lists(table(spark, folder, "payload_pages"))

