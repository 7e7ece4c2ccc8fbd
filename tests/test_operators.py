import hashlib

import pytest
from pyspark.sql import functions as F

from stratalog.functions.digest import canonical_json, set_digest, table_digest
from stratalog.operators import allocate, audit, browse, corpus, evaluate, federate, feedback, generations, trees
from stratalog.plans import corpus_queries


def test_set_digest_and_table_digest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "x string")
    assert df.agg(set_digest(F.col("x"))).first()[0] == hashlib.sha256(b"a\nb\n").hexdigest()
    assert df.where("false").agg(set_digest(F.col("x"))).first()[0] == hashlib.sha256(b"").hexdigest()
    assert table_digest(df, ["x"]).collect() == table_digest(df.orderBy(F.desc("x")), ["x"]).collect()
    assert table_digest(df, ["x"]).first().digest != table_digest(df.distinct(), ["x"]).first().digest
    assert canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_select_shards_keeps_unknown_bounds(spark):
    shards = spark.createDataFrame([("b", "p", ["s"], 1.0, 2.0), ("a", "p", None, None, None), ("c", "q", ["t"], 5.0, 9.0)], "shard_id string, provider string, session_ids array<string>, time_min double, time_max double")
    got = lambda **k: [r.shard_id for r in federate.select_shards(shards, **k).collect()]
    assert got() == ["a", "b", "c"] and got(provider="q") == ["c"] and got(session="t") == ["a", "c"] and got(from_time=3.0) == ["a", "c"] and got(to_time=0.5) == ["a"]
    assert [r.truncated for r in federate.listing(shards, 2).collect()] == [True, True]


def test_merge_and_status(spark):
    hits = spark.createDataFrame([("a", 1, "s", 0, 1, "t", None), ("b", 1, "r", 0, 2, "t", None), ("a", 2, "s", 1, 3, "u", None)], "shard_id string, shard_rank bigint, session_id string, ordinal int, row_id bigint, text string, message_id string")
    assert [r.row_id for r in federate.merge_flat(hits, 2).orderBy("result_rank").collect()] == [1, 2]
    first = federate.merge_groups(hits, 5).orderBy("group_rank").first()
    assert first.text == "t" and [o.shard_id for o in first.occurrences] == ["a", "b"]
    status = lambda rows: federate.merge_status(spark.createDataFrame(rows, "shard_id string, ok boolean, results bigint")).first().status
    assert status([("a", True, 0)]) == "NO_SIGNAL" and status([("a", True, 2)]) == "FOUND" and status([("a", True, 2), ("b", False, None)]) == "PARTIAL" and status([]) == "NO_SIGNAL"


def test_watermarks(spark):
    shards = spark.createDataFrame([("p", 10.0, "verified", "x"), ("p", 10.0, "verified", "x"), ("q", 10.0, "verified", "x"), ("q", 11.0, "verified", "x"), ("r", 1.0, "verified", "x")], "provider string, observed_through double, watermark_status string, accepted_set_sha256 string")
    assert {r.provider: r.currentness for r in federate.source_currentness(shards, 12.0, 5.0).collect()} == {"p": "verified", "q": "unknown", "r": "stale"}
    with pytest.raises(ValueError):
        federate.overlay_watermarks(shards.select("provider"), spark.createDataFrame([("z",)], "provider string"))


def test_corpus_rules(spark):
    rows = spark.createDataFrame([("s", "id:a", "d1", 2.0, 1, 1), ("s", "id:a", "d2", 1.0, 5, 2), ("s", "id:b", "d", None, None, 3)], "session_id string, local_identity string, canonical_message_sha256 string, create_time double, provider_order bigint, row_id bigint")
    merged = {r.local_identity: r for r in corpus.merge_messages(rows).collect()}
    assert (merged["id:a"].create_time, merged["id:a"].provider_order, merged["id:a"].digests) == (1.0, 5, 2)
    with pytest.raises(ValueError):
        corpus.assert_none(corpus.conflicts(corpus.merge_messages(rows)), "conflict")
    assert {r.local_identity: r.ordinal for r in corpus.ordinals(corpus.merge_messages(rows)).collect()} == {"id:a": 0, "id:b": 1}


def test_titles_and_coverage_of_sessions_without_anything(spark):
    sessions = spark.createDataFrame([("s",), ("t",)], "session_id string")
    artifacts = spark.createDataFrame([(1, "s", "b", None, "late"), (2, "s", "c", 5.0, "x"), (3, "s", "a", 5.0, "y")], "artifact_id bigint, session_id string, sha256 string, observed_max_time double, observed_title string")
    assert {r.session_id: r.title for r in corpus.chosen_titles(sessions, artifacts).collect()} == {"s": "y", "t": ""}
    messages = spark.createDataFrame([], "session_id string, row_id bigint")
    paths = spark.createDataFrame([], "session_id string, row_id bigint, artifact_id bigint")
    full = artifacts.withColumn("coverage_state", F.when(F.col("artifact_id") == 1, corpus.COMPLETE).otherwise(corpus.PARTIAL))
    assert {r.session_id: r.coverage_state for r in corpus.complete_sessions(sessions, messages, paths, full).collect()} == {"s": corpus.COMPLETE, "t": corpus.PARTIAL}


def test_routing_needs_exactly_one_branch(spark):
    branches = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1"), ("y", "3")], "branch_id string, item string")
    members = spark.createDataFrame([(1, "1"), (1, "2"), (2, "1"), (3, "2"), (3, "3")], "artifact_id bigint, item string")
    got = {r.artifact_id: (r.branch_id, r.route_state) for r in corpus.routed(members.select("artifact_id").distinct(), members, branches).collect()}
    assert got == {1: ("x", "BRANCH_MATCH"), 2: (None, "UNRESOLVED"), 3: (None, "UNRESOLVED")}


def test_audits(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int")
    o = audit.overlap(a, b, "k").first()
    assert (o.authority, o.candidate, o.common, o.state) == (2, 2, 1, "PARTIAL")
    assert audit.overlap(a, b.where("false"), "k").first().state == "EMPTY"
    assert sorted((r.k, r.side) for r in audit.membership_gap(a, b, "k").collect()) == [(1, "left"), (3, "right")]
    assert audit.symmetric_difference(a, b).count() == 3
    left = spark.createDataFrame([("x", None), ("y", "1")], "k string, p string")
    right = spark.createDataFrame([("x", None), ("y", "2")], "k string, p string")
    assert [r.k for r in audit.conflicting(left, right, "k", "p").collect()] == ["y"]
    assert [r.holds for r in audit.verify([("none", a.where("false")), ("some", a)]).orderBy("step").collect()] == [True, False]


def test_fusion_metrics_and_selection(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank bigint")
    two = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank bigint")
    assert [r.id for r in evaluate.fuse_rrf(one, two, ["id"]).orderBy("fused_rank").collect()] == ["b", "a", "c"]
    ranks = spark.createDataFrame([(1, 1), (2, None), (3, 4)], "case_id int, target_rank bigint")
    m = evaluate.retrieval_metrics(ranks).first()
    assert (m.cases, m.r_at_1, m.r_at_5, m.mrr) == (3, 0.333333, 0.666667, 0.416667)
    better = spark.createDataFrame([(1, 2), (2, 9), (3, 4)], "case_id int, target_rank bigint")
    assert tuple(evaluate.compare(ranks, better).first()) == (1, 1, 1, 0)
    texts = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"])], "rank bigint, words array<string>")
    assert [r["rank"] for r in evaluate.mmr_select(texts, 3, 0.5).orderBy("mmr_rank").collect()] == [1, 3, 2]
    places = spark.createDataFrame([([0, 7], [2, 8]), ([0], []), ([1, 2], [5])], "a array<int>, b array<int>")
    density = [r.d for r in places.select(evaluate.cover_density([F.col("a"), F.col("b")]).alias("d")).collect()]
    assert density == [pytest.approx(0.1 / 2 + 0.1 / 5 + 0.1), 0.0, pytest.approx(0.1 / 3)]  # covers 0-2, 2-7, 7-8; none; 2-5
    assert [r.d for r in places.select(evaluate.cover_density([F.col("a"), F.col("b")], every=False).alias("d")).collect()] == pytest.approx([0.4, 0.1, 0.3])
    with pytest.raises(Exception, match="twice"):
        evaluate.fuse_rrf(one.union(one), two, ["id"]).collect()
    values = spark.createDataFrame([("x", float(v)) for v in range(40)] + [("y", 3.0), ("y", None)], "k string, v double")
    got = {r.k: r for r in evaluate.percentiles(values, "v", ["k"]).collect()}
    assert (got["x"].p95_at, got["x"].n, got["y"].p95_at, got["y"].n) == (38.0, 40, 3.0, 1)


def test_a_chain_of_fifty_thousand(spark):
    nodes = spark.range(50_000).select(F.lit("t").alias("tree_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    row = trees.depths(nodes).agg(F.max("depth").alias("d"), F.count_if(F.col("root_id") == 0).alias("n")).first()
    assert (row.d, row.n) == (49_999, 50_000)


def test_variants_of_a_tree(spark):
    rows = [("t", "r", None, 0.0), ("t", "a", "r", 1.0), ("t", "b", "r", 2.0), ("t", "c", "a", 3.0), ("t", "x", "y", 1.0), ("t", "y", "x", 1.0)]
    nodes = spark.createDataFrame(rows, "tree_id string, node_id string, parent_id string, create_time double")
    got = {}
    for r in trees.variants(nodes).collect():
        got.setdefault((r.leaf_id, r.branch_id.startswith("t~branch-")), {})[r.place] = r.node_id
    assert got == {("c", False): {0: "r", 1: "a", 2: "c"}, ("b", True): {0: "r", 1: "b"}}  # a cycle has no path
    assert {r.node_id: r.place for r in trees.topological(nodes).collect()} == {"r": 0, "a": 1, "b": 2, "c": 3}


def test_planner_keeps_glue_only_if_there_is_nothing_else(spark):
    rows = spark.createDataFrame([(1, "the", 0, 1.0, "glue"), (1, "ab1", 1, 2.0, "identifier"), (2, "the", 0, 1.0, "glue")], "query_id int, token string, ordinal bigint, idf double, kind string")
    assert sorted((r.query_id, r.token) for r in evaluate.plan_sparse_view(rows).collect()) == [(1, "ab1"), (2, "the")]
    assert {r.query_id: r.view for r in evaluate.select_view(rows).collect()} == {1: "sparse", 2: "sparse"}


def test_pages_go_on_inside_a_long_message(spark):
    rows = [("s", i, f"m{i}", f"id:m{i}", "user", "dialogue", t) for i, t in enumerate(["short", "x" * 25, "", "end"])]
    m = spark.createDataFrame(rows, "session_id string, ordinal int, message_id string, local_identity string, role string, search_class string, text string")
    seen, position = "", None
    for _ in range(10):
        page = browse.read_page(m, "s", position, limit=2, max_chars=10)
        nxt = browse.next_position(page)
        if nxt is None:
            break
        seen += "".join(r.text for r in page.orderBy("ordinal").collect())
        position = browse.Position.decode(nxt.encode())
    assert seen == "short" + "x" * 25 + "end"
    for bad in ("", "!!", browse.Position(0).encode()[:-3], "eyJ2IjoyfQ"):
        with pytest.raises(browse.InvalidPage):
            browse.Position.decode(bad)


def test_allocation_never_reopens_a_shard(spark):
    rows = [("p", "a", "1", 60), ("p", "b", "2", 60), ("p", "c", "3", 30), ("p", "d", "4", 150), ("p", "e", "5", 10)]
    df = spark.createDataFrame(rows, "provider string, session_id string, first_accepted_at string, size bigint")
    assert {r.session_id: r.shard for r in allocate.allocate(df, 100, 200).collect()} == {"a": 1, "b": 2, "c": 2, "d": 3, "e": 4}
    with pytest.raises(ValueError):
        allocate.allocate(df, 100, 140)


def test_allocation_keeps_sessions_above_the_hard_limit(spark):
    rows = [("p", "a", "1", 60), ("p", "b", "2", 30), ("p", "c", "3", 150), ("p", "d", None, 10), ("q", "e", "5", 170)]
    df = spark.createDataFrame(rows, "provider string, session_id string, first_accepted_at string, size bigint")
    with pytest.warns(UserWarning, match="larger than any shard"):
        got = allocate.allocate(df, 100, 140, keep_over=True)
    assert {r.session_id: r.shard for r in got.collect()} == {"a": 1, "b": 1, "c": 2, "d": 3, "e": 1}
    assert {(r.provider, r.shard): (r.sessions, r.size, r.headroom_tenths) for r in allocate.allocation_summary(got, 100).collect()} == {("p", 1): (2, 90, 100), ("p", 2): (1, 150, 0), ("p", 3): (1, 10, 900), ("q", 1): (1, 170, 0)}


@pytest.mark.parametrize("query", ["shard_allocation", "shard_summary"])
def test_allocation_queries_keep_sessions_above_the_hard_limit(spark, monkeypatch, query):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(corpus_queries, "HARD", corpus_queries.TARGET)
    monkeypatch.setattr(allocate, "BYTES_PER_MESSAGE", 1_000_000)
    with pytest.warns(UserWarning, match="larger than any shard"):
        got = corpus_queries.QUERIES[query](spark, folder).collect()
    assert max(r["size"] for r in got) > corpus_queries.HARD
    assert sum(r["sessions"] if "sessions" in r else 1 for r in got) == spark.read.parquet(f"{folder}/sessions.parquet").count()


def test_shard_summary_equals_its_sql_with_a_session_above_the_hard_limit(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    n = corpus_queries.HARD // allocate.BYTES_PER_MESSAGE + 1
    tables = {
        "sessions": spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", None), ("f", "1"), ("g", None)], "session_id string, first_accepted_at string"),
        "artifacts": spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate([*((s, "p") for s in "abcde"), ("f", "q"), ("a", "q")])], "artifact_id bigint, session_id string, source_adapter string"),
        "messages": spark.range(n + 10).selectExpr(f"if(id < {n}, 'c', substr('abdef', int(id) % 5 + 1, 1)) AS session_id", "if(id % 5 = 4, 'hidden', 'dialogue') AS search_class", "'x\u00e9' AS text").union(spark.range(n // 4 + 1).selectExpr("'c'", "'dialogue'", "'x'")),
    }
    db = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    with pytest.warns(UserWarning, match="session c is larger than any shard"):
        got = corpus_queries.QUERIES["shard_summary"](spark, str(tmp_path)).select("provider", "shard", "sessions", "size", "headroom_tenths").collect()
    assert max(r["size"] for r in got) > corpus_queries.HARD
    assert sum(r["sessions"] for r in got) == 7
    assert sorted(map(tuple, got)) == sorted(db.execute(f"SELECT provider, shard, sessions, size, headroom_tenths FROM ({corpus_queries.ORACLE['shard_summary']})").fetchall())


def nodes(spark, rows):
    return spark.createDataFrame(rows, "tree_id string, node_id string, parent_id string, create_time double")


def test_trees(spark):
    n = nodes(spark, [("t", "r", None, 0.0), ("t", "a", "r", 1.0), ("t", "b", "r", 2.0), ("t", "c", "a", 3.0), ("u", "x", "y", 0.0), ("u", "y", "x", 0.0), ("w", "q", "gone", 0.0), ("w", "p", None, 0.0)])
    assert {(r.tree_id, r.node_id) for r in trees.leaves(n).collect()} == {("t", "b"), ("t", "c"), ("w", "q"), ("w", "p")}
    assert {(r.tree_id, r.node_id): (r.root_id, r.depth) for r in trees.depths(n, deepest=16).collect()} == {("t", "r"): ("r", 0), ("t", "a"): ("r", 1), ("t", "b"): ("r", 1), ("t", "c"): ("r", 2), ("u", "x"): (None, None), ("u", "y"): (None, None), ("w", "q"): (None, None), ("w", "p"): ("p", 0)}
    one = n.where("tree_id = 't'")
    paths = trees.leaf_paths(one)
    assert sorted((r.leaf_id, r.place, r.node_id) for r in paths.collect()) == [("b", 0, "r"), ("b", 1, "b"), ("c", 0, "r"), ("c", 1, "a"), ("c", 2, "c")]
    ids = {r.leaf_id: r.branch_id for r in trees.branch_ids(paths, one).collect()}
    assert ids["c"] == "t" and ids["b"].startswith("t~branch-") and len(ids["b"]) == len("t~branch-") + 12
    assert [(r.parent_id, r.child_id, r.tied) for r in trees.default_children(one).where("children > 1").collect()] == [("r", "a", 1)]


def test_depths_of_a_long_path_beside_a_cycle(spark):
    n = 33_000
    path = spark.range(n).selectExpr("'t' AS tree_id", "string(id) AS node_id", "string(if(id = 0, null, id - 1)) AS parent_id", "0D AS create_time")
    ring = spark.range(3).selectExpr("'u'", "string(id)", "string((id + 1) % 3)", "0D")
    got = {(r.tree_id, r.node_id): (r.root_id, r.depth) for r in trees.depths(path.union(ring)).collect()}
    assert got == {("t", str(i)): ("0", i) for i in range(n)} | {("u", str(i)): (None, None) for i in range(3)}


def test_inferences_resolve_in_rounds(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "node_id string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "e"), ("e", "d")], "node_id string, source_id string")
    assert {r.node_id: r["round"] for r in trees.resolve(n, needs).collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None}


def test_feedback(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "x"), ("r1", "x"), ("r2", "y")], "feedback_ref string, payload string")
    store = f"{tmp_path}/store"
    assert {r.feedback_ref: r.status for r in feedback.append_new(rows, store).collect()} == {"r1": "RECORDED", "r2": "RECORDED"}
    assert {r.status for r in feedback.append_new(rows, store).collect()} == {"UNCHANGED"}
    assert spark.read.parquet(store).count() == 2
    other = spark.createDataFrame([("r2", "y"), ("r3", "z")], "feedback_ref string, payload string")
    assert {(r.feedback_ref, r.missing_in) for r in feedback.reconcile(rows, other).collect()} == {("r1", "right"), ("r3", "left")}
    with pytest.raises(ValueError):
        feedback.reconcile(rows, other.withColumn("payload", F.lit("q")))
    assert feedback.feedback_ref({"b": 1, "a": 2}) == feedback.feedback_ref({"a": 2, "b": 1})
    concepts = spark.createDataFrame([("c1", "Old  Ledger", ["OL"]), ("c2", "x", ["old ledger"])], "concept_id string, preferred_label string, aliases array<string>")
    got = feedback.matching_concepts(concepts, spark.createDataFrame([(" old ledger",), ("ol",)], "query string")).collect()
    assert sorted((r["query"], r.concept_id) for r in got) == [(" old ledger", "c1"), (" old ledger", "c2"), ("ol", "c1")]
    assert [feedback.decision(2, 1, 1, 1), feedback.decision(1, 1, 0, 1), feedback.decision(1, 0, 1, 1), feedback.decision(0, 0, 1, 0), feedback.decision(0, 0, 0, 0)] == ["AMBIGUOUS", "DIRECT", "ALIAS", "RECALL", "UNKNOWN"]


def test_generations(spark, tmp_path):
    store = generations.Store(spark, str(tmp_path / "g"))
    s, m = spark.range(2), spark.range(3)
    g = generations.generation_id("m")
    assert store.classify(g, "m") == "absent"
    store.load(g, s, m, "m")
    assert store.classify(g, "m") == "building" and store.classify(g, "other") == "mismatch"
    for bad in (lambda: store.activate(g, None), lambda: store.mark_ready(g, "m", 2, 4), lambda: store.load(g, s, m, "m"), lambda: store.pinned(g)):
        with pytest.raises(generations.GenerationError):
            bad()
    store.mark_ready(g, "m", 2, 3)
    with pytest.raises(generations.GenerationError):
        store.activate(g, "another")
    store.activate(g, None)
    assert store.active() == g and store.status().first().active and store.pinned(g)[1].count() == 3
