import json

import pytest
from pyspark.sql import functions as F

from stratalog import cli, shared
from stratalog.operators import browse, feedback, ingest
from stratalog.operators import search as s
from stratalog.operators.index import build_index
from stratalog.operators.reconcile import reconciled_search
from stratalog.sources import strict_json
from stratalog.streaming import telemetry

OCC = "sha256 string, accepted_at string, session_id string, local_identity string, create_time double, provider_order bigint, digest string"


def occ(sha, session, *ids, digest="d"):
    return [(sha, "2023-01-01", session, i, 1.0, 1, digest) for i in ids]


def test_ingest_sets_bad_artifacts_aside_and_goes_on(spark, tmp_path):
    root = f"file://{tmp_path}/corpus"
    c = ingest.Corpus(spark, root)
    assert c.status().first().artifacts == 0
    first = spark.createDataFrame(occ("a", "s", "1", "2") + occ("b", "t", "1"), OCC)
    r = c.ingest(first, expected=2)
    assert (r["state"], r["accepted"], r["messages"], r["sessions"]) == ("COMPLETE", 2, 3, 2)
    assert c.ingest(first)["state"] == "UNCHANGED" and c.version == 2
    again = ingest.Corpus(spark, root)  # as another process would open it
    more = spark.createDataFrame(occ("c", "s", "2", "3") + occ("d", "s", "2", digest="other") + occ("e", "u", "9") + occ("e", "u", "9", digest="x"), OCC)
    r = again.ingest(more)
    assert (r["state"], r["accepted"], r["rejected"], r["messages"]) == ("DEGRADED", 1, 2, 4)
    assert again.rebuild_gap().count() == 0 and [x.state for x in again.receipts().orderBy("version").collect()] == ["COMPLETE", "UNCHANGED", "DEGRADED"]
    assert {(x.session_id, x.local_identity): x.artifacts for x in again.messages().collect()} == {("s", "1"): 1, ("s", "2"): 2, ("s", "3"): 1, ("t", "1"): 1}
    with pytest.raises(ValueError):
        again.ingest(more, expected=1)
    with pytest.raises(RuntimeError):
        c.ingest(more)  # its version has been taken
    assert ingest.Corpus(spark, f"file://{tmp_path}/none").ingest(first.where("false"))["state"] == "UNCHANGED"


def test_decisions_and_pins(spark, tmp_path):
    log = spark.createDataFrame([(1, "accept"), (1, "accept"), (2, "accept"), (2, "reject"), (3, "accept"), (4, "reject"), (5, "accept")], "id int, decision string")
    assert [(r.id, r.place) for r in ingest.freeze(log, "id", "decision", ["id"], 2).collect()] == [(1, 1), (3, 2)]
    assert [r.id for r in ingest.decision_conflicts(log, "id", "decision").collect()] == [2]
    at = f"file://{tmp_path}/t"
    spark.range(3).coalesce(1).write.parquet(at)
    pinned = ingest.pin(spark, at, "v1")
    ingest.resolve_pin(spark, at, pinned)
    spark.range(1).coalesce(1).write.mode("append").parquet(at)
    with pytest.raises(ValueError):
        ingest.resolve_pin(spark, at, pinned)


def test_reconciled_states(spark, tmp_path):
    rows = [(i, "s", i, f"m{i}", f"id:m{i}", "dialogue", float(i), t) for i, t in enumerate(["old ledger page", "ledger only", "new archive", "archive of old things"])]
    m = spark.createDataFrame(rows, "row_id bigint, session_id string, ordinal int, message_id string, local_identity string, search_class string, create_time double, text string")
    index = build_index(m, f"file://{tmp_path}/index")
    concepts = spark.createDataFrame([("c1", "New Archive", ["fresh store", "twin"]), ("c2", "Twin", None)], "concept_id string, preferred_label string, aliases array<string>")

    def go(q, recall=False):
        r = reconciled_search(index, concepts, s.Request(q, limit=5), recall)
        return r.state, r.eligibility, [(x.row_id, x.retrieval_basis) for x in r.rows.orderBy("position").collect()]

    assert go("old ledger") == ("DIRECT_LEXICAL", "LEXICAL_EVIDENCE_ELIGIBLE", [(0, "DIRECT_LEXICAL")])
    state, eligibility, got = go("old ledger", True)
    assert (state, eligibility, got[0]) == ("DIRECT_WITH_RECALL_CANDIDATES", "MIXED", (0, "DIRECT_LEXICAL")) and {x for x, _ in got[1:]} == {1, 3}
    assert go(" Fresh  store") == ("RECONCILED_CANDIDATE", "CANDIDATE_ONLY", [(2, "CONTROLLED_ALIAS_EXPANSION")])
    assert go("twin") == ("AMBIGUOUS_CONCEPT", "AMBIGUOUS", [])
    assert go("absent ledger", True)[0] == "RECALL_CANDIDATE" and go("absent") == ("UNKNOWN", "UNKNOWN", [])


def test_local_pages_by_bytes(spark):
    text = "é" * 30 + "🙂" * 5
    rows = [(i, "s", i, f"m{i}", f"id:{i}", "user", "dialogue", t) for i, t in enumerate(["ab", text, "", "end"])]
    m = spark.createDataFrame(rows, "row_id bigint, session_id string, ordinal int, message_id string, local_identity string, role string, search_class string, text string")
    seen, cursor = "", None
    for _ in range(20):
        page = browse.local_page(m, "stamp", "s", limit=3, max_chars=7, cursor=cursor)
        assert sum(len(x["text"]) for x in page["messages"]) <= 7
        seen += "".join(x["text"] for x in page["messages"])
        cursor = page["next_cursor"]
        if not page["has_more"]:
            break
    assert seen == "ab" + text + "end" and cursor is None
    cursor = browse.local_page(m, "stamp", "s", limit=1)["next_cursor"]
    for bad in (dict(stamp="changed", session_id="s", cursor=cursor), dict(stamp="stamp", session_id="t", cursor=cursor), dict(stamp="stamp", session_id="s", cursor="!"), dict(stamp="stamp", session_id="s", limit=0), dict(stamp="stamp", session_id="s", cursor=cursor, start_ordinal=1)):
        with pytest.raises(browse.InvalidPage):
            browse.local_page(m, **bad)
    assert browse.local_page(m, "stamp", "none")["messages"] == []


def test_answers_of_others_are_checked():
    row = lambda o, i, t, off=0, n=None: {"ordinal": o, "message_id": i, "text": t, "text_offset": off, "text_total_chars": off + len(t) if n is None else n, "complete_message": n is None}
    P = browse.Position
    ok = [row(0, "a", "xx"), row(1, "b", "yy", n=9)]
    assert browse.page_fault(ok, None, 5, 10, True, P(1, "b", 2)) is None
    assert browse.page_fault([row(1, "b", "yyyyyyy", off=2)], P(1, "b", 2), 5, 10, False, None) is None
    assert browse.page_fault(ok, None, 1, 10, True, P(1, "b", 2)) == "TOO_MANY_ROWS"
    assert browse.page_fault(ok, None, 5, 3, True, P(1, "b", 2)) == "PAYLOAD_INVALID"
    assert browse.page_fault(ok, None, 5, 10, False, None) == "PAYLOAD_INVALID"
    assert browse.page_fault(ok, None, 5, 10, True, P(1, "b", 0)) == "NOT_ADVANCING"
    assert browse.page_fault(ok[::-1], None, 5, 10, True, P(0, "a")) == "PAYLOAD_INVALID"
    assert browse.page_fault([row(1, "b", "y"), row(0, "a", "x")], None, 5, 10, False, None) == "NOT_ADVANCING"
    assert browse.page_fault([], None, 5, 10, True, P(1)) == "NOT_ADVANCING"
    assert browse.blocked("s", "c", "STALE")["status"] == "BLOCKED"


def test_feedback_is_read_by_its_reference(spark, tmp_path):
    store, body = f"file://{tmp_path}/feedback", {"outcome": "same", "n": 1}
    ref = feedback.feedback_ref(body)
    assert feedback.read_feedback(spark, store, ref) is None
    feedback.append_new(spark.createDataFrame([(ref, json.dumps(body)), ("0" * 32, json.dumps(body))], "feedback_ref string, payload string"), store)
    assert feedback.read_feedback(spark, store, ref) == body and feedback.read_feedback(spark, store, "f" * 32) is None
    with pytest.raises(ValueError):
        feedback.read_feedback(spark, store, "0" * 32)


def test_banned_keys_at_any_depth(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "b": [{"c": {"text": 1}}]}\n{"id": "b", "b": []}\n')
    got = {r.body[8]: r.error for r in strict_json.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "id", banned=("text",)).collect()}
    assert got["b"] is None and "text" in got["a"]


def test_events_that_are_not_kept(spark):
    rules = {"seen": {"route": (True, lambda v: v.isin("a", "b")), "n": (False, telemetry.counted(5))}, "ping": {}}
    rows = [("seen", '{"route":"a"}'), ("seen", '{"route":"c"}'), ("seen", '{"n":"1"}'), ("seen", '{"route":"b","n":6}'), ("seen", '{"route":"b","x":1}'), ("ping", "{}"), ("other", "{}"), (None, "{}"), ("ping", "no")]
    got = [r.fault for r in telemetry.sanitized(spark.createDataFrame(rows, "event_type string, props string"), rules).collect()]
    assert got == [None, "bad route", "no route", "bad n", "unknown field", None, "unknown event", "unknown event", "no object"]
    assert [r.c for r in spark.createDataFrame([(204,), (404,), (503,), (301,), (None,)], "s int").select(telemetry.status_class(F.col("s")).alias("c")).collect()] == ["2xx", "4xx", "5xx", "other", "unknown"]


def test_small_files_appear_once(spark, tmp_path):
    at = f"file://{tmp_path}/deep/x.json"
    assert shared.read_text(spark, at) is None and shared.write_text(spark, at, "é1")
    assert not shared.write_text(spark, at, "2") and shared.read_text(spark, at) == "é1"
    assert shared.write_text(spark, at, "3", replace=True) and shared.read_text(spark, at) == "3"
    assert [n for n in shared.children(spark, f"file://{tmp_path}/deep") if not n.startswith(".")] == ["x.json"]


def test_the_command_line(spark, tmp_path):
    rows = [(i, "s", i, f"m{i}", f"id:{i}", "user", "dialogue", None, t) for i, t in enumerate(["old ledger", "old ledger", "new page"])]
    m = spark.createDataFrame(rows, "row_id bigint, session_id string, ordinal int, message_id string, local_identity string, role string, search_class string, create_time double, text string")
    m.write.parquet(f"file://{tmp_path}/messages.parquet")
    go = lambda *argv: [json.loads(x) for x in cli.answer(spark, argv)]
    folder = f"file://{tmp_path}"
    head, *groups = go("search", folder, "ledger")
    assert head["status"] == "FOUND" and [g["occurrence_count"] for g in groups] == [2]
    assert go("search", folder, "absent")[0]["status"] == "NO_SIGNAL" and "error" in go("search", folder, "  ")[0]
    page = go("page", folder, "s", "--limit", "2")[0]
    assert [x["text"] for x in page["messages"]] == ["old ledger"] * 2
    assert go("page", folder, "s", "--cursor", page["next_cursor"])[0]["messages"][0]["text"] == "new page"
    m.write.mode("append").parquet(f"{folder}/messages.parquet")
    assert go("page", folder, "s", "--cursor", page["next_cursor"]) == [{"error": "the cursor is stale"}]
    assert go("run", folder, "no such query") == [{"error": "no query no such query"}]
