import hashlib
import io
import json
import zipfile

import pytest

from stratalog.sources import artifacts, bundle, exports, ledger, strict_json
from stratalog.streaming import inbox, telemetry


def capture(pages, spoil=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        files = []
        for i, p in enumerate(pages):
            body = json.dumps(p).encode()
            files.append({"name": f"payload-{i:04}.json", "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest()})
            z.writestr(f"payload-{i:04}.json", body + b" " if spoil else body)
        z.writestr("manifest.json", json.dumps({"files": files}))
    return out.getvalue()


def page(*messages):
    return {"conversation_id": "c", "title": "T", "page_info": {"has_previous_page": False}, "messages": list(messages)}


def message(text, id=None, role="user", kind="text"):
    return {"id": id, "author": {"role": role}, "create_time": 1.0, "content": {"content_type": kind, "parts": [text], "text": text}}


def test_artifacts(spark, tmp_path):
    (tmp_path / "good.zip").write_bytes(capture([page(message("hi", "a"), message("anon"), message("rm", "k", "assistant", "code")), page(message("hi", "a"))]))
    (tmp_path / "bad.zip").write_bytes(capture([page(message("x"))], spoil=True))
    (tmp_path / "no.zip").write_bytes(b"nothing")
    rows = artifacts.read_artifacts(spark, str(tmp_path))
    assert rows.where("error is null").count() == 2 and rows.where("error is not null").count() == 2
    m = artifacts.page_messages(rows)
    assert {(r.text, r.search_class) for r in m.collect()} == {("hi", "dialogue"), ("anon", "dialogue"), ("rm", "trace")}
    own = {r.local_identity: r for r in artifacts.distinct_occurrences(m).collect()}
    assert own["id:a"].occurrences == 2 and len(own) == 3
    assert not any(map(artifacts.safe_member, ("../x", "/x", "a/../b", "", "a\\b")))


def test_exports(spark, tmp_path):
    tree = {"id": "t", "title": "x", "mapping": {"r": {"parent": None}, "a": {"parent": "r", "message": {"author": {"role": "user"}, "create_time": 2, "content": {"content_type": "text", "parts": ["q", {"image": 1}]}}}}}
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("conversations-1.json", json.dumps([tree]))
        z.writestr("conversations-0.json", json.dumps([tree | {"id": "s"}]))
    got = exports.read_export(spark, str(tmp_path / "e.zip"), "mapping").collect()
    assert [(r.tree_id, r.node_id, r.text) for r in got] == [("s", "r", ""), ("s", "a", "q"), ("t", "r", ""), ("t", "a", "q")]
    fragments = {"id": "t", "mapping": {"a": {"parent": None, "message": {"inserted_at": "2023-01-01T00:00:00Z", "fragments": [{"type": "THINK", "content": "no"}, {"type": "RESPONSE", "content": "yes"}]}}}}
    (tmp_path / "f.json").write_text(json.dumps([fragments]))
    row = exports.read_export(spark, str(tmp_path / "f.json"), "fragments").first()
    assert (row.role, row.text, row.create_time) == ("assistant", "yes", 1672531200.0)
    responses = {"conversations": [{"conversation": {"id": "t"}, "responses": [{"response": {"_id": "1", "sender": "human", "message": "m", "create_time": {"$date": {"$numberLong": "1500"}}}}]}]}
    (tmp_path / "r.json").write_text(json.dumps(responses))
    assert exports.read_export(spark, str(tmp_path / "r.json"), "responses").first().create_time == 1.5
    (tmp_path / "l.json").write_text(json.dumps([{"messages": [{"role": "user", "content": "a", "timestamp": "2023-01-01T00:00:00"}]}]))
    assert "offset" in exports.read_export(spark, str(tmp_path / "l.json"), "lines").first().error
    assert exports.html_turns("<p>User</p><p>hi</p><p>Gemini</p><p>yo<br>ho</p>") == [("user", "hi"), ("assistant", "yo\nho")]


def test_strict_json(spark, tmp_path):
    for bad in ('{"a":1,"a":2}', '{"a":NaN}', "{"):
        with pytest.raises(strict_json.InvalidJson):
            strict_json.loads(bad)
    (tmp_path / "x.jsonl").write_text('{"id":"a"}\n\n{"id":"b","x":1}\n{"id":"c"}\n{"id":"c"}\nno\n')
    got = strict_json.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id", ("id",)).collect()
    assert [r.id for r in got if r.error is None] == ["a"] and len(got) == 5


def test_bundles_are_the_same_bytes(spark, tmp_path):
    s = spark.createDataFrame([("s", 'a "q", b', "x", None, 2.5)], "session_id string, title string, coverage_state string, time_min double, time_max double")
    m = spark.createDataFrame([("s", 1, "m", "user", "dialogue", None, "line\none"), ("s", 0, "l", "user", "dialogue", 1.0, "")], "session_id string, ordinal int, message_id string, role string, search_class string, create_time double, text string")
    a, b = bundle.write_bundle(s, m, str(tmp_path / "a.zip")), bundle.write_bundle(s, m.orderBy("ordinal"), str(tmp_path / "b.zip"))
    assert a == b
    s2, m2 = bundle.read_bundle(spark, str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert s2.collect() == s.collect() and sorted(m2.collect()) == sorted(m.collect())
    with zipfile.ZipFile(tmp_path / "a.zip", "a") as z:
        z.writestr("more", "x")
    with pytest.raises(bundle.InvalidBundle):
        bundle.verify_bundle(str(tmp_path / "a.zip"))


def test_ledger(spark, tmp_path):
    entry = {"sha256": "ab", "accepted_at": "2023-01-01T00:00:00Z", "source_adapter": "x", "session_id": "s", "provider": "p"}
    assert ledger.append(str(tmp_path / "l"), entry) == "RECORDED" and ledger.append(str(tmp_path / "l"), entry) == "UNCHANGED"
    with pytest.raises(ledger.LedgerConflict):
        ledger.append(str(tmp_path / "l"), entry | {"provider": "q"})
    assert [(r.misnamed, r.copies) for r in ledger.read(spark, str(tmp_path / "l")).collect()] == [(False, 1)]
    e = spark.createDataFrame([("k", "e", "c1"), ("k", "e", "c1"), ("j", "e", "c1"), ("j", "e", "c2")], "request_key string, endpoint string, conversation_id string")
    m = spark.createDataFrame([("k", "e", "m1"), ("j", "e", "m2")], "request_key string, endpoint string, member string")
    assert [r.member for r in ledger.recovered(e, m, "c1").collect()] == ["m1"]


def test_inbox_takes_each_file_once(spark, tmp_path):
    box, book, bad, mark = (str(tmp_path / n) for n in ("box", "ledger", "bad", "mark"))
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "a.zip").write_bytes(capture([page(message("x"))]))
    (tmp_path / "box" / "b.zip").write_bytes(b"broken")
    check = lambda df: df.selectExpr("*", "CASE WHEN length < 20 THEN 'too small' END AS error")
    inbox.ingest(spark, box, book, bad, mark, check).awaitTermination()
    (tmp_path / "box" / "c.zip").write_bytes((tmp_path / "box" / "a.zip").read_bytes())
    inbox.ingest(spark, box, book, bad, mark, check).awaitTermination()
    assert spark.read.parquet(book).count() == 1 and spark.read.parquet(bad).count() == 1


def test_a_stream_of_events_counts_as_the_table_does(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp_seconds(1672531200 + id * 40) AS ts, id % 3 AS user_id, concat('t', id % 2) AS event_type, double(id) AS value FROM range(50)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = telemetry.events_per_window(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), late="1 hour")
    stream.writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, telemetry.events_per_window(rows).collect()))
