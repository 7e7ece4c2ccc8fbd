import math
import re

import pytest
from pyspark.sql import functions as F

from stratalog.functions.text import content_fp, finite, folded_words, html_to_text, iso_epoch, query_units, slug, text_of_html
from stratalog.operators import index, search
from stratalog.operators.search import InvalidSearch, Request

TEXTS = ["foo bar", "foo foo baz", "bar foo", "nothing here", "foo-bar joined", "Élan vital", "", None, "hidden foo", "bar"]


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(i, f"s{i % 3}", i, f"m{i}", "hidden" if t == "hidden foo" else "dialogue" if i % 2 else "evidence", None if i == 0 else float(i), t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "row_id bigint, session_id string, ordinal int, message_id string, search_class string, create_time double, text string")


def ids(df):
    return {r.row_id for r in df.collect()}


def test_units_make_phrases_of_joined_tokens():
    assert query_units("foo-bar baz_q - x") == [["foo", "bar"], ["baz", "q"], [], ["x"]]


def test_bm25_is_the_closed_form(spark, messages):
    docs = {i: re.findall(r"\w+", t) for i, t in enumerate(TEXTS) if t and t != "hidden foo"}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = sum("foo" in d for d in docs.values())
    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    got = {r.row_id: r.score for r in search.scored(messages, "foo").collect()}
    for i, d in docs.items():
        f = d.count("foo")
        if f:
            assert got[i] == pytest.approx(-idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / avg)), abs=1e-6)
    assert got.keys() == {i for i, d in docs.items() if "foo" in d}


def test_modes(messages):
    assert ids(search.scored(messages, "foo bar")) == {0, 2, 4}
    assert ids(search.scored(messages, "foo bar", "recall")) == {0, 1, 2, 4, 9}
    assert ids(search.scored(messages, "foo bar", "phrase")) == {0, 4}
    assert ids(search.scored(messages, "foo-bar")) == {0, 4}
    assert ids(search.scored(messages, "- foo")) == set()  # an empty phrase matches nothing
    assert ids(search.scored(messages, "- foo", "recall")) == {0, 1, 2, 4}


def test_a_repeated_token_counts_twice(messages):
    one = {r.row_id: r.score for r in search.scored(messages, "baz", "recall").collect()}
    two = {r.row_id: r.score for r in search.scored(messages, "baz baz", "recall").collect()}
    assert two[1] == pytest.approx(2 * one[1], abs=2e-6)


def test_filters_let_unknown_times_pass(messages):
    r = Request("foo", from_time=1.0, to_time=2.0, limit=10)
    assert ids(search.candidates(messages, r)) == {0, 1, 2}
    assert ids(search.before(messages, "foo", 2.0, 10)) == {1}
    assert ids(search.candidates(messages, Request("foo", scopes=("evidence",)))) == {0, 2, 4}


def test_request_checks():
    for bad in ({"query": " "}, {"query": "x", "limit": 0}, {"query": "x", "limit": 101}, {"query": "x", "mode": "odd"}, {"query": "x", "scopes": ()}, {"query": "x", "scopes": ("hidden",)}, {"query": "x", "from_time": 2.0, "to_time": 1.0}, {"query": "x", "budget": 301}, {"query": "x", "from_time": math.nan}, {"query": "y" * 513}):
        with pytest.raises(InvalidSearch):
            Request(**bad)
    assert Request("x", limit=10).budget == 30 and Request("x", limit=100).budget == 300


def test_cap_comes_before_the_budget(spark):
    rows = [(i, "long" if i < 6 else f"s{i}", i, None, "dialogue", None, "foo " * (10 - i)) for i in range(9)]
    m = spark.createDataFrame(rows, "row_id bigint, session_id string, ordinal int, message_id string, search_class string, create_time double, text string")
    found = search.candidates(m, Request("foo", "recall", limit=3, budget=4), cap=1).collect()
    assert len(found) == 4 and sum(r.session_id == "long" for r in found) == 1


def test_groups_keep_all_occurrences_in_rank_order(spark):
    rows = spark.createDataFrame([(1, "x", "a", 1), (2, "y", "b", 1), (3, "x", "c", 5)], "candidate_rank bigint, text string, session_id string, ordinal int")
    a, b = search.exact_groups(rows).collect()
    assert (a.text, a.occurrence_count, [o.session_id for o in a.occurrences], a.representative.session_id) == ("x", 2, ["a", "c"], "a")
    assert b.group_rank == 2


def test_rerank_takes_sessions_in_turns(spark):
    rows = [(1, "one", 1, "dialogue", -5.0, "foo"), (2, "one", 2, "dialogue", -4.0, "foo"), (3, "two", 1, "evidence", -1.0, "foo bar"), (4, "two", 2, "evidence", -0.5, "bár")]
    m = spark.createDataFrame(rows, "row_id bigint, session_id string, ordinal int, search_class string, score double, text string")
    got = search.rerank(m, "foo bar", 10).orderBy("result_rank").collect()
    assert [r.row_id for r in got] == [3, 1, 4, 2]


def test_auto_turns_to_recall_only_without_hits(messages):
    assert search.search(messages, Request("foo nothing", "auto")).status == "FOUND"
    assert search.search(messages, Request("absent", "auto")).status == "NO_SIGNAL"


def test_an_index_answers_as_a_scan_does(spark, messages, tmp_path):
    path = f"file://{tmp_path}/index"
    own = search.indexable(messages)
    index.build_index(own, path)
    again = index.Index(spark, path)  # as another process would open it
    for q, mode in (("foo", "strict"), ("foo bar", "strict"), ("foo bar", "recall"), ("foo-bar", "strict"), ("foo bar", "phrase"), ("absent", "strict"), ("- foo", "recall"), ("- foo", "strict")):
        got = {r.row_id: r.score for r in again.scored(q, mode).collect()}
        want = {r.row_id: r.score for r in search.scored(messages, q, mode).collect()}
        assert got == pytest.approx(want), q
    r = Request("foo bar", "recall", limit=5)
    assert again.candidates(r).select(*messages.columns, "score", "candidate_rank").collect() == search.candidates(messages, r).select(*messages.columns, "score", "candidate_rank").collect()
    assert index.verify_index(again, own) and not index.verify_index(again, own.where("row_id <> 0"))


def test_an_index_of_no_rows(spark, messages, tmp_path):
    own = index.build_index(messages.where("row_id < 0"), f"file://{tmp_path}/index")
    assert own.n_docs == 0 and own.scored("foo bar").count() == 0 and own.candidates(Request("foo")).count() == 0
    with pytest.raises(FileNotFoundError):
        index.Index(spark, f"file://{tmp_path}/none")


def test_text_functions(spark):
    assert folded_words("STRASSE Straße Élan") == ["strasse", "strasse", "elan"]
    assert text_of_html("<p>a &amp; b</p><ul><li>x<li>y</ul><pre>k  l</pre><script>no</script>") == "a & b\n\n- x\n- y\n\nk  l"
    row = spark.createDataFrame([("2023-01-01T00:00:01.5+01:00", " A  b ", "a b/c")], "t string, x string, f string").select(iso_epoch(F.col("t")).alias("t"), content_fp(F.col("x")).alias("x"), slug(F.col("f")).alias("f"), html_to_text(F.lit("<b>q</b>")).alias("h")).first()
    assert row.t == 1672527601.5 and row.f == "a-b-c" and row.h == "q"
    nums = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double").select(finite(F.col("v")).alias("f"))
    assert [r.f for r in nums.collect()] == [True, False, False, False]
