import random

import pytest
from pyspark.sql import functions as F

from stratalog.llm.topn import best_messages, top_n_per_group
from stratalog.operators import skew


def brute(rows, n):
    by = {}
    for r in rows:
        if r[2] is not None and r[2] == r[2]:
            by.setdefault(r[:2], []).append(r)
    far = 2**63 - 1
    return [x for g in by.values() for x in sorted(g, key=lambda r: (-r[2], far if r[3] is None else r[3], far if r[4] is None else r[4]))[:n]]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_against_brute_force_with_ties_nulls_and_a_hot_group(spark, monkeypatch, broadcast):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast)
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice(["x", "y", None]), r.choice([None, float("nan"), float("inf"), 1.0, 2.0, 2.0, r.random()]), r.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, h string, score double, ordinal int, id bigint").repartition(5)
    for n in (1, 3, 20):
        got = [tuple(x) for x in top_n_per_group(df, ["g", "h"], "score", ["ordinal", "id"], n, bins=4).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, n)))


def test_repeated_rows_clashing_columns_and_nothing(spark):
    df = spark.createDataFrame([("a", 1.0, 1, "p")] * 5 + [("a", 1.0, 1, "q")], "rank string, score double, lo int, cut string")
    assert sorted(tuple(x) for x in top_n_per_group(df, ["rank"], "score", ["lo"], 3).collect()) == [("a", 1.0, 1, "p")] * 3
    assert top_n_per_group(df.where("false"), ["rank"], "score", ["lo"], 3).collect() == []


def test_the_latest_score_of_the_first_row_counts(spark):
    m = spark.createDataFrame([(1, "s", 0, "i", "dialogue"), (2, "s", 0, "i", "dialogue"), (3, "s", 1, "j", "dialogue"), (4, "s", 2, "k", "hidden")], "row_id bigint, session_id string, ordinal int, local_identity string, search_class string")
    h = spark.createDataFrame([(1, 5, 1.0), (1, 9, None), (2, 5, 9.0), (3, 1, 2.0), (3, 2, 1.0), (4, 1, 9.0)], "row_id bigint, scored_at bigint, score double")
    assert [(x.row_id, x.score, x.place) for x in best_messages(m, h).collect()] == [(3, 1.0, 1)]
    loose = m.withColumn("local_identity", F.lit(None).cast("string")).where("row_id <> 4")  # each row a message of its own
    assert sorted((x.row_id, x.place) for x in best_messages(loose, h).collect()) == [(2, 1), (3, 2)]
    assert best_messages(m, h.where("false")).collect() == []
    wide = m.withColumns({c: F.lit("x") for c in ("score", "need", "k", "text")})
    assert best_messages(wide, h).count() == 1
