import random
from collections import defaultdict

from pyspark.sql import functions as F

from stratalog.llm import containers
from stratalog.llm.containers import longer_than_one, pack, plan


def check(counts, capacity, groups):
    segments, used = plan(counts, capacity, groups)
    fill, seen = defaultdict(int), defaultdict(set)
    for size, at, n, first, per in segments:
        for r in range(n):
            assert at + r not in seen[size]
            seen[size].add(at + r)
            fill[first + r // per] += size
    assert all(seen[s] == set(range(n)) for s, n in counts.items()) and all(v <= capacity for v in fill.values())
    assert set(fill) == set(range(used))
    return used


def test_plans_hold_every_item_once():
    r = random.Random(2)
    for _ in range(200):
        counts = {r.randrange(1, 101): r.randrange(1, 40) for _ in range(r.randrange(30))}
        check(counts, 100, r.choice([1, 4, 32]))
    assert check({}, 100, 4) == 0 and check({100: 3, 50: 3}, 100, 4) == 5


def test_little_space_is_left():
    r = random.Random(3)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(8192, int(r.lognormvariate(7, 1)) + 1)] += 1
    total = sum(s * n for s, n in counts.items())
    assert check(counts, 8192, 32) <= 1.01 * total / 8192 + 1


def test_documents(spark, monkeypatch):
    texts = [None, "", "é", "x" * 8191, "x" * 8192, "y" * 20_000] + ["z" * (i % 700) for i in range(2000)] + ["same"] * 500
    df = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumns({"tokens": F.lit(1), "rank": F.lit(1), "n": F.lit(2), "bucket": F.lit(0)})
    for rows in (500_000, 100):
        monkeypatch.setattr(containers, "BUCKET_ROWS", rows)
        packed = pack(df)
        out = packed.collect()
        assert len(out) == len(texts) + 1 + 2 and all(r.container is not None for r in out)
        fill = defaultdict(int)
        for r in out:
            fill[r.container] += r.tokens
        assert max(fill.values()) <= 8192 and sum(fill.values()) == sum(len((t or "").encode()) + 1 for t in texts)
        assert sorted(r.doc_id for r in longer_than_one(packed).collect()) == [4, 5]
        assert sorted(map(repr, pack(df.orderBy(F.rand(1))).collect())) == sorted(map(repr, out))
    assert pack(df.where("false")).collect() == []
    again = pack(df.where("doc_id = 5").unionByName(df.where("doc_id = 5")))
    assert again.count() == 6 and longer_than_one(again).count() == 2
