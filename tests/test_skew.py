import math
import random

import pytest
from pyspark.sql import functions as F

from stratalog.operators import skew
from stratalog.operators.quantiles import heavy_keys, keyed_quantiles

PROBS = (0.0, 0.25, 0.5, 0.9, 1.0)


def brute(rows):
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    out = {}
    for k, vs in by.items():
        own = sorted((v for v in vs if v is not None), key=lambda v: (v != v, v if v == v else 0))
        out[k] = (len(vs), len(own), *[own[max(1, math.ceil(p * len(own))) - 1] if own else None for p in PROBS])
    return out


def same(a, b):
    return all((x is None and y is None) or (x is not None and y is not None and (x == y or (x != x and y != y))) for x, y in zip(a, b))


@pytest.mark.parametrize("broadcast", [200_000, 0])
@pytest.mark.parametrize("kind", ["double", "bigint", "int"])
def test_quantiles_against_brute_force(spark, monkeypatch, kind, broadcast):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast)
    r = random.Random(kind)
    value = {
        "double": lambda: r.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, 1e-300, 1e300, r.random(), r.gauss(0, 1e6), 5.0]),
        "bigint": lambda: r.choice([None, 2**63 - 1, -(2**63), 2**60, 2**60 + 1, r.randrange(1000), 7]),
        "int": lambda: r.choice([None, r.randrange(50), 2**31 - 1, -(2**31)]),
    }[kind]
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None, ""]), value()) for _ in range(600)] + [("nothing", None), ("one", 3.0 if kind == "double" else 3)]
    df = spark.createDataFrame(rows, f"k string, v {kind}").repartition(3)
    got = {x[0]: tuple(x)[1:] for x in keyed_quantiles(df, "k", "v", PROBS, bins=8).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert same(got[k], want[k]), (k, got[k], want[k])


def test_quantiles_of_nothing_and_of_clashing_columns(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert keyed_quantiles(empty, "k", "v").collect() == []
    odd = spark.createDataFrame([("a", 1.0, 5, "x"), ("a", 2.0, 6, "y")], "key string, value double, n int, lo string")
    assert [tuple(x) for x in keyed_quantiles(odd, "key", "value").collect()] == [("a", 2, 2, 1.0)]
    assert heavy_keys(empty, "k", 0.05).collect() == []


def test_heavy_keys_counts_rows_without_values(spark):
    df = spark.createDataFrame([("a", None)] * 10 + [(str(i), 1.0) for i in range(90)] + [(None, 1.0)] * 100, "k string, v double")
    assert [x.k for x in heavy_keys(df, "k", 0.05).collect()] == ["a"]


def test_heavy_keys_are_those_of_counts(spark):
    r = random.Random(3)
    for n in (1, 7, 140, 999):
        rows = [(r.choice((1, 1, 1, 2, 2, 3, None, r.randrange(100))),) for _ in range(n)]
        df = spark.createDataFrame(rows, "k int").repartition(3)
        for share in (0.05, 0.2, 1.0):
            want = {k for k in {x[0] for x in rows} if k is not None and rows.count((k,)) >= round(share * n, 9)}
            assert {x.k for x in heavy_keys(df, "k", share, bins=4).collect()} == want, (n, share)


def test_lagged_over_blocks(spark):
    rows = [("hot" if i % 4 else "cold", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int").repartition(5)
    for block in (7, 1000):
        got = {(x.k, x.o): x.p.o if x.p else None for x in skew.lagged(df, ["k"], [F.col("o")], ["o"], "p", block).collect()}
        want = {}
        for k in ("hot", "cold"):
            own = [o for a, o in rows if a == k]
            want |= {(k, b): a for a, b in zip([None, *own], own)}
        assert got == want


def test_numbered_spreads_a_key_and_keeps_the_order(spark):
    rows = [("hot" if i % 3 else "cold", i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, o int, id int")
    got = skew.numbered(df, ["k"], [F.col("o"), F.col("id")], "place").collect()
    for k in ("hot", "cold"):
        own = sorted((x for x in got if x.k == k), key=lambda x: x.place)
        assert [x.place for x in own] == list(range(len(own)))
        assert [(x.o, x.id) for x in own] == sorted((x.o, x.id) for x in own)
