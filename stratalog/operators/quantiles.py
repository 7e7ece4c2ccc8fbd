"""Per-key quantiles that stay exact and balanced when a few keys hold most rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.skew import select_ranks
from stratalog.shared import written


def keyed_quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float] = (0.5,), bins: int = 256) -> DataFrame:
    """One row per key: ``n_rows``, ``n_values`` and the quantiles of ``value``, exactly.

    Columns are key, n_rows, n_values and one ``q<percent>`` a probability
    (q50 for 0.5): the least value that at least that share of the key's
    values doesn't exceed. The values of a key are never brought together:
    every round counts them in histogram bins that merge in the map tasks
    (see :func:`select_ranks`).

    Null values count as rows, not as values; a key without values gets null
    quantiles; a null key is a key; NaN is above all numbers; an empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    own = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    stats = own.groupBy("key").agg(F.count("*").alias("n_rows"), F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    stats = written(stats, "keys")
    marks = F.array(*[F.struct(F.lit(float(p)).alias("p")) for p in probs])

    def wanted(s: DataFrame) -> DataFrame:
        each = s.where("n > 0").withColumn("m", F.explode(marks))
        return each.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("m.p") * F.col("n"))).cast("bigint")).drop("m").distinct()

    cuts = select_ranks(own, ["key"], "value", stats.select("key", "n", "lo", "hi"), wanted, bins)
    cuts = cuts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "cut"))).alias("cuts"))  # at most one entry a probability
    joined = stats.join(cuts.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left")
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n"))).cast("bigint")
    return joined.select(F.col("key").alias(key), "n_rows", F.col("n").alias("n_values"), *[F.try_element_at("cuts", rank(p)).alias(f"q{p * 100:g}".replace(".", "_")) for p in probs])


def heavy_keys(df: DataFrame, key: str, share: float, bins: int = 256) -> DataFrame:
    """``key`` and ``n_rows`` of the keys that hold at least ``share`` of all rows, by exact selection.

    Were all rows in order of a code of their key, a key with so many rows
    would cover every place that is a multiple of that number. So the values
    at those places, of which there are at most 1 / ``share``, are selected
    exactly over all rows (:func:`select_ranks`: histograms that merge, refined
    until each place holds one value), and the rows equal to them counted on
    the way tell the heavy ones. Their keys are then looked up and compared
    themselves, in case two keys have one code. No key is grouped but these.

    A null key counts among all rows and is not reported; an empty table gives
    none; other columns are ignored.
    """
    own = df.select(F.lit(0).alias("all"), F.col(key).alias("key"), F.when(F.col(key).isNotNull(), F.xxhash64(key)).alias("code"))
    stats = own.groupBy("all").agg(F.count("*").alias("n_rows"), F.count("code").alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"))
    stats = written(stats, "keys")
    total = (stats.first() or {"n_rows": 0})["n_rows"]
    least = max(1, math.ceil(Fraction(str(share)) * total))

    def wanted(s: DataFrame) -> DataFrame:
        return s.where(F.col("n") >= least).withColumn("rank", F.explode(F.sequence(F.lit(least).cast("bigint"), F.col("n"), F.lit(least).cast("bigint"))))

    cuts = select_ranks(own, ["all"], "code", stats.select("all", "n", "lo", "hi"), wanted, bins)
    codes = cuts.where(F.col("equal") >= least).select(F.col("cut").alias("code")).distinct()
    met = own.join(F.broadcast(codes), "code")  # at most 1 / share codes
    return met.groupBy("key").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least).withColumnRenamed("key", key)
