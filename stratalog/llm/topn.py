"""The N best items of every group, by simultaneous bisection of all groups' cutoffs.

Items are ordered by an order-preserving code made of the score and the
identifiers that break its ties. All groups' cutoffs are refined at once: each
round counts, in one pass, the rows above many midpoints of every group's open
range and keeps the part in which the N-th row lies. A group is settled when
its cutoff leaves exactly N rows. The code is refined part by part (score, then
each tie column), so only groups whose N-th row ties with others go on to the
next part. No round sorts or gathers a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators.skew import hot_keys, keyed_join, select_ranks
from stratalog.shared import written


def _part(c: Column, kind: str, down: bool) -> Column:
    """The column as a number of which less is better."""
    return (-c if kind in ("double", "float") else F.lit(-1) - c.cast("bigint")) if down else c.cast("bigint") if kind not in ("double", "float") else c


def top_n_per_group(df: DataFrame, groups: Sequence[str], score: str, ties: Sequence[str], n: int, bins: int = 64) -> DataFrame:
    """The rows of ``df`` that are among the ``n`` of greatest ``score`` in their group.

    Equal scores go by the ``ties`` columns in order, lower first (null last);
    among rows equal in all of them the order of all columns decides, and a
    row that occurs several times is kept as often as it fits, so a group of
    enough scored rows holds exactly ``n``. Rows of null or NaN
    score are never kept; a group of fewer scored rows keeps them all; null
    group values form a group; an empty table gives none. All columns of
    ``df`` are kept.
    """
    kinds = dict(df.dtypes)
    parts = [(score, True), *[(t, False) for t in ties]]
    names = [f"_p{i}" for i in range(len(parts))]
    own = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    for name, (c, down) in zip(names, parts):
        code = _part(F.col(c), kinds[c], down)
        own = own.withColumn(name, code if down else F.coalesce(code, F.lit(2**63 - 1)))
    own = own.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)}).select(*[f"_g{i}" for i in range(len(groups))], *names, F.struct(*[F.col(f"_g{groups.index(c)}").alias(c) if c in groups else F.col(c) for c in df.columns]).alias("_row"))
    keys = [f"_g{i}" for i in range(len(groups))]
    own = written(own, "scored")
    at = written(own.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_p0").alias("lo"), F.max("_p0").alias("hi")), "groups")
    total = at.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(at, keys, "n", total)
    kept = [keyed_join(own, w := at.where(F.col("n") <= n).select(*keys), keys, hot, w.count()).select("_row")]
    open_, stats, need = own, at.where(F.col("n") > n), F.lit(n).cast("bigint")
    for i, name in enumerate(names):
        cuts = select_ranks(open_, keys, name, stats, lambda s: s.withColumn("rank", s["need"] if "need" in s.columns else need), bins)
        cuts = written(cuts.withColumn("need", F.col("rank") - F.col("below")), "cuts")
        rows = cuts.count()
        if not rows:
            break
        full = F.col("need") == F.col("equal")
        near = keyed_join(open_, cuts.select(*keys, "cut", "need", "equal"), keys, hot, rows)
        kept.append(near.where((F.col(name) < F.col("cut")) | ((F.col(name) == F.col("cut")) & full)).select("_row"))
        near = near.where((F.col(name) == F.col("cut")) & ~full)
        if i + 1 == len(names):
            # rows that are equal in every part of the code: any of them will do, the first in the order of all columns
            same = near.groupBy(*keys, "need", "_row").agg(F.count("*").alias("_n"))
            order = Window.partitionBy(*keys)
            same = same.withColumn("_k", F.row_number().over(order.orderBy("_row"))).where(F.col("_k") <= n)
            same = same.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(n)).cast("int"))))
            kept.append(same.withColumn("_k", F.row_number().over(order.orderBy("_row", "_i"))).where(F.col("_k") <= F.col("need")).select("_row"))
            break
        open_ = written(near.select(*keys, *names[i + 1 :], "need", "_row"), "ties")
        stats = written(open_.groupBy(*keys).agg(F.count("*").alias("n"), F.min(names[i + 1]).alias("lo"), F.max(names[i + 1]).alias("hi"), F.max("need").alias("need")), "groups")
        open_ = open_.drop("need")
    return reduce(DataFrame.unionByName, kept).select("_row.*")


def latest_scores(hits: DataFrame) -> DataFrame:
    """``row_id`` and the score of its latest scoring; at the same time the greater one, null under all numbers and NaN above them."""
    last = F.max(F.struct("scored_at", "score")).alias("last")
    return hits.groupBy("row_id").agg(last).select("row_id", F.col("last.score").alias("score"))


def distinct_messages(messages: DataFrame, *columns: str) -> DataFrame:
    """One row a (session_id, local_identity): that of the lowest row_id, with ``columns`` of that row; without a local_identity each row is a message."""
    identity = F.coalesce("local_identity", F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    first = F.min(F.struct("row_id", *columns)).alias("first")
    return messages.groupBy("session_id", identity.alias("local_identity")).agg(first).select("session_id", "local_identity", "first.*")


def best_messages(messages: DataFrame, hits: DataFrame, n: int = 3, classes: Sequence[str] = ("dialogue", "evidence")) -> DataFrame:
    """For every session and search class, its ``n`` best-scored messages, with their ``place`` from 1.

    A message counts once, as its lowest row_id with that row's latest score;
    a row without a local_identity is a message of its own.
    """
    own = distinct_messages(messages, "ordinal", "search_class").where(F.col("search_class").isin(*classes))
    scored = own.join(latest_scores(hits), "row_id")
    best = top_n_per_group(scored.select("session_id", "search_class", "score", "ordinal", "row_id"), ["session_id", "search_class"], "score", ["ordinal", "row_id"], n)
    order = Window.partitionBy("session_id", "search_class").orderBy(F.desc("score"), F.col("ordinal").asc_nulls_last(), "row_id")
    return best.withColumn("place", F.row_number().over(order).cast("bigint"))  # at most n rows a group
