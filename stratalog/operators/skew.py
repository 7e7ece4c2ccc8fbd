"""Joins and exact per-key selection that a few very frequent keys can't stall."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.shared import written

#: A side of at most so many rows of keys and numbers is broadcast (some tens of MB); a larger one is shuffled.
BROADCAST_ROWS = 200_000
#: A key with at least this share of all rows is hot; there can be no more than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 200
#: Partitions a hot key's rows are spread over, at least; more where the cluster has more cores.
SALTS = 32


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of key columns."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, total: int) -> list[tuple]:
    """The keys that hold at least HOT_SHARE of ``total`` rows: at most 1 / HOT_SHARE of them, whatever the data."""
    return [tuple(r) for r in counts.where(F.col(n) >= max(1.0, total * HOT_SHARE)).select(*keys).collect()]


def is_hot(df: DataFrame, keys: Sequence[str], hot: list[tuple]) -> Column:
    if not hot:
        return F.lit(False)
    if len(keys) == 1:
        values = [h[0] for h in hot if h[0] is not None]
        found = F.coalesce(df[keys[0]].isin(values), F.lit(False)) if values else F.lit(False)
        return found | df[keys[0]].isNull() if len(values) < len(hot) else found
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (df[k].eqNullSafe(F.lit(v)) for k, v in zip(keys, h))) for h in hot))


def keyed_join(big: DataFrame, small: DataFrame, keys: Sequence[str], hot: list[tuple], rows: int, how: str = "inner") -> DataFrame:
    """``big`` joined with the per-key rows of ``small`` (``rows`` of them, counted by the caller).

    ``small`` is broadcast only while ``rows`` is within BROADCAST_ROWS.
    Beyond that both sides are shuffled, and the rows of hot keys are spread
    over so many partitions (SALTS, or the cluster's cores) to each of which their few rows of ``small`` go.
    Keys compare null-safely; both key columns of ``small`` are dropped.
    """
    if rows <= BROADCAST_ROWS:
        small = F.broadcast(small.withColumnsRenamed({k: f"_{k}" for k in keys}))
        on = reduce(lambda a, b: a & b, (big[k].eqNullSafe(small[f"_{k}"]) for k in keys))
        return big.join(small, on, how).drop(*[f"_{k}" for k in keys])
    salts = max(SALTS, big.sparkSession.sparkContext.defaultParallelism)
    salted = big.withColumn("_salt", F.when(is_hot(big, keys, hot), F.monotonically_increasing_id() % salts).otherwise(F.lit(0)).cast("int"))
    copies = F.when(is_hot(small, keys, hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    small = small.withColumn("_salt_s", F.explode(copies)).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (salted[k].eqNullSafe(small[f"_{k}"]) for k in keys)) & (salted["_salt"] == small["_salt_s"])
    return salted.join(small, on, how).drop("_salt", "_salt_s", *[f"_{k}" for k in keys])


def _bin(v: Column, lo: Column, hi: Column, bins: int, kind: str) -> Column:
    """A bin number that never falls as v rises, 0 at lo and bins - 1 at hi, so each round splits a range."""
    if kind in ("double", "float"):
        part = (v * 0.5 - lo * 0.5) / F.nullif(hi * 0.5 - lo * 0.5, F.lit(0.0))
    elif kind == "bigint":
        part = (v.cast("decimal(20,0)") - lo.cast("decimal(20,0)")).cast("double") / (hi.cast("decimal(20,0)") - lo.cast("decimal(20,0)")).cast("double")
    else:
        part = (v.cast("double") - lo.cast("double")) / (hi.cast("double") - lo.cast("double"))
    inner = F.least(F.greatest(F.floor(part * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return F.when(v == lo, 0).when(v == hi, bins - 1).otherwise(F.coalesce(inner, F.lit(0)))


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, stats: DataFrame, wanted: Callable[[DataFrame], DataFrame], bins: int = 256) -> DataFrame:
    """The value at given ranks of each key, exactly, by refining histograms.

    ``stats`` has one row per key with ``n`` (values that aren't null), ``lo``
    and ``hi`` (least and greatest); ``wanted(stats)`` adds one row per wanted
    ``rank`` (1 is the least value). Each round counts the values of every
    open range in ``bins`` bins. Counts, minima and maxima merge, so a map
    task sends at most ``bins`` rows a range however many rows a key has. The
    bin that holds the rank, narrowed to the values seen in it, is the next
    range; a range of one value is the answer. NaN is above all numbers.

    Returns keys, rank, value (``cut``), ``below`` (values under it) and
    ``equal`` (values equal to it). Null values are ignored, null keys form a
    key of their own, no rows give no rows.
    """
    kind = dict(df.dtypes)[value]
    base = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    total = stats.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(stats, keys, "n", total)
    state = written(wanted(stats).select(*keys, "rank", F.col("rank").alias("left"), "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("equal")), "ranks")
    done = []
    while True:
        done.append(state.where(F.col("lo") == F.col("hi")))
        state = state.where(F.col("lo") < F.col("hi"))
        ranges = state.select(*keys, "lo", "hi").distinct()
        rows = ranges.count()
        if not rows:
            break
        found = keyed_join(base, ranges, keys, hot, rows).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        bin_of = _bin(F.col("_v"), F.col("lo"), F.col("hi"), bins, kind)
        hist = found.groupBy(*keys, "lo", "hi", bin_of.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "lo", "hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("_before", upto - F.col("_n")).withColumnsRenamed({k: f"_{k}" for k in (*keys, "lo", "hi")})
        on = reduce(lambda a, b: a & b, (state[k].eqNullSafe(hist[f"_{k}"]) for k in (*keys, "lo", "hi")))
        on &= (F.col("left") > F.col("_before")) & (F.col("left") <= F.col("_before") + F.col("_n"))
        state = written(state.join(hist, on).select(*keys, "rank", (F.col("left") - F.col("_before")).alias("left"), F.col("_min").alias("lo"), F.col("_max").alias("hi"), (F.col("below") + F.col("_before")).alias("below"), F.col("_n").alias("equal")), "ranks")
    return reduce(DataFrame.unionByName, done).select(*keys, "rank", F.col("lo").alias("cut"), "below", "equal")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with each row's 0-based place among the rows of its key, in a total order.

    The rows are sorted over all partitions, so those of one key may lie in
    many; a row's place is its place in its partition plus the counts of the
    partitions before it.
    """
    laid = written(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "laid")
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    counts = laid.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.withColumn("_first", F.coalesce(earlier, F.lit(0))).drop("_n").withColumnsRenamed({k: f"_{k}" for k in (*keys, "_part")})
    own = laid.withColumn("_local", local)
    on = reduce(lambda a, b: a & b, (own[k].eqNullSafe(firsts[f"_{k}"]) for k in (*keys, "_part")))
    return own.join(firsts, on).withColumn(name, (F.col("_local") + F.col("_first")).cast("bigint")).select(*df.columns, name)


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str], name: str, block: int = 100_000) -> DataFrame:
    """``df`` with the ``columns`` of the row before in its key as struct ``name``, null at a key's first row.

    A key's rows are worked on in blocks by their place, the last row of a
    block being known to the next one as well, so no key is one task's work.
    """
    own = numbered(df, keys, order, "_place")
    home = F.floor(F.col("_place") / block)
    own = own.withColumn("_at", F.explode(F.when(F.col("_place") % block == block - 1, F.array(home, home + 1)).otherwise(F.array(home))))
    before = F.lag(F.struct(*columns)).over(Window.partitionBy(*keys, "_at").orderBy("_place"))
    return own.withColumn(name, before).where(F.col("_at") == home).select(*df.columns, name)
