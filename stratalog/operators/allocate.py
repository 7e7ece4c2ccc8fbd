"""Laying sessions out on shards of bounded size."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: bytes a serving store needs for a byte of searchable text and for a message, in tenths.
BYTES_PER_MESSAGE = 2048


def estimated_size(volume: DataFrame) -> DataFrame:
    """Sessions with the size they take when served."""
    return volume.withColumn("size", (F.col("searchable_bytes") + F.col("searchable_messages") * BYTES_PER_MESSAGE).cast("bigint"))


def allocate(sessions: DataFrame, target: int, hard_limit: int, keep_over: bool = False) -> DataFrame:
    """Next-fit: a provider's sessions in order of acceptance fill a shard until one doesn't fit; a shard is never opened again.

    ``sessions``: provider, session_id, first_accepted_at, size. Providers are
    worked on apart, on three narrow columns. A session above ``target`` gets
    a shard of its own. One above ``hard_limit`` fails the job; with
    ``keep_over`` it too gets a shard of its own and a warning names it.
    """
    if hard_limit < target:
        raise ValueError("the hard limit is under the target")
    too_big = sessions.where(F.col("size") > hard_limit).limit(1).collect()
    if too_big:
        said = f"session {too_big[0]['session_id']} is larger than any shard"
        if not keep_over:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["first_accepted_at", "session_id"], na_position="last")
        shard, used, out = 1, 0, []
        for size in frame["size"]:
            if used and used + size > target:
                shard, used = shard + 1, 0
            used += size
            out.append(shard)
        return pd.DataFrame({"provider": frame["provider"], "session_id": frame["session_id"], "shard": out, "size": frame["size"]})

    slim = sessions.select("provider", "session_id", "first_accepted_at", "size")
    return slim.groupBy("provider").applyInPandas(fill, "provider string, session_id string, shard bigint, size bigint")


def allocation_summary(allocated: DataFrame, target: int) -> DataFrame:
    """Per shard: sessions, size, and the room left in tenths of a per cent of the target, rounded down."""
    out = allocated.groupBy("provider", "shard").agg(F.count("*").alias("sessions"), F.sum("size").alias("size"))
    room = F.greatest(F.lit(0), F.lit(target) - F.col("size"))
    return out.withColumn("headroom_tenths", F.floor(room * 1000 / F.lit(target)).cast("bigint"))
