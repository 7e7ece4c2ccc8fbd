"""Digests that depend on content alone."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_digest(values: Column) -> Column:
    """SHA-256 of the sorted distinct values, each followed by a line end; of the empty set that of the empty string. An aggregate."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_set(values)), lambda v: F.concat(v, F.lit("\n"))), "")
    return F.sha2(lines, 256)


def row_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``row_digest``: SHA-256 of the row as compact JSON with the columns in the given order."""
    return df.withColumn("row_digest", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``rows`` and an order-independent ``digest`` of a table of any size.

    The rows' digests are added up in four parts, which merges in the map
    tasks; equal tables have equal digests in whatever order their rows lie.
    """
    own = row_digest(df, columns)
    part = lambda k: F.sum(F.conv(F.substring("row_digest", 16 * k + 1, 15), 16, 10).cast("decimal(38,0)"))
    return own.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", F.count("*"), *[part(k) for k in range(4)]), 256).alias("digest"))


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no spaces; NaN and infinity are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def line_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``rows`` and ``digest``, the sum of the first 60 bits of every line's SHA-256 as text.

    A line is the columns as text, joined by a bar, null as nothing. The sum
    merges in the map tasks and doesn't depend on the order of the rows.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    part = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def request_id() -> str:
    """A random request id of 32 hexadecimal digits."""
    return uuid.uuid4().hex
