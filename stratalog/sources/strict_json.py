"""JSON without silent repairs: repeated keys, NaN and infinity are errors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class InvalidJson(ValueError):
    """Text that isn't strict JSON."""


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise InvalidJson("a key occurs twice")
    return out


def _constant(name: str) -> Any:
    raise InvalidJson(f"{name} is no JSON number")


def loads(text: str | bytes) -> Any:
    try:
        return json.loads(text, object_pairs_hook=_object, parse_constant=_constant)
    except InvalidJson:
        raise
    except ValueError as e:
        raise InvalidJson(str(e)) from e


def read_jsonl(spark: SparkSession, path: str, key: str, fields: tuple[str, ...] | None = None, banned: tuple[str, ...] = ()) -> DataFrame:
    """Lines of strict JSON objects: ``key``, ``body`` (the line) and ``error`` (null for a sound line).

    With ``fields`` any other field is an error, with ``banned`` these at any
    depth; blank lines are skipped. A key
    that occurs twice marks all its lines.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for line in b["value"]:
                try:
                    body = loads(line)
                    if not isinstance(body, dict) or not isinstance(body.get(key), str):
                        raise InvalidJson(f"no object with a text field {key}")
                    if fields is not None and set(body) - set(fields):
                        raise InvalidJson(f"unknown fields {sorted(set(body) - set(fields))}")
                    forbid(body, frozenset(banned))
                    out.append((body[key], line, None))
                except InvalidJson as e:
                    out.append((None, line, str(e)))
            yield pd.DataFrame(out, columns=["key", "body", "error"])

    rows = spark.read.text(path).where(F.trim("value") != "").mapInPandas(check, "key string, body string, error string")
    twice = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n").withColumn("_twice", F.lit(True))
    out = rows.join(twice, "key", "left")
    return out.select(F.col("key").alias(key), "body", F.coalesce("error", F.when(F.col("_twice"), "the key occurs twice")).alias("error"))


def forbid(value: Any, keys: frozenset[str]) -> None:
    """Fails if an object at any depth has one of the keys (as private text under whatever it is nested)."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if keys & v.keys():
                raise InvalidJson(f"keys that may not be here: {sorted(keys & v.keys())}")
            todo += v.values()
        elif isinstance(v, list):
            todo += v
