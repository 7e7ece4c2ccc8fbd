"""The ledger of accepted artifacts: a JSON file an artifact, named by its digest."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.digest import canonical_json

ENTRY = "sha256 string, accepted_at string, source_adapter string, session_id string, provider string"


class LedgerConflict(ValueError):
    """An entry that differs from the one there is."""


def append(folder: str, entry: dict[str, Any]) -> str:
    """Adds an entry, RECORDED or UNCHANGED; another entry under the same digest is an error."""
    os.makedirs(folder, exist_ok=True)
    path, body = os.path.join(folder, f"{entry['sha256']}.json"), canonical_json(entry)
    try:
        with open(path, "x") as f:
            f.write(body)
        return "RECORDED"
    except FileExistsError:
        with open(path) as f:
            if json.load(f) != entry:
                raise LedgerConflict(entry["sha256"]) from None
        return "UNCHANGED"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All entries, with ``misnamed`` where a file's name isn't its digest and ``copies`` per digest."""
    own = spark.read.schema(ENTRY).json(folder, multiLine=True).withColumn("misnamed", F.col("_metadata.file_name") != F.concat("sha256", F.lit(".json")))
    copies = own.groupBy("sha256").agg(F.count("*").alias("copies"))
    return own.join(copies, "sha256")


def owners(manifest: DataFrame) -> DataFrame:
    """Digests that several providers claim. ``manifest``: provider, sha256."""
    return manifest.groupBy("sha256").agg(F.countDistinct("provider").alias("providers")).where("providers > 1")


def recovered(events: DataFrame, members: DataFrame, session_id: str) -> DataFrame:
    """The members of a mixed capture that belong to one conversation, by the requests that fetched them.

    ``events``: request_key, endpoint, conversation_id. ``members``:
    request_key, endpoint, member. A request that names several conversations
    owns nothing.
    """
    owner = events.groupBy("request_key", "endpoint").agg(F.countDistinct("conversation_id").alias("n"), F.min("conversation_id").alias("session_id")).where("n = 1")
    return members.join(owner, ["request_key", "endpoint"]).where(F.col("session_id") == session_id).select("member", "session_id")
