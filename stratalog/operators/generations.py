"""Immutable serving generations: load, check, activate."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.shared import children, read_text, write_text

BUILDING, READY = "BUILDING", "READY"


class GenerationError(RuntimeError):
    """A step that the generation's state doesn't allow."""


# Fixed value: what a generation's id is made of besides its manifest.
ID_PREFIX = "session-search-generation-v1"


def generation_id(manifest_sha: str) -> str:
    return hashlib.sha256(f"{ID_PREFIX}\n{manifest_sha}".encode()).hexdigest()


class Store:
    """Generations under a folder of a Hadoop file system: tables in parquet, states in small JSON files that appear whole.

    A state is never changed: READY is a file of its own, and so is each
    activation, numbered, so that of two writers one fails.
    """

    def __init__(self, spark: SparkSession, root: str, schema: int = 1) -> None:
        self.spark, self.root, self.schema = spark, root if ":/" in root else f"file://{root}", schema

    def _file(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _get(self, *parts: str) -> dict | None:
        body = read_text(self.spark, self._file(*parts))
        return None if body is None else json.loads(body)

    def path(self, generation: str, table: str) -> str:
        return self._file(generation, table)

    def manifest(self, generation: str) -> dict:
        m = self._get(generation, "manifest.json")
        if m is None:
            raise GenerationError(f"no generation {generation}")
        return m | {"state": READY if self._get(generation, "ready.json") else BUILDING}

    def load(self, generation: str, sessions: DataFrame, messages: DataFrame, manifest_sha: str, batches: int = 1) -> None:
        """Writes a new generation, the messages in ``batches`` by session, and reads the counts back; one that exists is never written again."""
        if self._get(generation, "manifest.json") is not None or not write_text(self.spark, self._file(generation, "begun.json"), "{}"):
            raise GenerationError("the generation exists")
        sessions.write.parquet(self.path(generation, "sessions"))
        part = F.pmod(F.xxhash64("session_id"), F.lit(batches))
        for k in range(batches):
            (messages.where(part == k) if batches > 1 else messages).write.mode("append").parquet(self.path(generation, "messages"))
        counts = [t.count() for t in self.tables(generation)]
        write_text(self.spark, self._file(generation, "manifest.json"), json.dumps({"manifest_sha": manifest_sha, "schema": self.schema, "counts": counts}, sort_keys=True))

    def tables(self, generation: str) -> tuple[DataFrame, DataFrame]:
        return tuple(self.spark.read.parquet(self.path(generation, t)) for t in ("sessions", "messages"))

    def classify(self, generation: str, manifest_sha: str) -> str:
        """absent, building, ready, or mismatch with the manifest expected."""
        try:
            m = self.manifest(generation)
        except GenerationError:
            return "absent"
        return "mismatch" if m["manifest_sha"] != manifest_sha else m["state"].lower()

    def mark_ready(self, generation: str, manifest_sha: str, sessions: int, messages: int) -> None:
        """READY once the manifest and both counts are as expected."""
        m = self.manifest(generation)
        if m["state"] != BUILDING or m["manifest_sha"] != manifest_sha:
            raise GenerationError("not building, or of another manifest")
        counts = [t.count() for t in self.tables(generation)]
        if counts != [sessions, messages] or counts != m["counts"]:
            raise GenerationError(f"counts are {counts}")
        write_text(self.spark, self._file(generation, "ready.json"), json.dumps({"counts": counts}))

    def _active(self) -> tuple[int, str | None]:
        names = [n for n in children(self.spark, self._file("active")) if n.endswith(".json") and not n.startswith(".")]
        return (len(names), self._get("active", names[-1])["generation"]) if names else (0, None)

    def active(self) -> str | None:
        return self._active()[1]

    def activate(self, generation: str, previous: str | None) -> None:
        """Makes a READY generation the active one, if ``previous`` still is: the next activation's file can be made once."""
        if self.manifest(generation)["state"] != READY:
            raise GenerationError("not ready")
        n, now = self._active()
        if now != previous:
            raise GenerationError("another generation is active")
        if not write_text(self.spark, self._file("active", f"{n + 1:09d}.json"), json.dumps({"generation": generation})):
            raise GenerationError("another change came first")

    def pinned(self, generation: str) -> tuple[DataFrame, DataFrame]:
        """The tables of a READY generation of this schema."""
        m = self.manifest(generation)
        if m["state"] != READY:
            raise GenerationError("not ready")
        if m["schema"] != self.schema:
            raise GenerationError(f"of schema {m['schema']}")
        return self.tables(generation)

    def status(self) -> DataFrame:
        """A row a generation: state, and whether it is active."""
        active = self.active()
        names = [g for g in children(self.spark, self.root) if g != "active" and self._get(g, "manifest.json")]
        rows = [(g, self.manifest(g)["state"], g == active) for g in names]
        return self.spark.createDataFrame(rows, "generation_id string, state string, active boolean").withColumn("checked", F.lit(True))
