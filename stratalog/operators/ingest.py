"""Taking artifacts in: what is new joins the projection, what can't be trusted is set aside, and a receipt says which was which."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions.digest import canonical_json
from stratalog.shared import children, read_text, shared_path, write_text, written

#: Columns of what is taken in: a row for every occurrence of a message in an artifact.
OCCURRENCE = ("sha256", "accepted_at", "session_id", "local_identity", "create_time", "provider_order", "digest")


class Corpus:
    """Accepted artifacts and the projection made of them, under ``root`` on a Hadoop file system.

    Each version has a manifest, written last and never changed, so readers
    see a version whole; a failed ingest leaves files that no manifest names.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, (root or shared_path(spark, "corpus")).rstrip("/")
        known = [n for n in children(spark, f"{self.root}/manifest") if n.endswith(".json") and not n.startswith(".")]
        body = json.loads(read_text(spark, f"{self.root}/manifest/{known[-1]}")) if known else {"version": 0, "occurrences": [], "messages": None, "receipt": None}
        self.version, self.parts, self.messages_at, self.receipt = body["version"], body["occurrences"], body["messages"], body["receipt"]

    def occurrences(self) -> DataFrame | None:
        return self.spark.read.parquet(*self.parts) if self.parts else None

    def messages(self) -> DataFrame | None:
        """The projection: a row a message."""
        return self.spark.read.parquet(self.messages_at) if self.messages_at else None

    def ingest(self, occurrences: DataFrame, expected: int | None = None) -> dict:
        """Normalises, checks, applies, verifies, commits; returns the receipt.

        An artifact that is accepted already is UNCHANGED and skipped; one
        that gives a message two contents (its own or another than the
        accepted) is rejected without holding up the others, and the batch is
        DEGRADED. The projection's sessions that the batch touches are made
        anew of all their occurrences. If ``expected`` artifacts are named and
        others come, nothing is changed.
        """
        own = written(occurrences.select(*OCCURRENCE), "occurrences")
        shas = own.select("sha256").distinct()
        total = shas.count()
        if expected is not None and total != expected:
            raise ValueError(f"{total} artifacts where {expected} were expected")
        old = self.occurrences()
        fresh = own if old is None else own.join(old.select("sha256").distinct(), "sha256", "left_anti")
        fresh = written(fresh, "fresh")
        keys = ["session_id", "local_identity"]
        seen = fresh.select("sha256", *keys, "digest")
        known = fresh.select(*keys, "digest", F.lit(None).cast("string").alias("sha256"))
        if old is not None:
            touched = fresh.select("session_id").distinct()
            known = written(old.join(touched, "session_id", "left_semi"), "known").select(*keys, "digest", F.lit("").alias("sha256"))
        clash = seen.groupBy("sha256", *keys).agg(F.countDistinct("digest").alias("n")).where("n > 1").select("sha256")
        if old is not None:
            clash = clash.union(seen.join(known.select(*keys, F.col("digest").alias("_d")).distinct(), keys).where(F.col("digest") != F.col("_d")).select("sha256"))
        rejected = written(clash.distinct(), "rejected")
        accepted = fresh.join(rejected, "sha256", "left_anti")
        n_fresh, n_rejected = fresh.select("sha256").distinct().count(), rejected.count()
        version = self.version + 1
        counts = {"artifacts": total, "accepted": n_fresh - n_rejected, "unchanged": total - n_fresh, "rejected": n_rejected}
        parts, messages = list(self.parts), self.messages_at
        if n_fresh > n_rejected:
            at = f"{self.root}/occurrences/{version:09d}"
            accepted.write.mode("overwrite").parquet(at)
            parts.append(at)
            every = self.spark.read.parquet(*parts)
            touched = self.spark.read.parquet(at).select("session_id").distinct()
            made = project(every.join(touched, "session_id", "left_semi"))
            if self.messages_at:
                made = made.unionByName(self.messages().join(touched, "session_id", "left_anti"))
            messages = f"{self.root}/messages/{version:09d}"
            made.write.mode("overwrite").parquet(messages)
            # verify: every identity of the ledger is in the projection once, and nothing else is
            made = self.spark.read.parquet(messages)
            n, distinct = made.count(), every.select(*keys).distinct().count()
            if n != distinct or made.select(*keys).distinct().count() != n:
                raise RuntimeError(f"the projection has {n} messages where the ledger has {distinct}")
        done = self.spark.read.parquet(messages) if messages else None
        state = "UNCHANGED" if not n_fresh else "DEGRADED" if n_rejected else "COMPLETE"
        receipt = {"version": version, "state": state, **counts, "messages": done.count() if done is not None else 0, "sessions": done.select("session_id").distinct().count() if done is not None else 0}
        receipt["receipt_ref"] = hashlib.sha256(canonical_json(receipt).encode()).hexdigest()
        body = {"version": version, "occurrences": parts, "messages": messages, "receipt": receipt}
        if not write_text(self.spark, f"{self.root}/manifest/{version:09d}.json", json.dumps(body)):
            raise RuntimeError("another ingest came first; open the corpus again")
        self.version, self.parts, self.messages_at, self.receipt = version, parts, messages, receipt
        return receipt

    def receipts(self) -> DataFrame:
        """A row a version: what its ingest did."""
        rows = [json.loads(read_text(self.spark, f"{self.root}/manifest/{v + 1:09d}.json"))["receipt"] for v in range(self.version)]
        names = ("version", "artifacts", "accepted", "unchanged", "rejected", "messages", "sessions", "state", "receipt_ref")
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {'string' if n in ('state', 'receipt_ref') else 'bigint'}" for n in names))

    def status(self) -> DataFrame:
        """One row: version, artifacts, messages, sessions and the time bounds of what was accepted; it never claims that the source has no more."""
        own = self.occurrences()
        if own is None:
            return self.spark.createDataFrame([(0, 0, 0, None, None, None)], "artifacts bigint, sessions bigint, messages bigint, first_time double, last_time double, last_accepted_at string")
        return own.agg(F.countDistinct("sha256").alias("artifacts"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("session_id", "local_identity").alias("messages"), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"), F.max("accepted_at").alias("last_accepted_at"))

    def rebuild_gap(self) -> DataFrame:
        """The messages that differ between the projection and one made anew of all occurrences, in either direction; none in a sound corpus."""
        made, kept = project(self.occurrences()), self.messages()
        return made.exceptAll(kept).withColumn("side", F.lit("ledger")).unionByName(kept.exceptAll(made).withColumn("side", F.lit("projection")))


def project(occurrences: DataFrame) -> DataFrame:
    """Messages of their occurrences: least time, greatest provider order, first digest, how many artifacts have it."""
    return occurrences.groupBy("session_id", "local_identity").agg(F.min("create_time").alias("create_time"), F.max("provider_order").alias("provider_order"), F.min("digest").alias("digest"), F.countDistinct("sha256").alias("artifacts"))


def ingest_order(artifacts: DataFrame, routes: DataFrame) -> DataFrame:
    """``artifact_id``, ``unit`` and ``place``: the order of ingestion. Artifacts of one accepted conversation that split into branches are a unit and come first, then the others by time of acceptance."""
    own = artifacts.select("artifact_id", "accepted_at").join(routes.select("artifact_id", "accepted_session_id", "route_state"), "artifact_id", "left")
    split = own.where("route_state = 'BRANCH_MATCH'").select(F.col("accepted_session_id").alias("unit")).distinct().withColumn("family", F.lit(0))
    unit = own.withColumn("unit", F.coalesce("accepted_session_id", F.concat(F.lit("artifact:"), F.col("artifact_id").cast("string"))))
    return unit.join(split, "unit", "left").select("artifact_id", "unit", F.coalesce("family", F.lit(1)).alias("family"), "accepted_at")


def freeze(decisions: DataFrame, key: str, decision: str, order: Sequence[str], n: int, accept: str = "accept") -> DataFrame:
    """The first ``n`` accepted keys of a decision log with their ``place``; a key with two decisions is a conflict and not frozen."""
    per = decisions.groupBy(key).agg(F.countDistinct(decision).alias("_k"), F.min(decision).alias(decision), *[F.min(c).alias(c) for c in order if c != key])
    ok = per.where((F.col("_k") == 1) & (F.col(decision) == accept)).drop("_k")
    few = ok.orderBy(*order, key).limit(n)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, key)).cast("bigint"))


def decision_conflicts(decisions: DataFrame, key: str, decision: str) -> DataFrame:
    """Keys with more than one decision."""
    return decisions.groupBy(key).agg(F.countDistinct(decision).alias("decisions")).where("decisions > 1")


def pin(spark: SparkSession, folder: str, schema: str) -> str:
    """A pin of a folder's files: names, sizes, digests and the schema's version, as canonical JSON."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256")).orderBy("name", "sha256").collect()  # a row a file
    return canonical_json({"schema": schema, "files": [[r["name"], r["length"], r["sha256"]] for r in rows]})


def resolve_pin(spark: SparkSession, folder: str, pinned: str) -> None:
    """Fails unless the folder is what the pin says."""
    if pin(spark, folder, json.loads(pinned)["schema"]) != pinned:
        raise ValueError("the folder isn't what was pinned")
