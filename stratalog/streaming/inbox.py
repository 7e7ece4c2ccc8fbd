"""Streams of arriving files and feedback, each record taken once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files in a folder with their digests."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.zip").load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def ingest(spark: SparkSession, folder: str, ledger: str, quarantine: str, checkpoint: str, check: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Takes in what has arrived, once per digest, and ends.

    ``check`` adds ``error`` (null when sound) to the files of a batch; sound
    ones go to the ledger, others to the quarantine, so one bad file doesn't
    hold up the rest.
    """

    def take(batch: DataFrame, _: int) -> None:
        own = check(batch.dropDuplicates(["sha256"]))
        try:
            known = spark.read.parquet(ledger).select("sha256")
            own = own.join(known, "sha256", "left_anti")
        except Exception as e:  # the first batch finds no ledger
            if "PATH_NOT_FOUND" not in str(e):
                raise
        own = own.drop("content")
        own.where("error is null").drop("error").write.mode("append").parquet(ledger)
        own.where("error is not null").write.mode("append").parquet(quarantine)

    return watch(spark, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_feedback(stream: DataFrame, key: str = "feedback_ref", time: str = "observed_at", late: str = "1 day") -> DataFrame:
    """A stream without repeats of a record within the time it may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
