"""CSV files on their way into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stage(rows: DataFrame, path: str) -> None:
    """Writes rows as CSV with a header; texts are quoted, so line breaks and empty texts come back as they were."""
    rows.write.mode("errorifexists").options(header=True, quoteAll=True, escape='"', nullValue="\\N", emptyValue="").csv(path)


def staged(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Staged rows as a table; a row that doesn't fit the schema fails the job."""
    return spark.read.options(header=True, multiLine=True, escape='"', nullValue="\\N", emptyValue="", mode="FAILFAST", enforceSchema=False).schema(schema).csv(path)
