"""Incremental anonymised ingest of a transaction log.

The batch job scans a log, replaces identifiers by surrogates, keeps the
allowed columns and writes compressed parquet.  The same projection runs here
on newly arrived files only: it is stateless, so the file sink's commit log is
all that is needed for exactly-once output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from partcast.operators.privacy import keep_columns, pseudonymise


def anonymised(log: DataFrame, columns: dict[str, str], prefixes: dict[str, str], keep: list[str], salt: str) -> DataFrame:
    return keep_columns(pseudonymise(log, columns, prefixes, salt), keep, list(columns))


def start_ingest(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
    columns: dict[str, str], prefixes: dict[str, str], keep: list[str], salt: str,
) -> StreamingQuery:
    """Process what has arrived, then stop."""
    log = spark.readStream.schema(schema).parquet(source)
    return (
        anonymised(log, columns, prefixes, keep, salt).writeStream.format("parquet")
        .option("path", target).option("checkpointLocation", checkpoint).option("compression", "zstd")
        .trigger(availableNow=True).start()
    )
