"""Readers and writers for operational extracts and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def scan_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with header; a field that does not fit its type becomes null."""
    return (
        spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
        .option("encoding", "UTF-8").csv(path)
    )


def scan_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 200_000) -> None:
    (df.write.mode("overwrite").option("compression", "zstd")
     .option("maxRecordsPerFile", rows_per_file).parquet(path))


def write_ledger(df: DataFrame, path: str) -> None:
    """Metric table as JSON lines."""
    df.write.mode("overwrite").json(path)


def union_present(parts: dict[str, DataFrame | None]) -> DataFrame:
    """Union of the model outputs that exist, labelled by model."""
    frames = [df.withColumn("model", F.lit(m)) for m, df in parts.items() if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_shared(*frames: DataFrame) -> DataFrame:
    """Union on the columns all inputs share, types widened."""
    cols = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    return reduce(lambda a, b: a.unionByName(b), [f.select(*cols) for f in frames])
