"""Documents to a training mix: toxic texts out, one of each group of near copies, repeated passages and benchmark leaks
out, then sources mixed to their target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
`run` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partcast.llm import decontaminate, mixing, ngram_join, paragraphs, toxicity
from partcast.llm.queries import table, toxic_model
from partcast.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score reaches the threshold."""
    scored = toxicity.annotate(docs, toxic_model(spark, docs, sf_dir), score_col="toxicity score")
    return scored.where(F.col("toxicity score") < toxicity.THRESHOLD).drop("toxicity score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; equal rows count once."""
    return ngram_join.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated paragraphs but the first out of the texts, wherever their lines break."""
    out = paragraphs.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("substring", drop_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Learned scores and iterated rates can't be written in SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
