"""Registered queries: each operator over its whole table, in its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partcast.llm import (chat, decontaminate, lattice, licenses, lm, mixing, ngram_join, paragraphs, ranked, sql, suffixes, toxicity,
                          warc, whitening)
from partcast.llm.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Fitted on the labels of the rows that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out()).select("doc_id", "toxic")
    return toxicity.fit(docs, labels, Scratch(spark))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.annotate(docs, toxic_model(spark, docs, sf_dir))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").alias("tiles"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents")).drop("t")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"), Scratch(spark)))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_copies(table(spark, sf_dir, "embeddings"))


#: A conversation full of the template's own marks.
HARD = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(hard)))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents")).drop("t")


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.annotate(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_licenses, op3_ngram_jaccard, op4_warc, op5_mixing, op6_lattice, op7_chat,
                            op8_decontamination, op9_substring, op10_suffixes, op11_lm_scores,
                            op12_whitening, op13_ranked)
}
#: Fitted scores, iterated rates, tilings and probed cells have none; tests compare them with brute force.
SQL: dict[str, str] = {
    "op2_licenses": sql.LICENSES, "op3_ngram_jaccard": sql.NGRAM_JACCARD, "op4_warc": sql.WARC,
    "op7_chat": sql.chat(HARD),
    "op13_ranked": sql.RANKED,
}
