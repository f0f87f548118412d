"""The corpus pipeline: five stages, each on what the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, quality, simhash, substring
from graphloom.llm.common import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it is fitted on the labelled ones among them. Empty texts have the bias's score. Repeated rows stay rows."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each SimHash group. Rows of that doc_id all stay, and so do rows without doc_id."""
    groups = simhash.near_duplicates(docs.where("doc_id is not null"))
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words and more that also start earlier; emptied documents go. One row a row, whatever its doc_id."""
    left = substring.dedup(docs, keep_text=True).where("n_removed = 0 or kept <> ''").withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without doc_id stay."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the ids of every text left, and of the text decoded from them; see bpe.encode_decode() for nulls."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good_quality), ("simhash", one_of_each_group), ("substring", without_repeats), ("decontaminate", decontaminated), ("bpe", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
