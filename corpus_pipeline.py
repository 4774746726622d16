"""The corpus pipeline: five operators in a row over ``documents``.

Each stage gets the rows that its predecessor kept, acts on all of them, and is
written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxflow.llm import decontaminate, kneser_ney, line_dedup, mixing, ngram_join
from taxflow.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null, empty and blank texts stay; repeated rows stay or go alike.
    """
    return kneser_ney.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated lines and runs of lines go; documents of which nothing is left go with them.

    Null texts, and texts that were empty before, stay.  Of equal runs the one of
    the smallest doc_id stays; null ids come last.  n_chars of a shortened text is counted anew.
    """
    found = line_dedup.line_dedup(docs)
    found = found.where(~((F.col("n_removed") > 0) & (F.length(F.regexp_replace("text", r"\s+", "")) == 0)))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document of the smallest doc_id stays.

    Texts without words and rows without an id stay; rows that share a doc_id stay or go together.
    """
    return ngram_join.keep_one_of_each_group(docs, k=5, threshold="0.8").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts, and rows without an id, stay."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to their target weights and shuffled; a null source is one of its own, texts don't matter."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mix),
]

#: No SQL can express the classifier; tests hold its model, the join and decontamination against plain versions, the other two against SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
