"""A training corpus from raw documents: quality, exact copies, near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, exact_dedup, packing, quality, registry, simhash
from weftline.llm._work import Work, finished, shared_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(docs, registry.tokenizer_path())


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("packing", packed),
]

#: No SQL states what the classifier and the tokenizer do; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read as the next one's input.

    Without a name the stages' tables are scratch: each goes when the next one is written, and the last when the process ends.  With one
    they stay, and a run of that name goes on after the last stage that an earlier one has finished.
    """
    work = Work(spark, "pipeline") if name is None else None
    root = work.root if work else f"{shared_dir(spark)}/weftline/pipeline-{name}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (stage, make) in enumerate(STAGES):
        path = f"{root}/{k}-{stage}"
        if work:
            work.save(make(spark, docs, sf_dir), f"{k}-{stage}")
            if k:
                work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
        elif not finished(spark, path):
            make(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
