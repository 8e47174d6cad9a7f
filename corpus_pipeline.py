"""Corpus pipeline: the stages applied to ``documents``, each written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.

1. quality: documents that the rule ensemble rejects go.
2. near_duplicates: one document of each class of five-word n-gram similarity of 0.8 or more stays.
3. repeated_passages: bytes covered by strings of 200 bytes that occur elsewhere go, documents stay.
4. benchmark: documents that hold a benchmark item within its error budget go.
5. packing: what is left is packed into sequences of 4096 tokens.

Edge cases are those of the operators: null and empty texts, repeated rows, ties and empty tables
pass through every stage; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.llm import decontaminate, jaccard_join, packing, quality_rules, suffix_dedup
from tillspark.llm.common import ship, stage, table
from tillspark.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = suffix_dedup.deduplicated(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return out


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("packing", pack),
]

#: SQL cannot express the tokenizer, the trained classifier or the block joins; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
