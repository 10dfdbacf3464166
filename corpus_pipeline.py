"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's docs. All but the last return documents with the
columns they came with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from radiantlake.llm.common import drop_folder, fresh_folder, read_table
from radiantlake.llm.decontam import drop_contaminated
from radiantlake.llm.dedup import keep_first
from radiantlake.llm.packing import pack
from radiantlake.llm.quality import keep_good
from radiantlake.llm.queries import tokenizer_file
from radiantlake.llm.secrets import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; among them null and empty texts. Hard cases: see keep_good."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest doc_id (null last). Hard cases: see keep_first."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Hard cases: see drop_contaminated and contaminated."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out; every document stays. Hard cases: see redact."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences. Hard cases: see pack."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Tokenizing and the components of links are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, written between stages to the shared
    folder that the session names. A stage's folder goes when the next one's is whole."""
    docs = read_table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{name}")
            docs = spark.read.parquet(path)
            if k:
                drop_folder(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs
