"""The corpus pipeline: documents in, token ids of kept documents out.

Each stage takes all that the one before it kept and returns the columns of documents, but for the last, which returns
ids. run() writes every stage to the shared folder and reads it again, so a lost executor costs a stage at most.

Defined results, for all stages: an empty table gives an empty one; other columns of any name pass through all stages but
the last; null ids and null texts are as stated below; repeated rows are told apart only by near_duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, decontaminate, minhash_dedup, quality_rules, secret_scan
from tallyloom.llm.shared import table
from tallyloom.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep. A null or empty text has no words and goes; null and
    repeated ids don't matter; ties in learning go to the rule that sorts first."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of near duplicates; of rows that share that id, the one of the least
    hash. Texts without words are one class; a null id counts as a hash of its text."""
    return minhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item. A null or empty text holds none; rows are judged one by one."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks for secrets; n_chars, where it is a column, follows the text. A null text stays null."""
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of all documents; a null or empty text has no ids, null ids pass through."""
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secrets),
    ("byte-level BPE", encode),
]

#: Learned rules, sampled bands and merges can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
