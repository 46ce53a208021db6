"""Documents through five operators of flowsieve.llm, one stage after the other.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of docs; the last returns
the encoded documents' digests. Every stage works on all rows that the one before it kept, judges
each on its own input, and states what null, empty, repeated and clashing input gives in its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import bpe_codec, decontaminate, langid, pii, simhash
from flowsieve.llm.common import table
from flowsieve.session import scratch_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letter or no main language."""
    return langid.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked, n_chars that of the masked text."""
    out = pii.mask(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return bpe_codec.digests(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", no_benchmark),
    ("PII", no_personal_data),
    ("BPE encoding and decoding", encoded),
]

#: Trained labels, fingerprints, alignments and encodings have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        where = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return STAGES[-1][1](spark, docs, sf_dir)
