"""A corpus pipeline of five stages, from raw documents to encoded ones.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  Null texts are empty, null doc_ids
larger than all others; repeated rows are worked on one by one, but for near duplicates, of which one row stays.  Extra
columns of any name are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellward.llm import bpe, decontaminate, near, quality, secrets
from cellward.llm.sparkops import fresh_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules or the perplexity bands of their language reject go; so do those without words."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; ties are broken as ``near.keep_first`` says."""
    return near.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go; one without words has none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, and n_chars follows; a null text stays null."""
    return secrets.redact(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the text decoded from them, for each document (0 ids for a null text)."""
    return bpe.digest(docs, bpe.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("bpe encoding", bpe_encoding),
]

#: The perplexity model and its bands, MinHash and byte-pair encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{fresh_dir(spark, 'pipeline')}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
