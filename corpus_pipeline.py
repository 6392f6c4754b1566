"""From documents to packed sequences: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes what its predecessor kept and returns the columns of documents, the last one packed pieces. `run` writes
each stage as Parquet in the shared folder and reads it again, so a lost executor repeats one stage at most; the stage before
is then deleted.

Nulls and edges, for each stage: a null text is scored as an empty one, keeps its null in line dedup, counts as an empty text in
near-dedup (texts without words are alike, one stays), holds no benchmark passage, and packs as its end id. A null doc_id is a
document like any other; of a near-dedup group the smallest known id stays. Repeated rows and rows that tie in doc_id are scored
and cleaned each; near-dedup keeps one. Very long texts are read whole by every stage. Empty tables of documents, labels or
benchmark give empty or unfiltered results (without labels every document scores 0.5 and stays). Extra columns pass through all
stages but the last, whatever their names; `n_chars` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import decontam, linededup, packing, quality, simhash
from varloom.llm.common import fresh, table, written
from varloom.llm.registry import tokenizer

#: SQL can express neither trained trees nor tokenization nor best-fit packing; tests compare with brute force.
ORACLE_SQL = None


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(like.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good. It learns from the labelled rows of the whole table."""
    trees = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    into = fresh(docs, "score"), fresh(docs, "predicted")
    return quality.score(docs, trees, into).where(F.col(into[1]) == 1).drop(*into)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites."""
    return _sized(linededup.dedup_lines(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, similarity of 0.8 or more)."""
    return simhash.drop_near_duplicates(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), replaces=docs)
    return docs
