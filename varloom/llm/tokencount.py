"""Token counts from an exact length histogram.

Each whole text is encoded once and only its length leaves the worker. Documents are aggregated by length; suffix sums
over that histogram answer totals, quantiles and truncated totals for every context limit without another pass.

Nulls and edges: a null or empty text has length 0. An empty table gives an empty histogram. Repeated rows count each.
Extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import checkpointed, text_values
from varloom.llm.wordbpe import word_bpe

COARSE = 128


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the number of ids of its whole text."""

    def count(batches):
        for batch in batches:
            found = word_bpe(tokenizer).lengths(text_values(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length: documents and tokens at or above it, and the total if every document were cut to it.

    Sums run within blocks of lengths, and over the blocks' totals, so no task holds more than a block or one row for each
    block; there are as many blocks as the longest document has times 128 tokens.
    """
    block = F.col("n_tokens") - F.pmod(F.col("n_tokens"), F.lit(COARSE))
    rows = checkpointed(hist).select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), block.alias("block"))
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    fine = rows.withColumns({"docs_in": F.sum("n_docs").over(down), "tokens_in": F.sum("tokens").over(down)})
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = above.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    coarse = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    coarse = coarse.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    docs_from, tokens_from = F.col("docs_in") + F.col("docs_above"), F.col("tokens_in") + F.col("tokens_above")
    return fine.join(coarse, "block").select(
        "n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + docs_from * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_docs") - docs_from + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left if every document is cut to limit, from the suffix sums alone."""
    over = F.col("n_tokens") >= limit
    docs, tokens = (F.coalesce(F.max(F.when(over, F.col(c))), F.lit(0)) for c in ("docs_from", "tokens_from"))
    return sums.agg((F.coalesce(F.max("tokens_from"), F.lit(0)) - tokens + docs * F.lit(limit)).alias("tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least the share q of documents doesn't exceed."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
