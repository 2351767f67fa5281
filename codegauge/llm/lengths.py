"""Exact histogram of encoded lengths and what it answers for every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codegauge.llm.bpe import byte_bpe, vocabulary
from codegauge.llm.tables import in_batches, key_and_text, written

QUANTILES = (0.5, 0.9, 0.99)
CHUNK = 4096


def encoded_lengths(docs: DataFrame, name: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """(n_tokens) of every whole text; a null text is an empty one of length 0.

    Repeated rows count one by one; other columns, whatever their names, are not read.
    """

    def run(batches):
        coder = byte_bpe(path or vocabulary(name))
        for batch in batches:
            got = coder.encode_batch(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in got], pa.int64())], ["n_tokens"])

    return in_batches(key_and_text(docs.withColumn("doc_id", F.lit(0))).select("text"), run, "n_tokens long")


def length_table(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, answering the context limit of that length.

    ``lengths`` has a column n_tokens (nulls are left out). Columns: context_limit,
    n_docs (of exactly that length), docs_longer (cut by the limit), tokens (in all
    documents of that length), truncated_total (sum of min(length, limit) over all
    documents), tokens_lost (total minus truncated total), quantile (share of documents
    not longer than the limit). Between two lengths that occur, the truncated total grows
    by docs_longer for each token, so the rows answer every limit exactly. An empty table
    gives no rows.

    Counts are pre-aggregated per length. The suffix sums run in chunks of lengths whose
    totals are summed first, so no window holds more than ``CHUNK`` rows or one row per chunk.
    """
    counts = lengths.where(F.col("n_tokens").isNotNull()).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    counts = counts.select(
        F.floor(F.col("n_tokens") / CHUNK).alias("chunk"),
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
    )
    counts = written(counts, "lengths")  # used twice: the texts are encoded once
    chunks = counts.groupBy("chunk").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    later = chunks.select(
        "chunk",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(Window.partitionBy(F.lit(0))).alias("all_docs"),
        F.sum("t").over(Window.partitionBy(F.lit(0))).alias("all_tokens"),
    )
    inside = Window.partitionBy("chunk").orderBy(F.desc("context_limit")).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.col("later_docs") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))
    longer_tokens = F.col("later_tokens") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    rows = counts.join(later, "chunk").select(
        "context_limit", "n_docs", "tokens", longer.alias("docs_longer"), longer_tokens.alias("lt"), "all_docs", "all_tokens"
    )
    truncated = F.col("all_tokens") - F.col("lt") + F.col("docs_longer") * F.col("context_limit")
    return rows.select(
        "context_limit",
        "n_docs",
        "tokens",
        "docs_longer",
        truncated.alias("truncated_total"),
        (F.col("all_tokens") - truncated).alias("tokens_lost"),
        (1 - F.col("docs_longer") / F.col("all_docs")).alias("quantile"),
    )


def length_quantiles(table: DataFrame, shares: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(share, n_tokens): the smallest length that at least that share of documents does not exceed."""
    return table.select("context_limit", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"), "quantile").where(
        "quantile >= share"
    ).groupBy("share").agg(F.min("context_limit").alias("n_tokens"))
