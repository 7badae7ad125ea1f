"""Operator 10: exact histogram of encoded lengths, and what follows from its suffix sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.bpe import encoder
from siftwork.llm.common import checkpointed, small_batches, table

#: Lengths of one band are summed together; bands of a corpus are few, as texts are finite.
BAND = 1024


def encoded_lengths(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``n_tokens`` of every row; a null text has none."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path, pattern)
        for batch in batches:
            counts = codec.lengths(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    return source.mapInArrow(measure, f"id {id_type}, n_tokens long").withColumnRenamed("id", id_col)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per distinct length with the sums that answer questions about any context limit.

    Columns: ``n_tokens``; ``docs`` and ``tokens`` of that very length; ``docs_ge`` and ``tokens_ge``, the
    suffix sums over lengths at least as large; ``rank_from`` and ``rank_to``, the places (from 1) that
    these documents take when sorted by length; ``truncated_total``, the tokens left if every document
    is cut at this length. Lengths are aggregated before they are shuffled, so a common length costs
    one row a task. Suffix sums are taken inside bands of 1,024 lengths and then over the bands.
    Null lengths count as 0. An empty table gives no rows.
    """
    n = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    # read for the lengths and again for the bands: one row per length, written once
    hist = checkpointed(
        lengths.groupBy(n.alias("n_tokens"))
        .agg(F.count("*").alias("docs"))
        .select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.expr(f"n_tokens div {BAND}").alias("band"))
    )
    bands = hist.groupBy("band").agg(F.sum("docs").alias("band_docs"), F.sum("tokens").alias("band_tokens"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    starts = bands.select(
        F.col("band").alias("of_band"),
        F.coalesce(F.sum("band_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("band_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("band_docs").over(whole).alias("all_docs"),
        F.sum("band_tokens").over(whole).alias("all_tokens"),
    )
    down = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    joined = hist.select(
        "*", F.sum("docs").over(down).alias("docs_here"), F.sum("tokens").over(down).alias("tokens_here")
    ).join(starts, F.col("band") == F.col("of_band"))
    summed = joined.select(
        "n_tokens",
        "docs",
        "tokens",
        (F.col("docs_above") + F.col("docs_here")).alias("docs_ge"),
        (F.col("tokens_above") + F.col("tokens_here")).alias("tokens_ge"),
        "all_docs",
        "all_tokens",
    )
    below = F.col("all_docs") - F.col("docs_ge")
    return summed.select(
        "n_tokens",
        "docs",
        "tokens",
        "docs_ge",
        "tokens_ge",
        (below + 1).alias("rank_from"),
        (below + F.col("docs")).alias("rank_to"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Documents, tokens, and tokens after cutting every document at ``limit``: one row, 0 if empty."""
    if limit < 0:
        raise ValueError("a context limit must not be negative")
    part: Column = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("docs")
    return histogram.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in ((F.col("docs"), "docs"), (F.col("tokens"), "tokens"), (part, "kept_tokens"))],
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("docs"))), F.lit(0)).alias("cut_docs"),
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed: one row, null if empty."""
    if not 0 <= share <= 1:
        raise ValueError("a quantile's share is between 0 and 1")
    need = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n_docs")))
    size = histogram.agg(F.sum("docs").alias("n_docs"))
    return histogram.join(F.broadcast(size)).where(F.col("rank_to") >= need).agg(F.min("n_tokens").alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    lengths = encoded_lengths(
        table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    )
    return length_histogram(lengths)
