"""Operator 6: contiguous shards of equal byte size, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.common import table, with_offsets

BUCKETS = 4096
SALTS = 256


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    whole_share: float = 0.01,
) -> DataFrame:
    """Cut the corpus into ``n_shards`` contiguous runs of nearly equal bytes.

    Rows stand in one global order (hash bucket of the text, hash of the text, salt of the id, id), so
    equal texts are neighbours. The byte offset of each row is a prefix sum: totals of each
    (text, salt) cell are summed inside their bucket, bucket totals are summed over all buckets, and a
    row adds what precedes it in its own cell. A salt splits the copies of one text over many cells, so
    no task holds all of them. A group of equal texts that weighs at most ``whole_share`` of a shard
    stays whole in the shard where it starts; a heavier one is cut where a shard is full. A shard
    therefore differs from the target by ``whole_share`` of it and one row at most.

    Returns one row per input row: id, ``size`` (UTF-8 bytes plus 1; a null text has no bytes),
    ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` (from 0 without gaps in each shard) and
    ``grown_shard`` (null under this law). A null text counts as empty. Repeated rows are rows of their
    own and take a slot each; a null id is an id like any other. An empty table gives an empty result;
    other columns are ignored.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("group"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit("salt")), F.lit(SALTS)).alias("salt"),
    )
    cell = Window.partitionBy("group", "salt").orderBy("id")
    before = cell.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(
        "*",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("cell_bytes_before"),
        (F.row_number().over(cell) - 1).alias("cell_rows_before"),
    )
    cells = (
        rows.groupBy("group", "salt")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .withColumn("bucket", F.pmod("group", F.lit(BUCKETS)))
    )
    offsets = with_offsets(cells, "bucket", ["group", "salt"], {"bytes": "byte_start", "rows": "row_start"})
    whole = Window.partitionBy("bucket", "group")
    offsets = offsets.select(
        F.col("group").alias("cell_group"),
        F.col("salt").alias("cell_salt"),
        "byte_start",
        "row_start",
        F.min("byte_start").over(whole).alias("group_start"),
        F.sum("bytes").over(whole).alias("group_bytes"),
    )
    total = rows.agg(F.sum("size").alias("total"))
    joined = placed.join(
        offsets, (F.col("group") == F.col("cell_group")) & (F.col("salt") == F.col("cell_salt"))
    ).join(F.broadcast(total))
    byte_at = F.col("byte_start") + F.col("cell_bytes_before")
    at = F.when(
        F.col("group_bytes") * n_shards <= F.col("total") * whole_share, F.col("group_start")
    ).otherwise(byte_at)
    shares = joined.select(
        "id",
        "size",
        "text_crc32",
        F.expr("row_start + cell_rows_before").alias("rank"),
        # decimal: the product passes 64 bits on a large corpus
        F.least(
            F.floor(at.cast("decimal(28,0)") * n_shards / F.col("total").cast("decimal(20,0)")).cast("int"),
            F.lit(n_shards - 1),
        ).alias("shard"),
    )
    firsts = shares.groupBy(F.col("shard").alias("of_shard")).agg(F.min("rank").alias("first"))
    return shares.join(F.broadcast(firsts), F.col("shard") == F.col("of_shard")).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
