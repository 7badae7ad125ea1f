"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark alone, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Honour the session's checkpoint folder; set one only where none is set (tests on one machine)."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siftwork-checkpoint-"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let the session's Arrow batches of texts hold fewer rows, so workers with long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def light_batches(spark: SparkSession, size: int = 16 * 2**20) -> None:
    """Let the session's Arrow batches hold fewer bytes too, for rows that travel to Python whole and back. A setting of the session's own stays."""
    small_batches(spark)
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", 64 * 2**20
    if spark.conf.get(key).rstrip("b") == str(usual):
        spark.conf.set(key, str(size))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of each action when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet into the shared folder that the session names and read them again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{root.rstrip('/')}/siftwork-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not folder.rsplit("/", 1)[1].startswith("siftwork-"):
            raise ValueError(f"{folder} was not written by this library")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def train_split(doc_id: Column, folds: int) -> Column:
    """True where the row may be learnt from: crc32 of the decimal id modulo ``folds`` is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds != 0


_HALF = "9223372036854775808"


def sortable(key: Column, kind: str) -> Column:
    """A string for each id that sorts as the ids do: digits for integers, otherwise the id as a string and an end."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.lpad((key.cast("decimal(20,0)") + F.lit(_HALF).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(key.cast("string"), F.lit("\0"))


def unsorted(name: Column, kind: str) -> Column:
    """The id that ``sortable`` made the string from."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return (name.cast("decimal(20,0)") - F.lit(_HALF).cast("decimal(20,0)")).cast(kind)
    return F.substring_index(name, "\0", 1).cast(kind)


def with_offsets(cells: DataFrame, bucket: str, order: list[str], totals: dict[str, str]) -> DataFrame:
    """Exclusive global prefix sums of cell totals.

    Cells are ordered by (bucket, *order). Each bucket is summed on its own; only the bucket totals,
    whose number is fixed by the caller, meet in one task. ``totals`` maps a cell column to the name
    of its prefix sum.
    """
    sums = cells.groupBy(bucket).agg(*[F.sum(c).alias(f"__sum_{c}") for c in totals])
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col(bucket).alias("__bucket"),
        *[F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__base_{c}") for c in totals],
    )
    within = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cells.select(
        "*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__within_{c}") for c in totals]
    )
    joined = local.join(starts, F.col(bucket).eqNullSafe(F.col("__bucket")))
    return joined.select(
        *cells.columns,
        *[(F.col(f"__base_{c}") + F.col(f"__within_{c}")).cast("long").alias(name) for c, name in totals.items()],
    )
