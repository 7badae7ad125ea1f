"""Operational reports over a log of requests: counts, rates, histories, slowest, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram.
BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def latest(log: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: the newest time of the log, which stands for now."""
    return log.agg(F.max(ts).alias("now"))


def whole_seconds(ts: Column) -> Column:
    """Seconds since 1970, to the nearest one (halves to the even one)."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")


def trailing_rate(log: DataFrame, seconds: int, ts: str = "ts") -> DataFrame:
    """Requests and rate over the trailing window, ages in whole seconds."""
    age = whole_seconds(F.col("now")) - whole_seconds(F.col(ts))
    inside = log.join(F.broadcast(latest(log, ts))).agg(F.count(F.when(age < seconds, 1)).alias("requests"))
    return inside.select("requests", (F.col("requests") / float(seconds)).alias("per_second"))


def history(log: DataFrame, width: int, buckets: int = 60, ts: str = "ts") -> DataFrame:
    """Counts of the last ``buckets`` windows, oldest first, empty ones as 0."""
    at = F.floor((whole_seconds(F.col("now")) - whole_seconds(F.col(ts))) / width)
    counts = (
        log.join(F.broadcast(latest(log, ts)))
        .select(at.alias("back"))
        .where((F.col("back") >= 0) & (F.col("back") < buckets))
        .groupBy("back")
        .agg(F.count("*").alias("n"))
    )
    every = log.sparkSession.range(buckets).select(F.col("id").alias("of"))
    return every.join(counts, F.col("of") == F.col("back"), "left").select(
        (F.lit(buckets - 1) - F.col("of")).alias("bucket"), F.coalesce("n", F.lit(0)).alias("requests")
    )


def last_n(log: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The ring buffer: the newest n rows, by a partial sort in every task."""
    return log.orderBy(*order).limit(n)


def histogram(log: DataFrame, value: str, by: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts up to each bound and in all, one row for each group and bound."""
    sums = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"le_{i}") for i, b in enumerate(bounds)]
    wide = log.groupBy(by).agg(*sums, F.count("*").alias("le_inf"))
    pairs = ", ".join(f"'{b}', le_{i}" for i, b in enumerate(bounds)) + ", '+Inf', le_inf"
    return wide.select(by, F.expr(f"stack({len(bounds) + 1}, {pairs}) as (le, count)"))


def recent_stats(log: DataFrame, by: str, value: str, order: list[Column], n: int = 100) -> DataFrame:
    """Mean, least, most and number of the last n values of each group."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return (
        log.withColumn("__n", place)
        .where(F.col("__n") <= n)
        .groupBy(by)
        .agg(
            F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"),
            F.count("*").alias("samples"),
        )
    )


def breaker(log: DataFrame, key: str, order: list[str], failed: Column, most: int) -> DataFrame:
    """Runs of failures of each key that are long enough to open its circuit, first to last."""
    window = Window.partitionBy(key).orderBy(*order)
    marked = log.select(key, *order, failed.alias("__f")).withColumn("__ok", F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(window))
    runs = marked.where("__f").groupBy(key, "__ok").agg(
        F.count("*").alias("failures"), *[F.min(F.struct(*order)).alias("__first"), F.max(F.struct(*order)).alias("__last")]
    )
    return runs.where(F.col("failures") >= most).select(
        key, "failures", F.col(f"__first.{order[0]}").alias("first_at"), F.col(f"__last.{order[0]}").alias("last_at")
    )


def by_kind(log: DataFrame, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """Rows of each kind, 0 for kinds without any: (counter, name, total). Other kinds are left out."""
    named = log.sparkSession.createDataFrame([(k,) for k in kinds], "name string")
    counts = log.groupBy(F.col(kind).alias("of")).agg(F.count("*").alias("n"))
    return named.join(counts, F.col("name") == F.col("of"), "left").select(F.lit(kind).alias("counter"), "name", F.coalesce("n", F.lit(0)).alias("total"))


def category_flags(reports: DataFrame, categories: tuple[str, ...], above: float = 50.0) -> DataFrame:
    """How many reports have each category above a percentage: (counter, name, total)."""
    counts = reports.agg(*[F.count_if(F.col(c) > above).alias(c) for c in categories])
    return counts.unpivot([], list(categories), "name", "total").select(F.lit("category_flag").alias("counter"), "name", "total")
