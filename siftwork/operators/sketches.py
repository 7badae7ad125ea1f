"""Quantiles from sketches of bounded size that are stored by window and merged over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; its rank error is below ``RANK_ERROR`` (with a probability of 99 %).
K, RANK_ERROR = 400, 0.01


def windowed(log: DataFrame, value: str, by: str, width: str, ts: str = "ts", k: int = K) -> DataFrame:
    """One sketch for each group and window of time: (by, ``start``, ``n``, ``sketch``). Null values are left out; a window without others has none."""
    there = log.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return there.groupBy(by, F.window(ts, width).alias("__w")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch")
    ).select(by, F.col("__w.start").alias("start"), "n", "sketch")


def merged(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """The sketches of a group put together: as if their values had been sketched at once."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("windows"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantile(sketch: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def with_quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    return sketches.withColumns({name: quantile(F.col("sketch"), p) for name, p in shares.items()})


def within_bound(found: DataFrame, log: DataFrame, value: str, by: str, shares: dict[str, float], error: float = RANK_ERROR) -> DataFrame:
    """Whether each quantile's true rank is within ``error`` of its share: (by, ``n``, ``windows``, <name>_ok), by counting the values around it."""
    v = F.col(value).cast("double")
    names = found.select(F.col(by).alias("__of"), "n", "windows", *[F.col(s).alias(f"__{s}") for s in shares])
    there = log.where(F.col(value).isNotNull() & ~F.isnan(v)).join(F.broadcast(names), F.col(by).eqNullSafe(F.col("__of"))) if shares else log
    counts = there.groupBy(by, "n", "windows").agg(
        *[F.count_if(v < F.col(f"__{s}")).alias(f"__lt_{s}") for s in shares], *[F.count_if(v <= F.col(f"__{s}")).alias(f"__le_{s}") for s in shares]
    )
    ok = lambda s, p: (F.col(f"__lt_{s}") <= (p + error) * F.col("n")) & (F.col(f"__le_{s}") >= (p - error) * F.col("n"))
    return counts.select(by, "n", "windows", *[ok(s, p).alias(f"{s}_ok") for s, p in shares.items()])
