"""How well decisions fit what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, by: str, expected: Column, predicted: Column) -> DataFrame:
    """Counts and derived ratios for each group and, as OVERALL, for all."""
    marked = df.select(F.col(by), expected.alias("__e"), predicted.alias("__p"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    e, p = F.col("__e"), F.col("__p")
    counts = marked.rollup(by).agg(
        count(e & p).alias("tp"), count(~e & p).alias("fp"), count(e & ~p).alias("fn"), count(~e & ~p).alias("tn"),
        F.count("*").alias("total"), F.grouping(by).alias("__all"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.select(
        F.when(F.col("__all") == 1, "OVERALL").otherwise(F.col(by)).alias(by),
        "tp", "fp", "fn", "tn", "total",
        F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"),
        F.round(_ratio(precision * recall * 2.0, precision + recall), 6).alias("f1"),
        F.round(_ratio(fp, fp + tn), 6).alias("fp_rate"),
        F.round(_ratio(fn, fn + tp), 6).alias("fn_rate"),
    )


def latency_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.5), 6).alias("p50"),
        F.max(value).alias("most"), F.round(F.count("*") / F.sum(value), 6).alias("throughput"),
    )
