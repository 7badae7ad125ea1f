"""Reports as JSON, as (metric, value) rows, and as counters and histograms in text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, name: str = "report") -> DataFrame:
    """One JSON string a row."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def as_metrics(df: DataFrame) -> DataFrame:
    """Number columns of every row as (metric, value) rows."""
    numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")]
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in numbers)
    return df.select(F.expr(f"stack({len(numbers)}, {pairs}) as (metric, value)"))


def exposition(counts: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Lines of the text format that scrapers read: name{label="value"} number."""
    parts = [F.concat(F.lit(f'{k}="'), F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit('"')) for k in labels]
    return counts.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("line"))


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
