"""Scores that models give: any function from a batch of texts to columns can be one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import clamp

Scorer = Callable[[pd.Series], pd.DataFrame]


def with_provider(df: DataFrame, text_col: str, score: Scorer, columns: list[str]) -> DataFrame:
    """Add a model's scores as double columns, a batch at a time; null texts are scored as empty."""
    schema = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in df.schema) + "".join(f", {c} double" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = score(batch[text_col].fillna(""))
            yield pd.concat([batch.reset_index(drop=True), found[columns].reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, schema)


def parse_verdict(answer: Column) -> dict[str, Column]:
    """Decision, reason, confidence and category of a reviewer's answer that holds a JSON object.

    An answer without one, or with a decision of its own making, is UNDER_REVIEW at 0.5.
    """
    body = F.from_json(
        F.regexp_extract(answer, r"(?s)\{.*\}", 0), "decision string, reason string, confidence double, category string"
    )
    kind = F.upper(F.trim(body["decision"]))
    known = kind.isin("APPROVED", "REJECTED", "UNDER_REVIEW")
    return {
        "decision": F.when(known, kind).otherwise("UNDER_REVIEW"),
        "reason": F.substring(F.coalesce(body["reason"], F.lit("")), 1, 500),
        "confidence": clamp(F.coalesce(body["confidence"], F.lit(0.5))),
        "category": F.substring(F.coalesce(body["category"], F.lit("")), 1, 120),
    }
