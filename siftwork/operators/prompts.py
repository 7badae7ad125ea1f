"""Scores from model outputs: logits, category weights, text blocks, and the state of models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.text import clamp, collapse
from siftwork.operators.detections import first_of_each

#: Share of image, read text and caption in a category's score.
CATEGORY_SHARES = (0.50, 0.25, 0.25)
LEAST_BLOCK_CONFIDENCE = 0.25


def sigmoid_map(logits: Column) -> Column:
    """Independent probabilities of prompts from their logits."""
    return F.transform_values(logits, lambda _, x: clamp(F.lit(1.0) / (F.lit(1.0) + F.exp(-x))))


def best_score(scores: Column) -> Column:
    return F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0))


def fuse_categories(image: Column, read: Column, caption: Column) -> Column:
    """Weighted scores of the image's categories; one that a source lacks counts as 0 there."""
    a, b, c = CATEGORY_SHARES
    got = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    return F.transform_values(image, lambda k, x: clamp(x * a + got(read, k) * b + got(caption, k) * c))


def softmax_share(logits: Column, at: int) -> Column:
    """Probability of one class among an array of logits."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.get(powers, F.lit(at)) / F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)


def top_entry(scores: Column) -> Column:
    """Name and score of the highest entry (ties: first by name), 'Uncategorized' and 0 if there is none."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("name")))
    best = F.array_min(entries)
    return F.when(
        F.size(scores) > 0, F.struct(best["name"].alias("name"), (-best["v"]).alias("score"))
    ).otherwise(F.struct(F.lit("Uncategorized").alias("name"), F.lit(0.0).alias("score")))


def read_blocks(blocks: Column) -> Column:
    """Texts of recognised blocks (html, confidence, skipped) that can be trusted, without markup."""
    good = F.filter(
        blocks, lambda b: ~F.coalesce(b["skipped"], F.lit(False)) & (F.coalesce(b["confidence"], F.lit(1.0)) >= LEAST_BLOCK_CONFIDENCE)
    )
    texts = F.transform(good, lambda b: F.trim(F.regexp_replace(F.coalesce(b["html"], F.lit("")), "<[^>]+>", " ")))
    return F.filter(texts, lambda t: t != "")


def merge_fragments(fragments: Column) -> Column:
    """Fragments as one text, each once whatever its case."""
    return collapse(F.array_join(first_of_each(fragments), " "))


def captions_of(answers: Column, most: int = 3) -> Column:
    """The first ``most`` answers of a caption model, trimmed, without blanks and without those that repeat to the letter."""
    trimmed = F.transform(F.slice(answers, 1, most), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def abuse_score(label: Column, score: Column) -> Column:
    return F.round(F.when(F.lower(label) == "abusive", score).otherwise(F.lit(1.0) - score), 4)


def resource_status(percent: Column) -> Column:
    return F.when(percent < 80, "healthy").when(percent < 95, "warning").otherwise("offline")


def model_state(live: Column, tracked: Column, warm_up: Column) -> Column:
    """State of a model from what runs, what was recorded, and whether models are loaded ahead."""
    return (
        F.when(live == "loaded", "loaded")
        .when((tracked == "failed") | (live == "failed"), "failed")
        .when((live == "disabled") | (tracked == "disabled"), "disabled")
        .when(~warm_up, "lazy")
        .otherwise(F.coalesce(tracked, F.lit("not_loaded")))
    )
