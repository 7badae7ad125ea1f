"""Scores from arrays of detections (struct of class and confidence) and maps of prompt scores."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import lexicons as lex
from siftwork.functions.text import clamp, label_norm, once
from siftwork.operators.fusion import OBJECT_TEMPERATURE, calibrated

#: Detector classes that count as another.
REMAPPED = {"knife": "weapon", "scissors": "weapon", "gun": "weapon", "pistol": "weapon", "rifle": "weapon", "sword": "weapon"}
#: Terms that a prompt may hold besides the labels of its bucket.
PROMPT_EXTRAS = {
    "weapon": ("gun", "knife", "firearm", "rifle"),
    "blood": ("gore",),
    "self_harm": ("suicide",),
    "violence": ("murder", "assault"),
}
BUCKETS = {
    "weapon": lex.WEAPON_LABELS,
    "blood": lex.BLOOD_LABELS,
    "self_harm": lex.SELF_HARM_LABELS,
    "violence": lex.VIOLENCE_LABELS,
}
FLOOR = 0.15


def normal_labels(labels: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x.strip().lower().replace("-", " ").replace("_", " ") for x in labels))


def remapped(detections: Column, least: float = 0.30) -> Column:
    """Detections of enough confidence with their moderation class, confidence to four places."""
    table = F.create_map(*[F.lit(x) for pair in REMAPPED.items() for x in pair])
    name = lambda d: F.lower(d["class"])
    return F.transform(
        F.filter(detections, lambda d: d["confidence"] >= least),
        lambda d: F.struct(
            F.coalesce(table[name(d)], name(d)).alias("class"), F.round(d["confidence"], 4).alias("confidence")
        ),
    )


def with_crowd(detections: Column, people: int = 5) -> Column:
    """Append a crowd with the mean confidence where there are enough persons."""
    persons = F.transform(F.filter(detections, lambda d: d["class"] == "person"), lambda d: d["confidence"])
    mean = F.aggregate(persons, F.lit(0.0), lambda a, x: a + x) / F.size(persons)
    crowd = F.struct(F.lit("crowd").alias("class"), F.round(mean, 4).alias("confidence"))
    return F.when(F.size(persons) >= people, F.concat(detections, F.array(crowd))).otherwise(detections)


def _earlier_apart(lists: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """The normal labels of each list but for those that an earlier list has."""
    before: tuple[str, ...] = ()
    out = {}
    for name, labels in lists.items():
        out[name] = tuple(x for x in normal_labels(labels) if x not in before)
        before += normal_labels(labels)
    return out


#: Labels of detections by the score that they count in; a label counts in the first bucket that has it.
LABELS = _earlier_apart(BUCKETS) | {
    "child": normal_labels(lex.CHILD_LABELS + lex.CHILD_ALIASES), "person": normal_labels(lex.PERSON_LABELS), "objects": normal_labels(lex.PROMOTION_OBJECTS),
}
#: Terms that a prompt's name holds, and names that a prompt has, by the score that it counts in.
TERMS = {name: normal_labels(labels + PROMPT_EXTRAS[name]) for name, labels in BUCKETS.items()} | {"child": normal_labels(lex.CHILD_TERMS)}
PROMOTING = _earlier_apart({"advertising_score": lex.ADVERTISING_PROMPTS, "affiliate_score": lex.AFFILIATE_PROMPTS, "social_media_score": lex.SOCIAL_MEDIA_PROMPTS})


@dataclass(frozen=True)
class Bests:
    """A column of the best score of each list; it stands for the detections or prompts that these were taken from."""

    found: Column


def label_bests(detections: Column | Bests, *names: str) -> Column:
    """A struct of the highest confidence of each list of labels, 0 if there is none; a label is normalised once for all lists."""
    if isinstance(detections, Bests):
        return detections.found
    items = F.transform(detections, lambda d: F.struct(label_norm(d["class"]).alias("name"), clamp(d["confidence"]).alias("score")))
    score = lambda x: x["score"]
    best = lambda xs, own: F.coalesce(F.array_max(F.transform(F.filter(xs, lambda x: x["name"].isin(*own)), score)), F.lit(0.0))
    return once(items, lambda xs: F.struct(*[best(xs, LABELS[k]).alias(k) for k in names or LABELS]))


def prompt_bests(prompts: Column | Bests, *names: str) -> Column:
    """A struct of the highest score of the prompts of each list, 0 if there is none; a prompt's name is normalised once for all lists."""
    if isinstance(prompts, Bests):
        return prompts.found

    def belongs(name: Column, k: str) -> Column:
        if k in PROMOTING:
            return name.isin(*PROMOTING[k])
        return functools.reduce(operator.or_, [F.contains(name, F.lit(t)) for t in TERMS[k]])

    items = F.transform(F.map_entries(prompts), lambda e: F.struct(label_norm(e["key"]).alias("name"), e["value"].alias("score")))
    score = lambda x: x["score"]
    best = lambda xs, k: clamp(F.array_max(F.transform(F.filter(xs, lambda x: belongs(x["name"], k)), score)))
    return once(items, lambda xs: F.struct(*[best(xs, k).alias(k) for k in names or (*TERMS, *PROMOTING)]))


def with_bests(df: DataFrame, detections: Column, prompts: Column) -> tuple[DataFrame, Bests, Bests]:
    """The rows with the best scores of all lists in columns of their own, and what stands for detections and prompts where scores are made."""
    return df.withColumns({"label_bests": label_bests(detections), "prompt_bests": prompt_bests(prompts)}), Bests(F.col("label_bests")), Bests(F.col("prompt_bests"))


def bucket_scores(detections: Column | Bests) -> dict[str, Column]:
    """One score a bucket; a label counts in the first bucket that has it."""
    found = label_bests(detections, *BUCKETS)
    return {name: found[name] for name in BUCKETS}


def prompt_buckets(prompts: Column | Bests) -> dict[str, Column]:
    """Highest score of the prompts that hold a term of each bucket as a substring."""
    found = prompt_bests(prompts, *BUCKETS)
    return {name: found[name] for name in BUCKETS}


def fuse_pair(seen: Column, read: Column) -> Column:
    """A detector's and a prompt model's score; their agreement counts where both are above the floor."""
    both = F.when((seen > FLOOR) & (read > FLOOR), F.sqrt(seen * read)).otherwise(0.0)
    return clamp(F.greatest(seen * 0.85, read * 0.60, both * 0.95))


def safety_scores(detections: Column | Bests, prompts: Column | Bests) -> dict[str, Column]:
    seen, read = bucket_scores(detections), prompt_buckets(prompts)
    out = {f"{name}_score": fuse_pair(seen[name], read[name]) for name in ("weapon", "blood", "self_harm")}
    violence = fuse_pair(seen["violence"], read["violence"])
    return out | {"violence_self_harm_score": F.greatest(violence, *out.values())}


def child_scores(detections: Column | Bests, prompts: Column | Bests) -> dict[str, Column]:
    found = label_bests(detections, "child", "person")
    child, person, read = found["child"], found["person"], prompt_bests(prompts, "child")["child"]
    weak = F.when((person > FLOOR) & (read > FLOOR), F.least(person, read) * 0.15).otherwise(0.0)
    return {
        "child_presence_score": clamp(F.greatest(child, read, person * 0.25)),
        "child_safety_score": clamp(F.greatest(fuse_pair(child, read), weak)),
    }


def noisy_or(*scores: Column) -> Column:
    """The strongest score, or 0.85 of the chance that any holds."""
    none: Column = F.lit(1.0)
    for s in scores:
        none = none * (F.lit(1.0) - clamp(s))
    return clamp(F.greatest(*[clamp(s) for s in scores], (F.lit(1.0) - none) * 0.85) if scores else F.lit(0.0))


def promotion_support(detections: Column | Bests) -> Column:
    return label_bests(detections, "objects")["objects"] * 0.25


def promotion_scores(texts: dict[str, Column], prompts: Column | Bests, detections: Column | Bests) -> dict[str, Column]:
    """Advertising, affiliate and social media scores from texts, prompts and objects, and the largest of them."""
    read = prompt_bests(prompts, *PROMOTING)
    out = {}
    for name in PROMOTING:
        out[name] = noisy_or(texts[name], read[name], *([promotion_support(detections)] if name == "advertising_score" else []))
    return out | {"promotion_score": F.greatest(*out.values())}


#: How much a detected class counts towards the objects' risk.
RISK_WEIGHTS = {"weapon": 0.90, "blood": 0.80, "fire": 0.40, "gun": 0.90, "knife": 0.70}


def object_risk(detections: Column) -> Column:
    """Largest weighted and calibrated confidence of the classes that count, 0 if there is none."""
    table = F.create_map(*[F.lit(x) for pair in RISK_WEIGHTS.items() for x in pair])
    weight = lambda d: F.coalesce(F.try_element_at(table, F.lower(d["class"])), F.lit(0.0))
    risks = F.transform(detections, lambda d: weight(d) * calibrated(F.coalesce(d["confidence"], F.lit(0.0)), OBJECT_TEMPERATURE))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.array_max(risks), F.lit(0.0))))


def first_of_each(items: Column) -> Column:
    """Trimmed, non-blank items without repeats in any case; the first spelling stays."""
    trimmed = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    lower = F.transform(trimmed, lambda x: F.lower(x))
    return F.filter(trimmed, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)
