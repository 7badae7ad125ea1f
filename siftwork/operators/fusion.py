"""How scores are put together: ensembles, calibration, uncertainty, and the text score map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions import lexicons as lex
from siftwork.functions.text import Searched, clamp, grouped_score, has_any, linear_score, phrase_count, step_score

#: Weights of the ensembles.
PRE_WEIGHTS = (0.30, 0.25, 0.18, 0.12, 0.10, 0.05)
IMAGE_WEIGHTS = (0.30, 0.24, 0.18, 0.12, 0.12, 0.04)
DEFAULT_TEMPERATURE = 1.6
OBJECT_TEMPERATURE = 1.4


def weighted_risk(weights: tuple[float, ...], adult: Column, child: Column, violence: Column, fraud: Column, weapon: Column, heritage: Column) -> Column:
    a, c, v, f, w, h = weights
    return clamp(adult * a + child * c + violence * v + fraud * f + weapon * w + (F.lit(1.0) - clamp(heritage)) * h)


def needs_second_look(risk: Column) -> Column:
    return (risk > 0.60) & (risk < 0.85)


def protected(scores: dict[str, Column], heritage: Column, text: Column) -> dict[str, Column]:
    """Lower what a heritage context explains; what concerns children is never lowered."""
    is_heritage = (heritage > 0.60) | has_any(F.lower(text), lex.HERITAGE_LABELS)
    return {
        k: v if k.startswith("child") else F.when(is_heritage, v * 0.70).otherwise(v) for k, v in scores.items()
    }


def calibrated(score: Column, temperature: float = DEFAULT_TEMPERATURE) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score / temperature))


def verdict_risk(decision: Column, confidence: Column) -> dict[str, Column]:
    """Risk and approval of a reviewer's verdict; without one 0.5 and no approval."""
    sure = clamp(F.coalesce(confidence, F.lit(0.5)))
    kind = F.upper(F.coalesce(decision, F.lit("UNDER_REVIEW")))
    return {
        "verdict_risk": F.when(kind == "REJECTED", sure).when(kind == "APPROVED", F.lit(1.0) - sure).otherwise(0.5),
        "verdict_approves": F.when(kind == "APPROVED", sure).otherwise(0.0),
    }


def toxicity_scores(p: dict[str, Column]) -> dict[str, Column]:
    """Moderation scores of a toxicity model's outputs."""
    return {
        "adult": clamp(F.greatest(p["obscene"] * 0.75, p["sexual_explicit"] * 0.90)),
        "violence": clamp(p["threat"] * 0.90),
        "harassment": clamp(F.greatest(p["insult"], p["severe_toxicity"])),
        "hate_speech": clamp(p["identity_attack"] * 1.10),
        "toxicity": clamp(p["toxicity"]),
    }


def variance(signals: list[Column]) -> Column:
    n = float(len(signals))
    mean = sum(signals[1:], signals[0]) / n
    squares = [F.pow(s - mean, 2) for s in signals]
    return F.least(F.lit(1.0), sum(squares[1:], squares[0]) / n * 4.0)


def entropy(signals: list[Column]) -> Column:
    """Entropy of the signals' shares, 1 if all are alike and 0 if none is there."""
    total = sum(signals[1:], signals[0]) + 1e-10
    parts = [F.when(s / total > 1e-10, -(s / total) * F.log2(s / total)).otherwise(0.0) for s in signals]
    whole = sum(parts[1:], parts[0]) / F.log2(F.lit(float(len(signals))))
    return F.when(F.greatest(*signals) == 0.0, 0.0).otherwise(clamp(whole))


def token_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct tokens; two empty ones are alike, one empty one is not."""
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    )


def disagreement(signals: list[Column], decision: Column, confidence: Column) -> Column:
    most = F.greatest(*signals)
    sure = clamp(F.coalesce(confidence, F.lit(0.5)))
    kind = F.upper(F.coalesce(decision, F.lit("UNDER_REVIEW")))
    return clamp(
        F.when((kind == "APPROVED") & (most > 0.50), most)
        .when((kind == "REJECTED") & (most < 0.30), F.lit(1.0) - most)
        .when(kind == "REJECTED", F.abs(most - sure) * 0.5)
        .otherwise(F.abs(most - (F.lit(1.0) - sure)) * 0.5)
    )


def uncertainty(signals: list[Column], caption_similarity: Column, decision: Column, confidence: Column) -> Column:
    return clamp(
        variance(signals) * 0.30
        + entropy(signals) * 0.30
        + (F.lit(1.0) - caption_similarity) * 0.20
        + disagreement(signals, decision, confidence) * 0.20
    )


def safety_text_scores(text: Column | Searched) -> dict[str, Column]:
    """The eight rule scores of a normalised text."""
    return {key: grouped_score(text, rules) for key, rules in lex.SAFETY_RULES.items()}


def promotion_text_scores(text: Column | Searched) -> dict[str, Column]:
    marketing = phrase_count(text, lex.MARKETING_PHRASES).cast("double")
    course = linear_score(phrase_count(text, lex.COURSE_PHRASES), 0.55)
    return {
        "marketing_keyword_count": marketing,
        "course_promotion_score": course,
        "political_score": linear_score(phrase_count(text, lex.POLITICAL_TOPIC_PHRASES), 0.30),
        "political_campaign_score": linear_score(phrase_count(text, lex.POLITICAL_CAMPAIGN_PHRASES), 0.45),
        "promotion_score": clamp(F.greatest(F.least(marketing / 4.0, F.lit(1.0)) * 0.85, course * 0.90)),
    }


def violence_text_scores(text: Column | Searched) -> dict[str, Column]:
    return {
        "animal_cruelty_text_score": linear_score(phrase_count(text, lex.ANIMAL_CRUELTY_PHRASES), 0.55),
        "human_killing_text_score": linear_score(phrase_count(text, lex.HUMAN_KILLING_PHRASES), 0.50),
    }


def heritage_text_score(text: Column | Searched) -> Column:
    return step_score(phrase_count(text, lex.HERITAGE_KEYWORDS))


def text_score_map(
    toxicity: dict[str, Column], rules: dict[str, Column], promotion: dict[str, Column],
    violence: dict[str, Column], heritage: Column, verdict: dict[str, Column],
) -> dict[str, Column]:
    """All scores of a text post; what no source gives is 0 when it is read."""
    adult = clamp(toxicity["adult"])
    harm = clamp(F.greatest(toxicity["violence"], rules["harassment_score"] * 0.60))
    hate = clamp(F.greatest(toxicity["hate_speech"], rules["hate_speech_score"]))
    harassment = clamp(F.greatest(toxicity["harassment"], rules["harassment_score"]))
    self_harm = rules["self_harm_text_score"]
    strongest = F.greatest(
        adult, harm, hate, harassment, rules["terrorism_score"] * 1.10, rules["fraud_score"], self_harm,
        toxicity["toxicity"] * 0.80,
    )
    return {
        "adult_score": adult,
        "nsfw_score": adult,
        "violence_self_harm_score": harm,
        "self_harm_text_score": self_harm,
        "self_harm_score": self_harm,
        "hate_speech_score": hate,
        "harassment_score": harassment,
        "terrorism_score": rules["terrorism_score"],
        "fraud_score": rules["fraud_score"],
        "misinformation_score": rules["misinformation_score"],
        **promotion,
        **violence,
        "heritage_score": heritage,
        "llama_risk_score": verdict["verdict_risk"],
        "llama_approves": verdict["verdict_approves"],
        "ensemble_risk_score": clamp(strongest * 0.90 + verdict["verdict_risk"] * 0.10),
    }
