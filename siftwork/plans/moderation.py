"""Whole moderation paths: from posts, frames and documents to a report and a decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import detectors
from siftwork.functions.phrases import searched, whole_lexicon
from siftwork.functions.text import joined, normalise
from siftwork.operators import decision, frames, fusion
from siftwork.operators import detections as det

#: What a document's report shows of its text and links.
PREVIEW, SHOWN_LINKS = 2000, 50
#: Columns that a toxicity provider may add; those missing read as 0.
TOXICITY = ("toxicity", "severe_toxicity", "obscene", "identity_attack", "insult", "threat", "sexual_explicit")


def text_scores(posts: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the score map of every text post as columns, ``blocked`` and ``pipeline_error`` (empty text)."""
    df = posts.withColumn("norm", normalise(F.col(text_col)))
    raw = {k: F.coalesce(F.col(k).cast("double"), F.lit(0.0)) if k in posts.columns else F.lit(0.0) for k in TOXICITY}
    verdict = fusion.verdict_risk(
        F.col("verdict") if "verdict" in posts.columns else F.lit(None).cast("string"),
        F.col("confidence") if "confidence" in posts.columns else F.lit(None).cast("double"),
    )
    # the text is searched once for all phrases; each source has a projection of its own
    df, norm = searched(df, "norm", whole_lexicon())
    df = df.withColumns({f"rule_{k}": v for k, v in fusion.safety_text_scores(norm).items()})
    df = df.withColumns({f"promo_{k}": v for k, v in fusion.promotion_text_scores(norm).items()})
    df = df.withColumns({f"harm_{k}": v for k, v in fusion.violence_text_scores(norm).items()})
    df = df.withColumn("heritage_found", fusion.heritage_text_score(norm))
    rules = {c[5:]: F.col(c) for c in df.columns if c.startswith("rule_")}
    promotion = {c[6:]: F.col(c) for c in df.columns if c.startswith("promo_")}
    violence = {c[5:]: F.col(c) for c in df.columns if c.startswith("harm_")}
    scores = fusion.text_score_map(
        fusion.toxicity_scores(raw), rules, promotion, violence, F.col("heritage_found"), verdict
    )
    empty = F.col("norm") == ""
    scored = df.withColumns({k: F.when(empty, 0.0).otherwise(v) for k, v in scores.items()})
    scored = scored.withColumn("pipeline_error", empty).withColumn("blocked", detectors.blocked(norm))
    drop = [c for c in scored.columns if c.split("_")[0] in ("rule", "promo", "harm")] + ["heritage_found", "found"]
    return scored.drop(*drop)


def moderate_text(posts: DataFrame, text_col: str = "text") -> DataFrame:
    """Score posts, report them, and decide them by the report and by the cascade."""
    scored = text_scores(posts, text_col)
    keys = [c for c in scored.columns if c.endswith("_score")]
    reported = decision.report(scored, keys, F.col("pipeline_error"))
    reported = reported.withColumnRenamed("decision", "report_decision")
    return decision.decide_cascade(reported)


def moderate_documents(docs: DataFrame, text_col: str = "text", images_col: str | None = None) -> DataFrame:
    """Report extracted documents: link, lexical and personal data scores count towards the overall one.

    Adds ``preview`` (the first ``PREVIEW`` characters) and ``first_links`` (``SHOWN_LINKS`` at most).
    """
    text = normalise(F.col(text_col))
    found = docs.withColumn("links", detectors.links(F.coalesce(F.col(text_col), F.lit("")))).withColumn("norm", text)
    images = F.col(images_col) if images_col else F.lit(0)
    scores = detectors.link_scores(F.col("norm"), F.col("links")) | detectors.document_scores(F.col("norm"), images, F.lit(0))
    scored = found.withColumns(scores).withColumn("pii_score", detectors.pii_score(detectors.pii_flags(F.col("norm"))))
    keys = [*scores, "pii_score"]
    more = tuple(
        F.round(F.col(k) * 100.0, 1)
        for k in (
            "phishing_score", "malware_links_score", "copyright_notice_score", "sensitive_document_score",
            "financial_information_score", "identity_document_score", "barcode_score",
        )
    )
    reported = decision.report(scored, keys, F.col("norm") == "", more)
    return reported.withColumns(
        {"preview": F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, PREVIEW), "first_links": F.slice("links", 1, SHOWN_LINKS)}
    )


def moderate_images(images: DataFrame) -> DataFrame:
    """Score, report and decide images from what models saw and read.

    Columns: ``detections`` (array of class and confidence), ``prompts`` (map of prompt scores),
    ``adult_score``, ``heritage_score``, ``ocr_text``, ``caption``, ``code_text`` (of machine-readable codes).
    """
    text = joined(F.col("ocr_text"), F.col("caption"))
    df = images.withColumn("norm", normalise(text)).withColumn("seen", det.remapped(F.col("detections")))
    df, norm = searched(df, "norm", whole_lexicon())
    # labels and prompts are normalised once for all scores
    df, seen, prompts = det.with_bests(df, F.col("seen"), F.col("prompts"))
    harm = det.safety_scores(seen, prompts) | det.child_scores(seen, prompts)
    df = df.withColumns(harm)
    df = df.withColumns(fusion.protected({k: F.col(k) for k in harm}, F.col("heritage_score"), text))
    df = df.withColumns({f"read_{k}": v for k, v in detectors.promo_scores(norm).items()})
    read = {k: F.col(f"read_{k}") for k in ("advertising_score", "affiliate_score", "social_media_score")}
    promo = det.promotion_scores(read, prompts, seen)
    with_codes = normalise(joined(F.col("ocr_text"), F.col("caption"), F.col("code_text")))
    contact = detectors.contact_signals(text, with_codes)
    contact |= {"marketing_keyword_count": contact.pop("marketing_words"), "course_promotion_score": contact.pop("course_score")}
    df = df.withColumns(promo | contact | fusion.safety_text_scores(norm))
    df = df.withColumns(
        {
            "pii_score": detectors.pii_score(detectors.pii_flags(F.col("norm"))),
            "content_quality_score": detectors.quality_score(norm),
            "qr_code_score": detectors.code_class(F.col("code_text"))["qr_code_score"],
            "nsfw_score": F.col("adult_score"),
        }
    )
    parts = [F.col(k) for k in ("adult_score", "child_safety_score", "violence_self_harm_score", "fraud_score", "weapon_score")]
    df = df.withColumns(
        {
            "ensemble_risk_score": fusion.weighted_risk(fusion.IMAGE_WEIGHTS, *parts, F.col("heritage_score")),
            "uncertainty_score": fusion.uncertainty(
                [*parts, F.col("terrorism_score")], F.lit(0.5), F.lit(None).cast("string"), F.lit(None).cast("double")
            ),
        }
    )
    keys = [c for c in df.columns if c.endswith("_score") and not c.startswith("read_")]
    reported = decision.report(df, keys).withColumnRenamed("decision", "report_decision")
    return decision.decide_cascade(reported).drop("norm", "seen", "found", "label_bests", "prompt_bests", *[c for c in df.columns if c.startswith("read_")])


def moderate_videos(shots: DataFrame, transcripts: DataFrame, key: str = "video") -> DataFrame:
    """Report and decide videos from the scores of their frames and of what is said."""
    merged = frames.merge_transcript(frames.summarise(shots, key), transcripts, key)
    keys = [c for c in merged.columns if c.endswith("_score")]
    reported = decision.report(merged, keys).withColumnRenamed("decision", "report_decision")
    return decision.decide_cascade(reported)
