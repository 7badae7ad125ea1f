"""The public risk report and the first-match decision cascade, both over a map of named scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The public categories and the scores that feed each.
ALIASES = {
    "adult_content": ("adult_score", "nsfw_score", "explicit_score"),
    "violence": ("violence_score", "violence_self_harm_score"),
    "graphic_violence": ("graphic_violence_score", "gore_score", "blood_score"),
    "weapons": ("weapon_score", "weapons_score"),
    "drugs": ("drug_score", "drugs_score", "drug_trafficking_score"),
    "alcohol": ("alcohol_score",),
    "smoking": ("smoking_score",),
    "gambling": ("gambling_score",),
    "blood": ("blood_score",),
    "nudity": ("nudity_score", "adult_score"),
    "suggestive_content": ("suggestive_score", "racy_score"),
    "hate_symbol": ("hate_symbol_score",),
    "hate_speech": ("hate_speech_score", "ml_hate_score"),
    "toxic_text": ("toxic_text_score", "ml_toxicity_score"),
    "abusive_text": ("abusive_text_score", "harassment_score", "text_classifier_score"),
    "political_propaganda": ("political_propaganda_score", "political_campaign_score", "political_score"),
    "religious_extremism": ("religious_extremism_score", "extremism_score"),
    "child_safety_risk": ("child_safety_score", "child_safety_risk_score"),
    "pii_detection": ("pii_score", "pii_detection_score"),
    "qr_code": ("qr_code_score",),
    "document": ("document_score",),
    "watermark": ("watermark_score",),
    "spam": ("spam_score", "promotion_score", "advertising_score"),
    "scam": ("scam_score", "fraud_score"),
    "misinformation": ("misinformation_score",),
    "self_harm": ("self_harm_score", "self_harm_text_score", "violence_self_harm_score"),
    "medical_content": ("medical_content_score", "medical_score"),
}

# The scores that the cascade reads.
CASCADE_KEYS = (
    "adult_score", "nsfw_score", "visual_explicit_indicator", "child_safety_score", "violence_self_harm_score",
    "weapon_score", "blood_score", "self_harm_score", "self_harm_text_score", "heritage_score",
    "animal_cruelty_text_score", "human_killing_text_score", "promotion_score", "social_media_score",
    "marketing_keyword_count", "course_promotion_score", "political_score", "political_campaign_score",
    "phone_number_score", "social_handle_score", "url_score", "qr_code_score", "ml_hate_score", "ml_toxicity_score",
    "hate_speech_score", "harassment_score", "video_unsafe_frame_ratio", "video_consecutive_unsafe_frames",
    "drug_trafficking_score", "human_trafficking_score", "terrorism_score", "pii_score", "fraud_score",
    "content_quality_score", "ensemble_risk_score", "uncertainty_score", "misinformation_score", "advertising_score",
    "affiliate_score", "child_presence_score", "gambling_score",
)

#: What the rules are written in, as SQL over the score columns.
TERMS = {
    "self_harm": "greatest(self_harm_score, self_harm_text_score)",
    "adult": "least(1.0, greatest(adult_score, nsfw_score) + case when visual_explicit_indicator >= 0.5 then 0.10 else 0.0 end)",
    "kept": "case when heritage_score > 0.65 then 0.70 else 1.0 end",
    "penalty": "case when child_safety_score >= 0.45 and child_safety_score < 0.65 then 0.10 else 0.0 end",
}
WEAPON, BLOOD = "weapon_score * {kept}", "blood_score * {kept}"
VIOLENCE, SELF_HARM = "violence_self_harm_score * {kept}", "{self_harm} * {kept}"
SOFT = (
    "greatest(ml_toxicity_score, ml_hate_score, hate_speech_score, harassment_score, political_score, "
    "political_campaign_score, phone_number_score, social_handle_score, url_score, qr_code_score)"
)
CLASHING = f"greatest(child_safety_score, {VIOLENCE}, {WEAPON})"

# The cascade. The first rule that holds decides: (rule, condition, decision, reason).
REJECT, REVIEW, APPROVE = "REJECTED", "UNDER_REVIEW", "APPROVED"
CASCADE = (
    ("R01", "{adult} >= 0.90", REJECT, "EXPLICIT_PORNOGRAPHIC_CONTENT"),
    ("R02", "adult_score >= 0.45 and greatest(child_safety_score, violence_self_harm_score, weapon_score, blood_score) >= 0.30", REJECT, "HIGH_RISK_EXPLICIT_CONTENT"),
    ("R03", "violence_self_harm_score >= 0.90", REJECT, "VIOLENCE_CONTENT"),
    ("R04", "blood_score >= 0.90", REJECT, "GORE_CONTENT"),
    ("R05", "weapon_score >= 0.90", REJECT, "WEAPON_CONTENT"),
    ("R06", "weapon_score >= 0.40 and violence_self_harm_score >= 0.35 and heritage_score < 0.45", REJECT, "WEAPON_VIOLENCE"),
    ("R07", "weapon_score >= 0.35 and blood_score >= 0.35 and heritage_score < 0.45", REJECT, "WEAPON_GORE"),
    ("R08", "violence_self_harm_score >= 0.35 and blood_score >= 0.35 and heritage_score < 0.45", REJECT, "VIOLENT_GORE"),
    ("R09", "animal_cruelty_text_score >= 0.5", REJECT, "ANIMAL_CRUELTY"),
    ("R10", "human_killing_text_score >= 0.5", REJECT, "HUMAN_KILLING"),
    ("R11", "{self_harm} >= 0.90", REJECT, "SELF_HARM_CONTENT"),
    ("R12", "promotion_score >= 0.90", REJECT, "PROMOTIONAL_SPAM"),
    ("R13", "social_media_score >= 0.30", REJECT, "PROMOTIONAL_SPAM"),
    ("R14", "marketing_keyword_count >= 1.0", REJECT, "MARKETING_CONTENT"),
    ("R15", "course_promotion_score >= 0.10", REJECT, "COURSE_PROMOTION"),
    ("R16", "political_score >= 0.55 or political_campaign_score >= 0.45", REJECT, "POLITICAL_CAMPAIGN"),
    ("R17", "phone_number_score >= 0.35", REJECT, "PHONE_NUMBER_SPAM"),
    ("R18", "social_handle_score >= 0.25", REJECT, "SOCIAL_HANDLE_SPAM"),
    ("R19", "url_score >= 0.35", REJECT, "URL_IN_IMAGE"),
    ("R20", "qr_code_score >= 0.50", REJECT, "QR_CODE_PROMOTION"),
    ("R21", "ml_hate_score >= 0.70", REJECT, "HATE_SPEECH_REJECTION"),
    ("R22", "ml_toxicity_score >= 0.75", REJECT, "TOXIC_CONTENT"),
    ("R23", "ml_hate_score >= 0.50", REVIEW, "HATE_SPEECH_REJECTION"),
    ("R24", "hate_speech_score >= 0.55", REJECT, "HATE_SPEECH_REJECTION"),
    ("R25", "video_unsafe_frame_ratio >= 0.15", REJECT, "VIDEO_UNSAFE_FRAMES"),
    ("R26", "video_consecutive_unsafe_frames >= 3.0", REJECT, "VIDEO_UNSAFE_FRAMES"),
    ("R27", "child_safety_score >= 0.65", REVIEW, "CHILD_SAFETY_ALERT"),
    ("R28", "drug_trafficking_score > 0.60", REJECT, "DRUG_TRAFFICKING_CONTENT"),
    ("R29", "human_trafficking_score > 0.60", REJECT, "HUMAN_TRAFFICKING_CONTENT"),
    ("R30", "terrorism_score > 0.60", REJECT, "TERRORISM_CONTENT"),
    ("R31", f"{SELF_HARM} > 0.65 and heritage_score >= 0.45", REVIEW, "HERITAGE_REVIEW"),
    ("R31", f"{SELF_HARM} > 0.65", REJECT, "SELF_HARM_CONTENT"),
    ("R32", f"({VIOLENCE} > 0.65 or {BLOOD} > 0.65) and heritage_score >= 0.45", REVIEW, "HERITAGE_REVIEW"),
    ("R32", f"{VIOLENCE} > 0.65 or {BLOOD} > 0.65", REJECT, "VIOLENCE_CONTENT"),
    ("R33", f"{WEAPON} > 0.70 and heritage_score >= 0.45", REVIEW, "HERITAGE_REVIEW"),
    ("R33", f"{WEAPON} > 0.70", REJECT, "WEAPON_CONTENT"),
    ("R34", "adult_score > 0.65 and not heritage_score > 0.50", REJECT, "NSFW_CONTENT"),
    ("R35", "pii_score > 0.60", REVIEW, "PRIVACY_VIOLATION"),
    ("R36", "fraud_score > 0.60", REJECT, "FRAUD_CONTENT"),
    ("R37", "hate_speech_score > 0.70", REJECT, "HATE_SPEECH"),
    ("R38", "harassment_score > 0.65", REJECT, "HARASSMENT"),
    ("R39", "promotion_score > 0.70", REVIEW, "PROMOTION_CONTENT"),
    ("R40", "content_quality_score > 0.35", REVIEW, "LOW_CONTENT_QUALITY"),
    ("R41", "least(1.0, ensemble_risk_score + {penalty}) > 0.75", REVIEW, "ENSEMBLE_REVIEW"),
    ("R42", "uncertainty_score > 0.35", REVIEW, "HIGH_UNCERTAINTY"),
    ("R43", f"{CLASHING} > 0.50 and {CLASHING} < 0.90 and heritage_score > 0.50", REVIEW, "DISAGREE_CONTENT"),
    ("R44", "adult_score > 0.65 and heritage_score > 0.50", REVIEW, "HERITAGE_REVIEW"),
    ("R45", f"{SOFT} >= 0.20", REVIEW, "ENSEMBLE_REVIEW"),
    ("R46", "uncertainty_score >= 0.25", REVIEW, "HIGH_UNCERTAINTY"),
)


# What is said of each rule's decision; R31 to R33 say two things.
REASONS = {
    "R01": "Rejected: explicit pornographic content detected with high confidence.",
    "R02": "Rejected: adult content combined with high-risk signal (violence, weapon, or child safety).",
    "R03": "Rejected: high-confidence violent content detected.",
    "R04": "Rejected: graphic gore or blood content detected.",
    "R05": "Rejected: dangerous weapon content detected with high confidence.",
    "R06": "Rejected: combined weapon and violence signals exceed safe thresholds.",
    "R07": "Rejected: combined weapon and gore signals exceed safe thresholds.",
    "R08": "Rejected: combined violence and gore signals exceed safe thresholds.",
    "R09": "Rejected: animal cruelty or abuse content detected.",
    "R10": "Rejected: content depicting murder, execution, or lethal human violence.",
    "R11": "Rejected: self-harm content detected with high confidence.",
    "R12": "Rejected: high-confidence promotional or spam content detected.",
    "R13": "Rejected: social media follow/subscribe solicitation detected.",
    "R14": "Rejected: multiple marketing or commercial keywords detected.",
    "R15": "Rejected: paid course or class marketing content detected.",
    "R16": "Rejected: political campaign, vote-solicitation, or party promotion detected.",
    "R17": "Rejected: phone number detected — promotional or spam content.",
    "R18": "Rejected: social media handle (@username) detected — promotional content.",
    "R19": "Rejected: external URL detected in image.",
    "R20": "Rejected: QR code detected — likely links to external promotion or payment.",
    "R21": "Rejected: ML model detected hate speech or community targeting with high confidence.",
    "R22": "Rejected: ML model detected highly toxic content.",
    "R23": "Flagged for review: elevated hate speech signal detected by ML model.",
    "R24": "Rejected: rule-based hate speech detection — religious, racial, or ethnic hatred.",
    "R25": "Rejected: {percent} of video frames contain unsafe content (threshold 15%).",
    "R26": "Rejected: {run} consecutive unsafe frames detected (threshold 3).",
    "R27": "Child safety risk requires manual review.",
    "R28": "Rejected because drug trafficking content exceeded the allowed threshold.",
    "R29": "Rejected because human trafficking content exceeded the allowed threshold.",
    "R30": "Rejected because terrorism or illegal-content risk exceeded the allowed threshold.",
    "R31 HERITAGE_REVIEW": "Heritage content with elevated self-harm signal requires manual review.",
    "R31": "Rejected because self-harm risk exceeded the allowed threshold.",
    "R32 HERITAGE_REVIEW": "Heritage content with elevated violence signal requires manual review.",
    "R32": "Rejected because violence risk exceeded the allowed threshold.",
    "R33 HERITAGE_REVIEW": "Heritage content with elevated weapon signal requires manual review.",
    "R33": "Rejected because weapon-content risk exceeded the allowed threshold.",
    "R34": "Rejected because adult-content risk exceeded the allowed threshold without sufficient heritage relevance.",
    "R35": "Privacy or personally identifiable information risk requires manual review.",
    "R36": "Rejected because fraud or scam risk exceeded the allowed threshold.",
    "R37": "Rejected because hate-speech risk exceeded the allowed threshold.",
    "R38": "Rejected because harassment or targeted-abuse risk exceeded the allowed threshold.",
    "R39": "Promotion or advertising risk exceeded the automatic approval threshold.",
    "R40": "Content quality risk exceeded the automatic approval threshold.",
    "R41": "Combined model risk score is elevated; routed for human review.",
    "R42": "High model uncertainty detected; routed for human review.",
    "R43": "Elevated risk signal alongside high heritage score indicates ambiguous cultural content; routed for human review.",
    "R44": "Adult-content risk detected alongside strong heritage relevance; routed for heritage exception review.",
    "R45": "One or more signals are elevated but below hard-reject; routed for human review.",
    "R46": "Low model confidence — routed for human review rather than automatic approval.",
    "R47": "Approved: all safety, promotion, hate speech, and quality checks passed.",
}


def reason_text() -> Column:
    """What is said of a decision, from ``rule``, ``code`` and the video scores; shares and runs are rounded half to even."""
    table = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    said = F.coalesce(F.try_element_at(table, F.concat_ws(" ", "rule", "code")), F.try_element_at(table, F.col("rule")))
    whole = lambda x: F.bround(x, 0).cast("long").cast("string")
    filled = F.replace(said, F.lit("{percent}"), F.concat(whole(F.col("video_unsafe_frame_ratio") * 100), F.lit("%")))
    return F.replace(filled, F.lit("{run}"), whole(F.col("video_consecutive_unsafe_frames")))


def cascade_sql(pick: str) -> str:
    """The cascade as one CASE; ``pick`` is 'rule', 'decision' or 'code'."""
    at = {"rule": 0, "decision": 2, "code": 3}[pick]
    last = {"rule": "R47", "decision": APPROVE, "code": APPROVE}[pick]
    terms = {k: f"({v})" for k, v in TERMS.items()}
    whens = " ".join(f"when {r[1].format(**terms)} then '{r[at]}'" for r in CASCADE)
    return f"case {whens} else '{last}' end"


def _first_rule_sql() -> str:
    """The place in the cascade, from 1, of the first rule that holds; one behind its end if none does."""
    terms = {k: f"({v})" for k, v in TERMS.items()}
    whens = " ".join(f"when {r[1].format(**terms)} then {at}" for at, r in enumerate(CASCADE, 1))
    return f"case {whens} else {len(CASCADE) + 1} end"


def small_methods(spark: SparkSession) -> None:
    """Let the session give up code for a whole stage where it would be a method too large for the JVM to compile (8,000 bytes), and run in the interpreter.

    Spark's usual limit is eight times that. A setting of the session's own stays; it is read when the query runs.
    """
    key, usual, compiled = "spark.sql.codegen.hugeMethodLimit", 65535, 8000
    if int(spark.conf.get(key)) == usual:
        spark.conf.set(key, str(compiled))


def with_scores(df: DataFrame, keys: tuple[str, ...] = CASCADE_KEYS) -> DataFrame:
    """Every score as a double column: missing ones, nulls and what is no number read as 0."""
    missing = {k: F.lit(0.0) for k in keys if k not in df.columns}
    there = {k: F.coalesce(F.expr(f"try_cast(`{k}` as double)"), F.lit(0.0)) for k in keys if k in df.columns}
    return df.withColumns(missing | there)


def decide_cascade(df: DataFrame) -> DataFrame:
    """Add ``rule``, ``decision`` and ``code`` of the first rule that holds, and ``reason``, the words for it."""
    small_methods(df.sparkSession)
    # the conditions are tested once, for the number of the rule; what it stands for is looked up
    found = with_scores(df).withColumn("__first", F.expr(_first_rule_sql()))
    rules = (*CASCADE, ("R47", None, APPROVE, APPROVE))
    named = lambda at: F.element_at(F.array(*[F.lit(r[at]) for r in rules]), F.col("__first"))
    decided = found.withColumns({"rule": named(0), "decision": named(2), "code": named(3)}).drop("__first")
    return decided.withColumn("reason", reason_text())


def percent(c: Column) -> Column:
    """A score of up to 1 as a share, a larger one as a percentage; one decimal."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.when(c <= 1.0, c * 100.0).otherwise(c), F.lit(100.0))), 1)


def categories(scores: dict[str, Column]) -> dict[str, Column]:
    """The public categories of named scores, in percent."""
    out = {
        name: F.greatest(F.lit(0.0), F.lit(0.0), *[percent(scores[k]) for k in keys if k in scores])
        for name, keys in ALIASES.items()
    }
    out["graphic_violence"] = F.greatest(out["graphic_violence"], out["violence"] * 0.8)
    out["nudity"] = F.greatest(out["nudity"], out["adult_content"] * 0.6)
    return {k: F.round(v, 1) for k, v in out.items()}


def overall(found: dict[str, Column], scores: dict[str, Column], more: tuple[Column, ...] = ()) -> Column:
    return F.round(F.greatest(percent(scores.get("ensemble_risk_score", F.lit(0.0))), *found.values(), *more), 1)


def risk_level(total: Column, adult: Column, child: Column, weapons: Column) -> dict[str, Column]:
    critical = (total >= 90) | (adult >= 90) | (child >= 80)
    level = (
        F.when(critical, "CRITICAL")
        .when(total >= 70, "HIGH RISK")
        .when((total >= 40) | (weapons >= 70), "MEDIUM RISK")
        .when(total >= 20, "LOW RISK")
        .otherwise("SAFE")
    )
    by = lambda *values: F.create_map(
        *[F.lit(x) for pair in zip(("CRITICAL", "HIGH RISK", "MEDIUM RISK", "LOW RISK", "SAFE"), values) for x in pair]
    )[level]
    return {
        "risk_level": level,
        "decision": by("Reject", "Review Required", "Review Required", "Accept", "Accept"),
        "recommendation": by("Reject", "Human Review", "Human Review", "Allow with Monitoring", "Allow"),
    }


def report(df: DataFrame, keys: list[str], error: Column | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    """Add the categories in percent, the overall score and the decision.

    After an error the overall score is 40 at least.
    """
    small_methods(df.sparkSession)
    scores = {k: F.col(k) for k in keys}
    found = df.withColumns(categories(scores))
    total = overall({k: F.col(k) for k in ALIASES}, scores, more)
    if error is not None:
        total = F.when(error, F.greatest(total, F.lit(40.0))).otherwise(total)
    found = found.withColumn("overall_score", total)
    return found.withColumns(
        risk_level(F.col("overall_score"), F.col("adult_content"), F.col("child_safety_risk"), F.col("weapons"))
    )
