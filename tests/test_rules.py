"""Truth tables of the cascade, the report, the phrase scores and the detectors."""

import pytest
from pyspark.sql import functions as F

from siftwork.functions import detectors, text
from siftwork.operators import decision, frames, fusion
from siftwork.operators import detections as det
from siftwork.plans import moderation


def cascade(spark, **scores):
    row = decision.decide_cascade(spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in (scores or {"x": 0.0}).items()])).first()
    return row["decision"], row["code"]


@pytest.mark.parametrize(
    "scores, expected",
    [
        ({}, ("APPROVED", "APPROVED")),
        ({"adult_score": 0.9}, ("REJECTED", "EXPLICIT_PORNOGRAPHIC_CONTENT")),
        ({"nsfw_score": 0.8, "visual_explicit_indicator": 1.0}, ("REJECTED", "EXPLICIT_PORNOGRAPHIC_CONTENT")),
        ({"adult_score": 0.5, "weapon_score": 0.3}, ("REJECTED", "HIGH_RISK_EXPLICIT_CONTENT")),
        ({"weapon_score": 0.73, "heritage_score": 0.90}, ("UNDER_REVIEW", "DISAGREE_CONTENT")),
        ({"weapon_score": 0.40, "heritage_score": 0.90}, ("APPROVED", "APPROVED")),
        ({"weapon_score": 0.45, "violence_self_harm_score": 0.40}, ("REJECTED", "WEAPON_VIOLENCE")),
        ({"hate_speech_score": 0.70}, ("REJECTED", "HATE_SPEECH_REJECTION")),
        ({"harassment_score": 0.65}, ("UNDER_REVIEW", "ENSEMBLE_REVIEW")),
        ({"child_safety_score": 0.65}, ("UNDER_REVIEW", "CHILD_SAFETY_ALERT")),
        ({"child_safety_score": 0.5, "ensemble_risk_score": 0.66}, ("UNDER_REVIEW", "ENSEMBLE_REVIEW")),
        ({"self_harm_text_score": 0.7, "heritage_score": 0.5}, ("UNDER_REVIEW", "HERITAGE_REVIEW")),
        ({"adult_score": 0.7}, ("REJECTED", "NSFW_CONTENT")),
        ({"adult_score": 0.7, "heritage_score": 0.6}, ("UNDER_REVIEW", "HERITAGE_REVIEW")),
        ({"pii_score": 0.61}, ("UNDER_REVIEW", "PRIVACY_VIOLATION")),
        ({"uncertainty_score": 0.3}, ("UNDER_REVIEW", "HIGH_UNCERTAINTY")),
        ({"marketing_keyword_count": 1}, ("REJECTED", "MARKETING_CONTENT")),
    ],
)
def test_cascade(spark, scores, expected):
    assert cascade(spark, **scores) == expected


def test_scores_that_are_no_numbers_read_as_zero(spark):
    df = spark.createDataFrame([("nonsense", None)], "adult_score string, weapon_score double")
    assert decision.decide_cascade(df).first()["decision"] == "APPROVED"


@pytest.mark.parametrize("score, expected", [(0.741, 74.1), (18.2, 18.2), (1.0, 100.0), (1.2, 1.2), (-3.0, 0.0), (500.0, 100.0)])
def test_percent(spark, score, expected):
    assert spark.range(1).select(decision.percent(F.lit(score))).first()[0] == expected


def test_report(spark):
    df = spark.createDataFrame([(0.832, 0.5, 0.0)], "violence_score double, adult_score double, ensemble_risk_score double")
    row = decision.report(df, df.columns).first()
    assert (row["overall_score"], row["risk_level"], row["decision"]) == (83.2, "HIGH RISK", "Review Required")
    assert row["graphic_violence"] == 66.6 and row["nudity"] == 50.0
    failed = decision.report(df.withColumns({c: F.lit(0.0) for c in df.columns}), df.columns, F.lit(True)).first()
    assert (failed["overall_score"], failed["risk_level"]) == (40.0, "MEDIUM RISK")


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_normalise(spark):
    assert one(spark, text.normalise, "  A\t b\n C ") == "a b c"
    assert one(spark, text.normalise, None) == ""


@pytest.mark.parametrize(
    "value, kind, expected",
    [
        ("id 2345 6789 0123", "aadhaar", True),
        ("id 1234 5678 9012", "aadhaar", False),
        ("id 3333-3333-3333", "aadhaar", False),
        ("pan abcde1234f.", "pan", True),
        ("éABCDE1234F", "pan", False),
        ("passport A1234567", "passport", True),
        ("mail jane.doe@example.com", "email", True),
        ("call +91 98765 43210", "phone", True),
        ("19876543210987", "phone", False),
        ("account 123456789012345", "bank", True),
        ("flat 12", "address", True),
        ("flat land", "address", False),
    ],
)
def test_personal_data(spark, value, kind, expected):
    assert one(spark, lambda c: detectors.pii_flags(c)[kind], value) is expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2345 6789 0123 9876543210", True),
        ("call 9876543210 2345-6789-0123 now", True),
        ("rows 12 2345 6789 0123 7", True),
        ("12345 6789 0123", False),
        ("2345 6789 01234", False),
        ("1345 6789 0123 2", False),
    ],
)
def test_aadhaar_in_a_row_of_numbers(spark, value, expected):
    assert one(spark, lambda c: detectors.pii_flags(c)["aadhaar"], value) is expected


@pytest.mark.parametrize("gap, expected", [(4, True), (5, False)])
def test_proximity(spark, gap, expected):
    value = "boycott " + "x " * (gap - 1) + "muslim"
    assert one(spark, lambda c: detectors.near(text.tokens(c), ("boycott",), ("muslim",), 4), value) is expected


def test_script_language(spark):
    assert one(spark, detectors.script_language, "नमस्ते दुनिया") == "hi"
    assert one(spark, detectors.script_language, "plain") is None


def detect(spark, found, column, prompt="a gun"):
    df = spark.createDataFrame([(found, {prompt: 0.6})], "d array<struct<class string, confidence double>>, p map<string, double>")
    return df.select(column(F.col("d"), F.col("p"))).first()[0]


def test_detections(spark):
    crowd = detect(spark, [("person", 0.9)] * 5, lambda d, p: det.with_crowd(det.remapped(d)))
    assert crowd[-1]["class"] == "crowd" and crowd[-1]["confidence"] == 0.9
    assert detect(spark, [("Gun", 0.8)], lambda d, p: det.safety_scores(d, p)["weapon_score"]) == pytest.approx(0.68)
    assert detect(spark, [("person", 0.96)], lambda d, p: det.child_scores(d, p)["child_presence_score"], "a lake") == pytest.approx(0.24)
    assert detect(spark, [("bottle", 0.8)], lambda d, p: det.promotion_support(d)) == pytest.approx(0.2)
    names = lambda d, p: det.first_of_each(F.transform(d, lambda x: x["class"]))
    assert detect(spark, [(" hello", 0.1), ("Hello", 0.2), ("", 0.3), ("b", 0.1)], names) == ["hello", "b"]


def test_uncertainty_of_nothing(spark):
    zero = [F.lit(0.0)] * 6
    row = spark.range(1).select(fusion.entropy(zero).alias("e"), fusion.variance(zero).alias("v")).first()
    assert (row["e"], row["v"]) == (0.0, 0.0)


@pytest.mark.parametrize(
    "raw, n",
    [
        ("call 9876543210", 1), ("at 1700000000000 ms", 0), ("+91 98765 43210", 1), ("9876543210x", 0), ("9876543210\u00e9", 0), ("09876543210", 1),
        ("98765432101", 1), ("5876543210", 0), ("9876543210, 9876543211.", 2), ("", 0),
    ],
)
def test_promoted_phones(spark, raw, n):
    # 11 digits end on a word's end, so their last ten are a number
    found = detectors.contact_signals(F.lit(raw), F.lit(raw))["phone_number_score"]
    assert spark.range(1).select(found).first()[0] == pytest.approx(min(0.4 * n, 0.8))


@pytest.mark.parametrize(
    "text_, found",
    [
        ("card 2345 6789 0123", True), ("id 2345 6789 0123 55", True), ("card 12 2345 6789 0123", True), ("2345-6789-0123", True), ("234567890123", True),
        ("2345 6789 0123 9876543210", True), ("1345 6789 0123", False), ("2222 2222 2222", False), ("2345 6789 01234", False), ("12345 6789 0123", False),
        ("2345  6789 0123", False), ("", False),
    ],
)
def test_aadhaar_beside_other_numbers(spark, text_, found):
    assert spark.range(1).select(detectors.pii_flags(F.lit(text_))["aadhaar"]).first()[0] is found


def test_entities_raise_flags(spark):
    df = spark.createDataFrame([(1, ["IBAN_CODE"]), (2, ["PERSON"]), (3, None), (4, [None, "IN_PAN"])], "i int, e array<string>")
    flags = detectors.with_entities(detectors.pii_flags(F.lit("nothing here")), F.col("e"))
    found = {r["i"]: {k for k in flags if r[k]} for r in df.select("i", *[v.alias(k) for k, v in flags.items()]).collect()}
    assert found == {1: {"bank"}, 2: set(), 3: set(), 4: {"pan"}}


@pytest.mark.parametrize(
    "text_, told, language",
    [("Bonjour", "fr", "en"), ("Bonjour tout le monde", "fr", "fr"), ("नमस्ते दुनिया यह", None, "hi"), ("नमस्ते", None, "en"), (None, "fr", "en"), ("plain words here", None, "en"), ("   short    ", "de", "en")],
)
def test_language_of_short_texts(spark, text_, told, language):
    df = spark.createDataFrame([(text_, told)], "t string, told string")
    assert df.select(detectors.detected_language(F.col("t"), F.col("told"))).first()[0] == language


def said(spark, **scores):
    return decision.decide_cascade(spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in scores.items()])).first()["reason"]


def test_reasons(spark):
    assert said(spark, video_unsafe_frame_ratio=0.185) == "Rejected: 18% of video frames contain unsafe content (threshold 15%)."
    assert said(spark, video_unsafe_frame_ratio=0.40) == "Rejected: 40% of video frames contain unsafe content (threshold 15%)."
    assert said(spark, video_consecutive_unsafe_frames=7) == "Rejected: 7 consecutive unsafe frames detected (threshold 3)."
    assert said(spark, self_harm_text_score=0.7, heritage_score=0.5) == "Heritage content with elevated self-harm signal requires manual review."
    assert said(spark, self_harm_text_score=0.7) == "Rejected because self-harm risk exceeded the allowed threshold."
    assert said(spark, adult_score=0.0) == "Approved: all safety, promotion, hate speech, and quality checks passed."
    assert set(decision.REASONS) == {r[0] if r[3] != "HERITAGE_REVIEW" or r[0] not in ("R31", "R32", "R33") else f"{r[0]} {r[3]}" for r in decision.CASCADE} | {"R47"}


def test_what_is_said_in_a_video_reaches_the_cascade(spark):
    videos = spark.createDataFrame(
        [(v, 0.1, 0.2, 0.0, 0.0, 0.0, 10, 0, 0.0, 0) for v in (1, 2)],
        "video long, adult_score double, violence_self_harm_score double, weapon_score double, blood_score double, child_safety_score double, n_frames long, n_unsafe long, unsafe_ratio double, longest_run int",
    )
    spoken = spark.createDataFrame([(1, 0.9, 0.95)], "video long, terrorism_score double, nsfw_score double")
    merged = {r["video"]: r for r in frames.merge_transcript(videos, spoken).collect()}
    assert merged[1]["terrorism_score"] == 0.9 and merged[2]["terrorism_score"] == 0.0
    assert merged[1]["nsfw_score"] == 0.1  # the explicit score of a video is its adult score
    decided = {r["video"]: r["code"] for r in decision.decide_cascade(frames.merge_transcript(videos, spoken)).collect()}
    assert decided == {1: "TERRORISM_CONTENT", 2: "APPROVED"}


def test_promotion_by_prompt_label(spark):
    df = spark.createDataFrame([({"Affiliate-Marketing": 0.8, "sponsored content here": 0.9},), ({},), (None,)], "p map<string, double>")
    zero = {k: F.lit(0.0) for k in ("advertising_score", "affiliate_score", "social_media_score")}
    none = F.array().cast("array<struct<class:string,confidence:double>>")
    found = [r.asDict() for r in df.select(*[v.alias(k) for k, v in det.promotion_scores(zero, F.col("p"), none).items()]).collect()]
    assert found[0] == {"advertising_score": 0.0, "affiliate_score": 0.8, "social_media_score": 0.0, "promotion_score": 0.8}
    assert all(v == 0.0 for r in found[1:] for v in r.values())


def image(spark, **columns):
    empty = "cast(array() as array<struct<class:string,confidence:double>>) as detections"
    base = spark.range(1).selectExpr(empty, "cast(map() as map<string,double>) as prompts", "0.0D as adult_score", "0.0D as heritage_score", "'' as ocr_text", "'' as caption", "cast(null as string) as code_text")
    return moderation.moderate_images(base.withColumns(columns)).first()


def test_image_path(spark):
    quiet = image(spark)
    assert (quiet["decision"], quiet["risk_level"]) == ("APPROVED", "SAFE")
    assert image(spark, adult_score=F.lit(0.95))["code"] == "EXPLICIT_PORNOGRAPHIC_CONTENT"
    assert image(spark, code_text=F.lit("https://t.me/x"))["code"] == "URL_IN_IMAGE"
    assert image(spark, code_text=F.lit("some plain code"))["code"] == "QR_CODE_PROMOTION"
    assert image(spark, ocr_text=F.lit("call 9876543210"))["code"] == "PHONE_NUMBER_SPAM"
    assert image(spark, ocr_text=F.lit("at 1700000000000 ms"))["code"] == "APPROVED"
    gun = F.expr("array(named_struct('class', 'gun', 'confidence', 0.99D))")
    armed = image(spark, detections=gun)
    assert armed["weapons"] == pytest.approx(84.2, abs=0.1) and armed["decision"] == "REJECTED"
    assert image(spark, prompts=F.expr("map('telegram promotion', 0.4D)"))["social_media_score"] == pytest.approx(0.4)


def test_text_is_normalised_once(spark):
    df = spark.range(1).withColumn("t", F.lit(" A\u00a0b "))
    plan = df.select(text.has_any(text.normalise(F.concat("t", F.col("id").cast("string"))), ("x", "y")).alias("found"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert df.select(text.phrases_in(text.normalise(F.col("t")), ("a b", "c", "b", "b"))).first()[0] == ["a b", "b"]
