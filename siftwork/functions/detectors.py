"""Regex detectors: personal data, contact signals, links, scripts, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions import lexicons as lex
from siftwork.functions.text import Searched, capped_score, clamp, has_any, normalise, phrase_count, text_of, tokens, words_array

# The patterns below decide what counts as a match.
EMAIL = r"(?i)(^|[^\p{L}\p{N}_])[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}($|[^\p{L}\p{N}_])"
PHONE = r"(^|[^0-9])(\+?91[\s-]?)?[6-9][0-9]{4}[\s-]?[0-9]{5}($|[^0-9])"
AADHAAR = r"[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}"
AADHAAR_ALONE = r"(?<![0-9])" + AADHAAR + r"(?![0-9])"
PAN = r"(?i)(^|[^\p{L}\p{N}_])[a-z]{5}[0-9]{4}[a-z]($|[^\p{L}\p{N}_])"
PASSPORT = r"(?i)(^|[^\p{L}\p{N}_])[a-z][0-9]{7}($|[^\p{L}\p{N}_])"
UPI = r"(?i)(^|[^\p{L}\p{N}_])[a-z0-9._-]{2,}@[a-z]{2,}($|[^\p{L}\p{N}_])"
IFSC = r"(?i)(^|[^\p{L}\p{N}_])[a-z]{4}0[a-z0-9]{6}($|[^\p{L}\p{N}_])"
ADDRESS = (
    r"(?i)(^|[^\p{L}\p{N}_])(house|flat|apt|apartment|door|plot|street|road|lane|nagar|colony|sector|village|"
    r"district|pin|pincode|postal code)($|[^\p{L}\p{N}_])"
)
PROMO_URL = r"(?i)https?://|www\.|t\.me/|wa\.me/|bit\.ly|tinyurl|short\.url|link\.tree|linktr\.ee"
QUALITY_URL = r"https?://|www\."
HASHTAG = r"#[\p{L}\p{N}_]+"
PROMO_PHONE = r"((\+91|0091|0)[\s-]?)?[6-9][0-9]{9}(?![\p{L}\p{N}_])|\+91[\s-]?[0-9]{5}[\s-]?[0-9]{5}"
HANDLE = r"@[A-Za-z0-9_.]{3,30}"
LINK = r"""(?i)https?://[^\s)>'"]+"""
SOCIAL_LINK = (
    r"(?i)(t\.me|wa\.me|instagram\.com|youtube\.com|facebook\.com|twitter\.com|x\.com|whatsapp\.com|tiktok\.com|"
    r"snapchat\.com|linkedin\.com)"
)
PAYMENT = r"(?i)(upi://|phonepe|gpay|paytm|razorpay|upi|bhim)"
TELEGRAM = r"(?i)t\.me/"
#: Language of each script, in the order that breaks ties.
SCRIPTS = (
    ("hi", r"[\x{0900}-\x{097F}]"),
    ("ur", r"[\x{0600}-\x{06FF}]"),
    ("bn", r"[\x{0980}-\x{09FF}]"),
    ("ta", r"[\x{0B80}-\x{0BFF}]"),
    ("te", r"[\x{0C00}-\x{0C7F}]"),
    ("kn", r"[\x{0C80}-\x{0CFF}]"),
    ("gu", r"[\x{0A80}-\x{0AFF}]"),
    ("pa", r"[\x{0A00}-\x{0A7F}]"),
)
PII_WEIGHTS = (
    ("aadhaar", 0.55),
    ("pan", 0.45),
    ("passport", 0.45),
    ("phone", 0.30),
    ("email", 0.25),
    ("bank", 0.50),
    ("address", 0.35),
)


def _aadhaar_digits(candidate: Column) -> Column:
    digits = F.regexp_replace(candidate, "[^0-9]", "")
    first = F.substring(digits, 1, 1)
    return (F.length(digits) == 12) & ~first.isin("0", "1") & (F.replace(digits, first, F.lit("")) != "")


def pii_flags(text: Column) -> dict[str, Column]:
    """Which kinds of personal data a collapsed text holds."""
    # what a pattern cannot do without is looked for first, as most texts lack it
    four, five, at = text.rlike("[0-9]{4}"), text.rlike("[0-9]{5}"), F.contains(text, F.lit("@"))
    grouped = four & F.exists(F.regexp_extract_all(text, F.lit(AADHAAR_ALONE), F.lit(0)), _aadhaar_digits)
    account = five & F.exists(
        F.regexp_extract_all(text, F.lit("[0-9]{9,}"), F.lit(0)),
        lambda d: (F.length(d) <= 18) & ~_aadhaar_digits(d),
    )
    return {
        "aadhaar": grouped,
        "pan": four & text.rlike(PAN),
        "passport": five & text.rlike(PASSPORT),
        "phone": five & text.rlike(PHONE),
        "email": at & text.rlike(EMAIL),
        "bank": (at & text.rlike(UPI)) | (F.contains(text, F.lit("0")) & text.rlike(IFSC)) | account,
        "address": text.rlike("[0-9]") & text.rlike(ADDRESS),
    }


# Kinds of named entities and the personal data that they stand for.
ENTITY_FLAGS = {
    "EMAIL_ADDRESS": "email",
    "PHONE_NUMBER": "phone",
    "IN_AADHAAR": "aadhaar",
    "IN_PAN": "pan",
    "IN_PASSPORT": "passport",
    "IBAN_CODE": "bank",
    "CREDIT_CARD": "bank",
    "LOCATION": "address",
}


def with_entities(flags: dict[str, Column], entities: Column) -> dict[str, Column]:
    """The flags, raised also by the kinds of entities (array of names, or null) that a provider found."""
    kinds = {f: [k for k, flag in ENTITY_FLAGS.items() if flag == f] for f in flags}
    return {f: c | F.coalesce(F.exists(entities, lambda e: e.isin(*kinds[f])), F.lit(False)) if kinds[f] else c for f, c in flags.items()}


def pii_score(flags: dict[str, Column]) -> Column:
    total: Column = F.lit(0.0)
    for name, weight in PII_WEIGHTS:
        total = total + F.when(flags[name], weight).otherwise(0.0)
    return clamp(total)


def promo_scores(text: Column | Searched) -> dict[str, Column]:
    """Advertising, affiliate and social media scores of a normalised text."""
    urls, tags = F.regexp_count(text_of(text), F.lit(PROMO_URL)), F.regexp_count(text_of(text), F.lit(HASHTAG))
    advertising = capped_score(phrase_count(text, lex.ADVERTISING_PHRASES))
    social = capped_score(phrase_count(text, lex.SOCIAL_MEDIA_PHRASES))
    return {
        "advertising_score": F.when(
            urls > 0, F.greatest(advertising, F.least(F.lit(0.25) + urls * 0.10, F.lit(0.65)))
        ).otherwise(advertising),
        "affiliate_score": capped_score(phrase_count(text, lex.AFFILIATE_PHRASES)),
        "social_media_score": F.when(tags >= 6, F.greatest(social, F.lit(0.35))).otherwise(social),
    }


def contact_signals(raw: Column, text: Column | Searched) -> dict[str, Column]:
    """Phones and handles of the raw text; links, marketing words and courses of the normalised one."""
    phones, handles = F.regexp_count(raw, F.lit(PROMO_PHONE)), F.regexp_count(raw, F.lit(HANDLE))
    words = F.array_distinct(tokens(text_of(text)))
    return {
        "phone_number_score": F.least(phones * 0.40, F.lit(0.80)),
        "social_handle_score": F.least(handles * 0.30, F.lit(0.75)),
        "url_score": F.least(F.regexp_count(text_of(text), F.lit(PROMO_URL)) * 0.35, F.lit(0.80)),
        "marketing_words": F.size(F.array_intersect(words, words_array(lex.MARKETING_WORDS))).cast("double"),
        "course_score": capped_score(phrase_count(text, lex.COURSE_PROMOTION_PHRASES)),
    }


def quality_score(text: Column | Searched) -> Column:
    """Spam, scam, promotion and fake history in a normalised text."""
    urls = F.regexp_count(text_of(text), F.lit(QUALITY_URL))
    total = F.when(urls >= 3, 0.4).when(urls >= 1, 0.2).otherwise(0.0)
    for phrases, weight in (
        (lex.SPAM_PHRASES, 0.2),
        (lex.SCAM_PHRASES, 0.35),
        (lex.PROMOTIONAL_PHRASES, 0.2),
        (lex.FAKE_HISTORY_PHRASES, 0.35),
    ):
        n = phrase_count(text, phrases)
        total = total + F.when(n > 0, F.least(n * weight, F.lit(weight + 0.15))).otherwise(0.0)
    hashes = F.length(text_of(text)) - F.length(F.replace(text_of(text), F.lit("#"), F.lit("")))
    return clamp(total + F.when(hashes >= 8, 0.2).otherwise(0.0))


def script_language(text: Column) -> Column:
    """Language of the script with the most characters, over three of them; null if there is none."""
    counts = F.array(*[F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(-i).alias("i")) for i, (_, p) in enumerate(SCRIPTS)])
    best = F.array_max(counts)
    names = words_array([lang for lang, _ in SCRIPTS])
    return F.when(best["n"] > 3, F.element_at(names, 1 - best["i"]))


#: Characters without which a language is not told.
SHORTEST_TOLD = 10


def detected_language(text: Column, told: Column | None = None) -> Column:
    """English for a text too short to tell, else what a provider told, else the script's language, else English."""
    short = F.coalesce(F.length(F.trim(text)), F.lit(0)) < SHORTEST_TOLD
    by_script = F.coalesce(*([told] if told is not None else []), script_language(text), F.lit("en"))
    return F.when(short, "en").otherwise(by_script)


def blocked(text: Column | Searched) -> Column:
    """True if a normalised text must be refused outright: a phrase, a word, or a violent word near a community."""
    words = tokens(text_of(text))
    return (
        has_any(text, lex.BLOCKED_PHRASES)
        | F.arrays_overlap(words, words_array(lex.BLOCKED_WORDS))
        | near(words, lex.VIOLENCE_WORDS, lex.COMMUNITY_WORDS, 4)
    )


def near(words: Column, first: tuple[str, ...], second: tuple[str, ...], distance: int) -> Column:
    """True if a word of each list stands within ``distance`` tokens of the other."""
    at = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    ones = F.filter(at, lambda x: x["w"].isin(*first))
    others = F.filter(at, lambda x: x["w"].isin(*second))
    return F.exists(ones, lambda a: F.exists(others, lambda b: F.abs(a["i"] - b["i"]) <= distance))


def links(text: Column) -> Column:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), F.lit(0))))
    return F.when(F.contains(text, F.lit("://")), found).when(text.isNotNull(), F.array().cast("array<string>"))


def link_scores(text: Column | Searched, found: Column) -> dict[str, Column]:
    """Phishing and malware scores of a normalised text and its links."""
    suffix = "(" + "|".join(s.replace(".", r"\.") for s in lex.EXECUTABLE_SUFFIXES) + ")$"
    runs = F.exists(found, lambda u: F.lower(F.split_part(u, F.lit("?"), F.lit(1))).rlike(suffix))
    return {
        "phishing_score": F.when((F.size(found) > 0) & has_any(text, lex.PHISHING_TERMS), 0.75).otherwise(0.0),
        "malware_links_score": F.when(runs, 0.9).otherwise(0.0),
    }


def code_class(decoded: Column) -> dict[str, Column]:
    """What a decoded machine-readable code holds; null or blank: nothing."""
    text = normalise(decoded)
    social, payment, url = text.rlike(SOCIAL_LINK), text.rlike(PAYMENT), text.rlike(QUALITY_URL)
    score = F.when(text == "", 0.0).when(text.rlike(TELEGRAM) | social, 0.95).when(payment, 0.85).when(url, 0.80).otherwise(0.55)
    return {
        "qr_code_score": score,
        "qr_contains_url": (text != "") & url,
        "qr_contains_social": (text != "") & social,
        "qr_contains_payment": (text != "") & payment,
    }


def document_scores(text: Column | Searched, n_images: Column, n_codes: Column) -> dict[str, Column]:
    """Lexical scores of an extracted document's normalised text."""
    def hit(terms: tuple[str, ...], score: float) -> Column:
        return F.when(has_any(text, terms), score).otherwise(0.0)

    return {
        "copyright_notice_score": hit(lex.COPYRIGHT_TERMS, 0.65),
        "sensitive_document_score": hit(lex.SENSITIVE_TERMS, 0.75),
        "financial_information_score": hit(lex.FINANCIAL_TERMS, 0.75),
        "identity_document_score": hit(lex.IDENTITY_TERMS, 0.8),
        "watermark_score": hit(("watermark",), 0.5),
        "qr_code_score": F.when(has_any(text, ("qr",)) | (n_codes > 0), 0.65).otherwise(0.0),
        "barcode_score": F.when(n_codes > 0, 0.65).otherwise(0.0),
        "embedded_image_score": F.least(F.lit(1.0), n_images / 10.0),
    }
