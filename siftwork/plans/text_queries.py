"""Text queries: normalisation, phrase scores, personal data, promotion, links, moderation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import detectors, text
from siftwork.functions import lexicons as lex
from siftwork.functions.phrases import searched, whole_lexicon
from siftwork.operators import fusion
from siftwork.plans import moderation
from siftwork.plans.views import NORM_SQL, POSTS_SQL, SPACE_SQL, listed, norm_sql, posts, quoted, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).withColumn("t", text.normalise(F.col("text")))


def searched_posts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, text.Searched]:
    return searched(normed(spark, sf_dir), "t", whole_lexicon())


# The same formulas in SQL.
def count_sql(words, t: str = "t") -> str:
    return f"len(list_filter({listed(words)}, lambda p: contains({t}, p)))"


def clamp_sql(x: str) -> str:
    return f"greatest(0.0::double, least(1.0::double, {x}))"


def linear_sql(words, base: float) -> str:
    n = count_sql(words)
    return f"(case when {n} = 0 then 0.0::double else {clamp_sql(f'{base}::double + ({n} - 1) * 0.15::double')} end)"


def capped_sql(words) -> str:
    n = count_sql(words)
    return f"(case when {n} = 0 then 0.0::double else {clamp_sql(f'0.35::double + least({n} - 1, 3) * 0.15::double')} end)"


def grouped_sql(rules) -> str:
    parts = [
        f"case when {count_sql(p)} > 0 then least({w}::double + ({count_sql(p)} - 1) * 0.10::double, {w + 0.30}::double) else 0.0::double end"
        for w, p in rules
    ]
    return clamp_sql(" + ".join(parts))


def hits_sql(pattern: str, t: str = "t") -> str:
    return f"len(regexp_extract_all({t}, {quoted(pattern)}))"


def as_columns(exprs: dict[str, str]) -> str:
    return ", ".join(f"{v} as {k}" for k, v in exprs.items())


SAFETY_SQL = {k: grouped_sql(r) for k, r in lex.SAFETY_RULES.items()}
_COURSE = linear_sql(lex.COURSE_PHRASES, 0.55)
_MARKETING = f"{count_sql(lex.MARKETING_PHRASES)}::double"
PROMOTION_SQL = {
    "marketing_keyword_count": _MARKETING,
    "course_promotion_score": _COURSE,
    "political_score": linear_sql(lex.POLITICAL_TOPIC_PHRASES, 0.30),
    "political_campaign_score": linear_sql(lex.POLITICAL_CAMPAIGN_PHRASES, 0.45),
    "promotion_score": clamp_sql(f"greatest(least({_MARKETING} / 4.0::double, 1.0::double) * 0.85::double, {_COURSE} * 0.90::double)"),
}
VIOLENCE_SQL = {
    "animal_cruelty_text_score": linear_sql(lex.ANIMAL_CRUELTY_PHRASES, 0.55),
    "human_killing_text_score": linear_sql(lex.HUMAN_KILLING_PHRASES, 0.50),
}
_HERITAGE_N = count_sql(lex.HERITAGE_KEYWORDS)
HERITAGE_SQL = f"(case when {_HERITAGE_N} = 0 then 0.0::double when {_HERITAGE_N} >= 4 then 0.70::double when {_HERITAGE_N} >= 2 then 0.55::double else 0.35::double end)"


@query(f"with {NORM_SQL} select doc_id, t as normalised, length(t) as n_chars_norm from normed")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normed(spark, sf_dir).select("doc_id", F.col("t").alias("normalised"), F.length("t").alias("n_chars_norm"))


@query(f"with {NORM_SQL} select doc_id, {count_sql(lex.MARKETING_PHRASES)} as marketing, {count_sql(lex.HERITAGE_KEYWORDS)} as heritage, {count_sql(lex.BLOCKED_PHRASES)} as blocked from normed")
def text_phrase_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, t = searched_posts(spark, sf_dir)
    return df.select(
        "doc_id",
        text.phrase_count(t, lex.MARKETING_PHRASES).alias("marketing"),
        text.phrase_count(t, lex.HERITAGE_KEYWORDS).alias("heritage"),
        text.phrase_count(t, lex.BLOCKED_PHRASES).alias("blocked"),
    )


def _scores(df: DataFrame, found: dict) -> DataFrame:
    return df.select("doc_id", *[v.alias(k) for k, v in found.items()])


@query(f"with {NORM_SQL} select doc_id, {as_columns(SAFETY_SQL)} from normed")
def text_safety_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, t = searched_posts(spark, sf_dir)
    return _scores(df, fusion.safety_text_scores(t))


@query(f"with {NORM_SQL} select doc_id, {as_columns(PROMOTION_SQL)} from normed")
def text_promotion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, t = searched_posts(spark, sf_dir)
    return _scores(df, fusion.promotion_text_scores(t))


@query(f"with {NORM_SQL} select doc_id, {as_columns(VIOLENCE_SQL)} from normed")
def text_violence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, t = searched_posts(spark, sf_dir)
    return _scores(df, fusion.violence_text_scores(t))


@query(f"with {NORM_SQL} select doc_id, {HERITAGE_SQL} as heritage_score from normed")
def text_heritage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, t = searched_posts(spark, sf_dir)
    return _scores(df, {"heritage_score": fusion.heritage_text_score(t)})


# written out here, not taken from the detectors: RE2 has word ends of its own
_PHONES = r"(?:(?:\+91|0091|0)[\s-]?)?[6-9]\d{9}\b|\+91[\s-]?\d{5}[\s-]?\d{5}"
_URLS = hits_sql(r"(?i)http(?:s)?://|www[.]|(?:t|wa)[.]me/|bit[.]ly|tinyurl|short[.]url|link[.]tree|linktr[.]ee")
_TAGS = hits_sql(r"#[_\p{L}\p{N}]+")


@query(
    f"with {NORM_SQL} select doc_id, "
    f"greatest({capped_sql(lex.ADVERTISING_PHRASES)}, case when {_URLS} > 0 then least(0.25::double + {_URLS} * 0.10::double, 0.65::double) else 0 end) as advertising_score, "
    f"{capped_sql(lex.AFFILIATE_PHRASES)} as affiliate_score, "
    f"greatest({capped_sql(lex.SOCIAL_MEDIA_PHRASES)}, case when {_TAGS} >= 6 then 0.35::double else 0 end) as social_media_score from normed"
)
def promo_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, t = searched_posts(spark, sf_dir)
    return _scores(df, detectors.promo_scores(t))


@query(
    f"with {NORM_SQL} select doc_id, least({hits_sql(_PHONES)} * 0.40::double, 0.80::double) as phone_number_score, "
    f"least({hits_sql(r'@[\w.]{3,30}', 'text')} * 0.30::double, 0.75::double) as social_handle_score, "
    f"least({_URLS} * 0.35::double, 0.80::double) as url_score, "
    f"len(list_filter(list_distinct(string_split(t, ' ')), lambda w: list_contains({listed(lex.MARKETING_WORDS)}, w)))::double as marketing_words, "
    f"{capped_sql(lex.COURSE_PROMOTION_PHRASES)} as course_score from normed"
)
def promo_contact_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(normed(spark, sf_dir), detectors.contact_signals(F.col("text"), F.col("t")))


_NEAR_SQL = (
    f"len(list_filter(range(1, len(w) + 1), lambda i: list_contains({listed(lex.VIOLENCE_WORDS)}, w[i]) and "
    f"len(list_filter(w[greatest(1, i - 4):i + 4], lambda x: list_contains({listed(lex.COMMUNITY_WORDS)}, x))) > 0)) > 0"
)


@query(
    f"with {NORM_SQL}, worded as (select *, list_filter(string_split(t, ' '), lambda x: x <> '') as w from normed) select doc_id, "
    f"{count_sql(lex.BLOCKED_PHRASES)} > 0 as by_phrase, "
    f"len(list_filter(w, lambda x: list_contains({listed(lex.BLOCKED_WORDS)}, x))) > 0 as by_word, {_NEAR_SQL} as by_proximity, "
    f"(select min(p) from unnest({listed(lex.BLOCKED_PHRASES)}) as u(p) where contains(t, p)) as reason from worded"
)
def hard_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a post is refused outright; of several phrases the first by name is given."""
    df, t = searched_posts(spark, sf_dir)
    words = F.col("words")
    return df.withColumn("words", text.tokens(F.col("t"))).select(
        "doc_id",
        F.arrays_overlap(words, text.words_array(lex.BLOCKED_WORDS)).alias("by_word"),
        detectors.near(words, lex.VIOLENCE_WORDS, lex.COMMUNITY_WORDS, 4).alias("by_proximity"),
        F.array_min(text.phrases_in(t, lex.BLOCKED_PHRASES)).alias("reason"),
    ).select("doc_id", F.col("reason").isNotNull().alias("by_phrase"), "by_word", "by_proximity", "reason")


def _aadhaar_sql(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"(length({d}) = 12 and left({d}, 1) not in ('0', '1') and replace({d}, left({d}, 1), '') <> '')"


_PLACES = (
    "house", "flat", "apt", "apartment", "door", "plot", "street", "road", "lane", "nagar", "colony", "sector", "village", "district", "pin", "pincode",
)
_FOUND = lambda p: f"regexp_matches(c, {quoted(p)})"
PII_SQL = {
    # RE2 looks neither back nor ahead: with every other sign doubled, a number takes one on each side and leaves one
    "aadhaar": "len(list_filter(regexp_extract_all(regexp_replace(c, '([^0-9])', '\\1\\1', 'g'), "
    f"'(?:^|[^0-9])([0-9]{{4}}(?:  |--)?[0-9]{{4}}(?:  |--)?[0-9]{{4}})(?:$|[^0-9])', 1), lambda r: {_aadhaar_sql('r')})) > 0",
    "pan": _FOUND(r"(?i)\b[A-Z]{5}\d{4}[A-Z]\b"),
    "passport": _FOUND(r"(?i)\b[A-Z]\d{7}\b"),
    "phone": _FOUND(r"(?:^|\D)(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?:$|\D)"),
    "email": _FOUND(r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    "bank": f"({_FOUND(r'(?i)\b[A-Z0-9._-]{2,}@[A-Z]{2,}\b')} or {_FOUND(r'(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b')} or len(list_filter(regexp_extract_all(c, '[0-9]+'), lambda d: length(d) between 9 and 18 and not {_aadhaar_sql('d')})) > 0)",
    "address": (
        f"((list_has_any(regexp_extract_all(lower(c), '[_\\p{{L}}\\p{{N}}]+'), {listed(_PLACES)}) "
        "or regexp_matches(lower(c), '(^|[^_\\p{L}\\p{N}])postal code($|[^_\\p{L}\\p{N}])')) and regexp_matches(c, '[0-9]'))"
    ),
}
_COLLAPSED = f"{POSTS_SQL}, collapsed as (select *, trim(regexp_replace(coalesce(text, ''), '{SPACE_SQL}', ' ', 'g')) as c from posts)"
_PII_SCORE = clamp_sql(" + ".join(f"case when {n} then {w}::double else 0.0::double end" for n, w in detectors.PII_WEIGHTS))


@query(f"with {_COLLAPSED}, flags as (select doc_id, {as_columns(PII_SQL)} from collapsed) select *, {_PII_SCORE} as pii_score from flags")
def pii_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.pii_flags(F.col("c"))
    df = posts(spark, sf_dir).select("doc_id", text.collapse(F.col("text")).alias("c")).select("doc_id", *[v.alias(k) for k, v in found.items()])
    return df.withColumn("pii_score", detectors.pii_score({k: F.col(k) for k in found}))


_ENTITIES = ("LOCATION", "PERSON", "CREDIT_CARD", "IN_PAN", "PHONE_NUMBER")
_RAISED = {
    k: f"({v} or coalesce(list_has_any(found, {listed(kinds)}), false))" if (kinds := [e for e, f in detectors.ENTITY_FLAGS.items() if f == k]) else v
    for k, v in PII_SQL.items()
}


@query(
    f"with {_COLLAPSED}, named as (select *, case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then [] else [{', '.join(quoted(e) for e in _ENTITIES)}][doc_id % 5 + 1:doc_id % 5 + 1] end as found from collapsed), "
    f"flags as (select doc_id, {as_columns(_RAISED)} from named) select *, {_PII_SCORE} as pii_score from flags"
)
def pii_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of personal data raised by what a provider of named entities found."""
    i = F.col("doc_id")
    one = F.array(F.element_at(text.words_array(_ENTITIES), (i % 5 + 1).cast("int")))
    entities = F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, F.array().cast("array<string>")).otherwise(one)
    df = posts(spark, sf_dir).select("doc_id", text.collapse(F.col("text")).alias("c"), entities.alias("found"))
    flags = detectors.with_entities(detectors.pii_flags(F.col("c")), F.col("found"))
    return df.select("doc_id", *[v.alias(k) for k, v in flags.items()]).withColumn("pii_score", detectors.pii_score({k: F.col(k) for k in flags}))


_QUALITY = [(lex.SPAM_PHRASES, 0.2), (lex.SCAM_PHRASES, 0.35), (lex.PROMOTIONAL_PHRASES, 0.2), (lex.FAKE_HISTORY_PHRASES, 0.35)]
_QURL = hits_sql("https://|http://|www[.]")
_QUALITY_SQL = clamp_sql(
    f"case when {_QURL} >= 3 then 0.4::double when {_QURL} >= 1 then 0.2::double else 0.0::double end + "
    + " + ".join(f"case when {count_sql(p)} > 0 then least({count_sql(p)} * {w}::double, {w + 0.15}::double) else 0.0::double end" for p, w in _QUALITY)
    + " + case when length(t) - length(replace(t, '#', '')) >= 8 then 0.2::double else 0.0::double end"
)


@query(f"with {NORM_SQL} select doc_id, round({_QUALITY_SQL}, 6) as quality_score from normed")
def text_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normed(spark, sf_dir).select("doc_id", F.round(detectors.quality_score(F.col("t")), 6).alias("quality_score"))


_RANGES = {
    "hi": (0x900, 0x97F), "ur": (0x600, 0x6FF), "bn": (0x980, 0x9FF), "ta": (0xB80, 0xBFF), "te": (0xC00, 0xC7F), "kn": (0xC80, 0xCFF), "gu": (0xA80, 0xAFF), "pa": (0xA00, 0xA7F),
}
_SCRIPT_COLS = ", ".join(f"len(list_filter(string_split(text, ''), lambda c: unicode(c) between {lo} and {hi})) as n_{lang}" for lang, (lo, hi) in _RANGES.items())
_SCRIPT_MAX = "greatest(" + ", ".join(f"n_{lang}" for lang in _RANGES) + ")"
_SCRIPT_CASE = " ".join(f"when n_{lang} = {_SCRIPT_MAX} then '{lang}'" for lang in _RANGES)


@query(
    f"with {POSTS_SQL}, counted as (select doc_id, {_SCRIPT_COLS} from posts), "
    f"named(code, name) as (values {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in lex.LANGUAGE_NAMES.items())}), "
    f"found as (select doc_id, coalesce(case when {_SCRIPT_MAX} <= 3 then null {_SCRIPT_CASE} end, 'en') as detected from counted) "
    f"select doc_id, detected, coalesce(name, 'Unknown') as language_name, detected in ({', '.join(quoted(x) for x in lex.INDIC_LANGUAGES)}) as is_indic "
    "from found left join named on code = detected"
)
def lang_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(list(lex.LANGUAGE_NAMES.items()), "code string, language_name string")
    found = posts(spark, sf_dir).select("doc_id", F.coalesce(detectors.script_language(F.col("text")), F.lit("en")).alias("detected"))
    return found.join(F.broadcast(names), F.col("code") == F.col("detected"), "left").select(
        "doc_id", "detected", F.coalesce("language_name", F.lit("Unknown")).alias("language_name"),
        F.col("detected").isin(*lex.INDIC_LANGUAGES).alias("is_indic"),
    )


@query(
    f"with {POSTS_SQL}, cut as (select doc_id, case when doc_id % 7 = 0 then left(text, 12) when doc_id % 7 = 1 then right(text, 9) when doc_id % 7 = 2 then '' else right(text, 40) end as text, "
    f"case when doc_id % 2 = 0 then lang end as told from posts), counted as (select doc_id, text, told, {_SCRIPT_COLS} from cut) "
    f"select doc_id, case when length(trim(text)) < 10 then 'en' else coalesce(told, case when {_SCRIPT_MAX} <= 3 then null {_SCRIPT_CASE} end, 'en') end as language from counted"
)
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of short and long pieces, where a provider tells it and where it does not."""
    i, t = F.col("doc_id"), F.col("text")
    piece = F.when(i % 7 == 0, F.left(t, F.lit(12))).when(i % 7 == 1, F.right(t, F.lit(9))).when(i % 7 == 2, "").otherwise(F.right(t, F.lit(40)))
    df = posts(spark, sf_dir).select("doc_id", piece.alias("text"), F.when(i % 2 == 0, F.col("lang")).alias("told"))
    return df.select("doc_id", detectors.detected_language(F.col("text"), F.col("told")).alias("language"))


@query(f"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{SPACE_SQL}', ' ', 'g')) as plain from pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", text.collapse(F.regexp_replace("html", "<[^>]+>", " ")).alias("plain")
    )


_LINK = r"""(?i)http(?:s)?://[^ \t\n\f\r)>'"]+"""
_LINKS = f"list_sort(list_distinct(regexp_extract_all(text, {quoted(_LINK)})))"
_SUFFIX = "(" + "|".join(s.replace(".", r"\.") for s in lex.EXECUTABLE_SUFFIXES) + ")$"


@query(
    f"with {NORM_SQL}, linked as (select *, {_LINKS} as links from normed) select doc_id, array_to_string(links[1:50], ' ') as links, len(links) as n_links, "
    f"case when len(links) > 0 and {count_sql(lex.PHISHING_TERMS)} > 0 then 0.75::double else 0.0::double end as phishing_score, "
    f"case when len(list_filter(links, lambda u: regexp_matches(lower(split_part(u, '?', 1)), {quoted(_SUFFIX)}))) > 0 then 0.9::double else 0.0::double end as malware_links_score from linked"
)
def link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normed(spark, sf_dir).withColumn("links", detectors.links(F.col("text")))
    found = detectors.link_scores(F.col("t"), F.col("links"))
    return df.select(
        "doc_id", F.array_join(F.slice("links", 1, 50), " ").alias("links"), F.size("links").alias("n_links"),
        *[v.alias(k) for k, v in found.items()],
    )


# the pages hold no addresses, so each gets its own, twice on every third
_ANCHORED = "html || ' <a href=\"' || url || '\">more</a>' || case when page_id % 3 = 0 then ' (' || url || '/x.exe?q=1) ' || url else '' end"
_PAGE_LINKS = f"list_sort(list_distinct(regexp_extract_all({_ANCHORED}, '(?i)https?://[^\\s)>''\"]+')))"


@query(f"select page_id, link from (select page_id, unnest({_PAGE_LINKS}) as link from pages)")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" ("), "url", F.lit("/x.exe?q=1) "), "url")).otherwise("")
    html = F.concat("html", F.lit(' <a href="'), "url", F.lit('">more</a>'), more)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(detectors.links(html)).alias("link"))


@query(
    "select page_id, url, case when not regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') then 'bad_scheme' "
    "when lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) not in ('http', 'https') then 'bad_scheme' "
    "when regexp_extract(url, '^[^:]+://([^/?#]*)', 1) = '' then 'no_host' "
    "when contains(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), '@') then 'has_user' else 'ok' end as status, "
    "regexp_extract(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), '([^@:]*)(:[0-9]+)?$', 1) as host from pages"
)
def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.sources.uploads import url_host, url_status

    return table(spark, sf_dir, "pages").select("page_id", "url", url_status(F.col("url")).alias("status"), url_host(F.col("url")).alias("host"))


_CODES = f"codes as (select doc_id, case when doc_id % 5 = 0 then null else right(text, 60) end as d from posts), coded as (select doc_id, {norm_sql('d')} as t from codes)"
_HOSTS = (
    "t.me", "wa.me", "instagram.com", "youtube.com", "facebook.com", "twitter.com", "x.com", "whatsapp.com", "tiktok.com", "snapchat.com", "linkedin.com",
)
_ANY = lambda words: f"(len(list_filter({listed(words)}, lambda p: contains(t, p))) > 0)"
_SOCIAL, _PAYS, _URL = _ANY(_HOSTS), _ANY(("upi", "phonepe", "gpay", "paytm", "razorpay", "bhim")), _ANY(("http://", "https://", "www."))


@query(
    f"with {POSTS_SQL}, {_CODES} select doc_id, case when t = '' then 0.0::double when {_SOCIAL} then 0.95::double "
    f"when {_PAYS} then 0.85::double when {_URL} then 0.80::double else 0.55::double end as qr_code_score, "
    f"t <> '' and {_URL} as qr_contains_url, t <> '' and {_SOCIAL} as qr_contains_social, t <> '' and {_PAYS} as qr_contains_payment from coded"
)
def qr_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.right("text", F.lit(60)))
    return _scores(posts(spark, sf_dir).withColumn("decoded", decoded), detectors.code_class(F.col("decoded")))


_DOC_HIT = lambda words, s: f"case when {count_sql(words)} > 0 then {s}::double else 0.0::double end"
DOCUMENT_SQL = {
    "phishing_score": f"case when len(links) > 0 and {count_sql(lex.PHISHING_TERMS)} > 0 then 0.75::double else 0.0::double end",
    "malware_links_score": f"case when len(list_filter(links, lambda u: regexp_matches(lower(split_part(u, '?', 1)), {quoted(_SUFFIX)}))) > 0 then 0.9::double else 0.0::double end",
    "copyright_notice_score": _DOC_HIT(lex.COPYRIGHT_TERMS, 0.65),
    "sensitive_document_score": _DOC_HIT(lex.SENSITIVE_TERMS, 0.75),
    "financial_information_score": _DOC_HIT(lex.FINANCIAL_TERMS, 0.75),
    "identity_document_score": _DOC_HIT(lex.IDENTITY_TERMS, 0.8),
    "watermark_score": _DOC_HIT(("watermark",), 0.5),
    "qr_code_score": _DOC_HIT(("qr",), 0.65),
    "barcode_score": "0.0::double",
    "embedded_image_score": "0.0::double",
}
_DOC_PII = {k: v for k, v in PII_SQL.items()}


@query(
    f"with {NORM_SQL}, linked as (select *, t as c, {_LINKS} as links from normed), flags as (select *, {as_columns(_DOC_PII)} from linked), "
    f"scored as (select doc_id, t, {as_columns(DOCUMENT_SQL)}, {_PII_SCORE} as pii_score from flags), "
    "cats as (select *, round(pii_score * 100.0::double, 1) as pii_detection, round(qr_code_score * 100.0::double, 1) as qr_code, round(watermark_score * 100.0::double, 1) as watermark from scored), "
    "totals as (select *, greatest(pii_detection, qr_code, watermark, round(phishing_score * 100, 1), round(malware_links_score * 100, 1), round(copyright_notice_score * 100, 1), "
    "round(sensitive_document_score * 100, 1), round(financial_information_score * 100, 1), round(identity_document_score * 100, 1)) as total from cats), "
    "floored as (select *, case when t = '' then greatest(total, 40.0::double) else total end as overall_score from totals) "
    "select doc_id, pii_detection, qr_code, watermark, overall_score, case when overall_score >= 90 then 'CRITICAL' when overall_score >= 70 then 'HIGH RISK' "
    "when overall_score >= 40 then 'MEDIUM RISK' when overall_score >= 20 then 'LOW RISK' else 'SAFE' end as risk_level from floored"
)
def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.moderate_documents(posts(spark, sf_dir)).select(
        "doc_id", "pii_detection", "qr_code", "watermark", "overall_score", "risk_level"
    )


@query(f"with {POSTS_SQL}, linked as (select *, {_LINKS} as links from posts) select doc_id, left(coalesce(text, ''), 2000) as preview, array_to_string(links[1:50], ' ') as first_links from linked")
def document_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = moderation.moderate_documents(posts(spark, sf_dir))
    return shown.select("doc_id", "preview", F.array_join("first_links", " ").alias("first_links"))


_FLAT = {**SAFETY_SQL, **{f"p_{k}": v for k, v in PROMOTION_SQL.items()}, **VIOLENCE_SQL}
_STRONGEST = (
    "greatest(harassment_score * 0.60::double, hate_speech_score, harassment_score, terrorism_score * 1.10::double, fraud_score, self_harm_text_score)"
)
_PCT = lambda x: f"round(greatest(0.0::double, least(case when {x} <= 1.0 then {x} * 100.0::double else {x} end, 100.0::double)), 1)"
TEXT_CTE = (
    f"{NORM_SQL}, flat as (select doc_id, lang, t, {as_columns(_FLAT)}, {HERITAGE_SQL} as heritage_score from normed), "
    f"scored as (select *, {clamp_sql('harassment_score * 0.60::double')} as violence_self_harm_score, "
    f"{clamp_sql(f'{_STRONGEST} * 0.90::double + 0.5::double * 0.10::double')} as ensemble_risk_score from flat), "
    f"cats as (select *, {_PCT('violence_self_harm_score')} as violence, {_PCT('hate_speech_score')} as hate_speech, {_PCT('harassment_score')} as abusive_text, "
    f"greatest({_PCT('p_political_campaign_score')}, {_PCT('p_political_score')}) as political_propaganda, {_PCT('p_promotion_score')} as spam, {_PCT('fraud_score')} as scam, "
    f"{_PCT('misinformation_score')} as misinformation, greatest({_PCT('self_harm_text_score')}, {_PCT('violence_self_harm_score')}) as self_harm from scored), "
    "graphic as (select *, round(violence * 0.8::double, 1) as graphic_violence from cats), "
    f"report as (select *, case when t = '' then 40.0::double else greatest({_PCT('ensemble_risk_score')}, violence, graphic_violence, hate_speech, abusive_text, political_propaganda, spam, scam, misinformation, self_harm) end as overall_score from graphic), "
    "levels as (select *, case when overall_score >= 90 then 'CRITICAL' when overall_score >= 70 then 'HIGH RISK' when overall_score >= 40 then 'MEDIUM RISK' when overall_score >= 20 then 'LOW RISK' else 'SAFE' end as risk_level from report)"
)


@query(
    f"with {TEXT_CTE} select doc_id, violence, hate_speech, abusive_text, political_propaganda, spam, scam, misinformation, self_harm, "
    "graphic_violence, overall_score, risk_level from levels"
)
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.moderate_text(posts(spark, sf_dir)).select(
        "doc_id", "violence", "hate_speech", "abusive_text", "political_propaganda", "spam", "scam", "misinformation",
        "self_harm", "graphic_violence", "overall_score", "risk_level",
    )


@query(
    f"with {TEXT_CTE} select lang, risk_level, count(*) as posts, round(avg(overall_score), 4) as mean_score, max(overall_score) as max_score from levels group by lang, risk_level"
)
def text_moderation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every post scored, reported and summed up by language and risk."""
    return (
        moderation.moderate_text(posts(spark, sf_dir))
        .groupBy("lang", "risk_level")
        .agg(F.count("*").alias("posts"), F.round(F.avg("overall_score"), 4).alias("mean_score"), F.max("overall_score").alias("max_score"))
    )


