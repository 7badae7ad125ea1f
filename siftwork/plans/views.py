"""Views of the tables that bring the rare case into every query, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import lexicons as lex
from siftwork.operators.decision import CASCADE_KEYS

#: Phrases that invented prose never holds: some of every list, and contact and personal data.
SEEDS = (
    *lex.MARKETING_PHRASES[:6], *lex.COURSE_PHRASES[:4], *lex.POLITICAL_CAMPAIGN_PHRASES[:4], *lex.POLITICAL_TOPIC_PHRASES[:4],
    *lex.ANIMAL_CRUELTY_PHRASES[:4], *lex.HUMAN_KILLING_PHRASES[:4], *lex.HERITAGE_KEYWORDS[:12], *lex.ADVERTISING_PHRASES[:12],
    *lex.AFFILIATE_PHRASES[:4], *lex.SOCIAL_MEDIA_PHRASES[:8], *lex.MARKETING_WORDS[:8], *lex.COURSE_PROMOTION_PHRASES[:6],
    *lex.BLOCKED_PHRASES[-20:], *lex.BLOCKED_WORDS, *lex.SPAM_PHRASES, *lex.SCAM_PHRASES, *lex.PROMOTIONAL_PHRASES,
    *lex.FAKE_HISTORY_PHRASES, *lex.PHISHING_TERMS, *lex.COPYRIGHT_TERMS, *lex.SENSITIVE_TERMS, *lex.FINANCIAL_TERMS,
    *lex.IDENTITY_TERMS, *[rule[1][i] for rules in lex.SAFETY_RULES.values() for rule in rules for i in (0, -1)],
    "boycott every single muslim shop", "expel a b c d hindu", "call +91 9876543210 now", "write to @some.handle_1",
    "mail jane.doe@example.com", "card 2345 6789 0123", "card 1234 5678 9012", "card 3333-3333-3333", "pan ABCDE1234F",
    "passport A1234567", "upi someone@okbank", "ifsc SBIN0001234", "account 123456789012345", "flat 12 some street",
    "see https://example.com/a?b=1 and www.example.org", "get http://example.net/setup.exe?v=2", "watermark qr code",
    "#one #two #three #four #five #six #seven #eight", "नमस्ते दुनिया यह", "বাংলা ভাষায় লেখা", "https://t.me/some_channel", "upi://pay?pa=x",
)


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(quoted(w) for w in dict.fromkeys(words)) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, two of three with one phrase or two after their text."""
    n, words = len(SEEDS), F.array(*[F.lit(w) for w in SEEDS])
    first = F.element_at(words, (F.col("doc_id") % n + 1).cast("int"))
    second = F.element_at(words, (F.col("doc_id") * 7 % n + 1).cast("int"))
    seeded = (
        F.when(F.col("doc_id") % 3 == 0, F.col("text"))
        .when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" "), first))
        .otherwise(F.concat("text", F.lit(" "), first, F.lit(" \t"), second))
    )
    return table(spark, sf_dir, "documents").withColumn("text", seeded)


POSTS_SQL = (
    "posts as (select doc_id, lang, source, case when doc_id % 3 = 0 then text "
    "when doc_id % 3 = 1 then text || ' ' || s[doc_id % {n} + 1] "
    "else text || ' ' || s[doc_id % {n} + 1] || ' ' || chr(9) || s[doc_id * 7 % {n} + 1] end as text "
    "from documents, (select [{words}] as s))"
).format(n=len(SEEDS), words=", ".join(quoted(w) for w in SEEDS))

SPACE_SQL = r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def norm_sql(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({c}, ''), '{SPACE_SQL}', ' ', 'g')))"


NORM_SQL = f"{POSTS_SQL}, normed as (select *, {norm_sql('text')} as t from posts)"


def score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order with one or two scores set and a level of heritage: every pair occurs."""
    i, n = F.col("o_orderkey"), len(CASCADE_KEYS)
    v1, v2 = ((i * 37) % 101) / 100.0, ((i * 53 + 11) % 101) / 100.0
    k1, k2 = i % n, F.floor(i / n) % n
    level = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.46, 0.51, 0.70, 0.90)]), (i % 5 + 1).cast("int"))
    cols = {k: F.when(k1 == j, v1).when(k2 == j, v2).otherwise(0.0) for j, k in enumerate(CASCADE_KEYS)}
    cols["heritage_score"] = F.greatest(level, cols["heritage_score"])
    return table(spark, sf_dir, "orders").select(i.alias("item"), *[c.alias(k) for k, c in cols.items()])


def _grid_sql() -> str:
    n = len(CASCADE_KEYS)
    cols = []
    for j, k in enumerate(CASCADE_KEYS):
        c = f"case when k1 = {j} then v1 when k2 = {j} then v2 else 0.0::double end"
        cols.append(f"{'greatest(level, ' + c + ')' if k == 'heritage_score' else c} as {k}")
    return (
        "grid as (select item, " + ", ".join(cols) + " from (select o_orderkey as item, "
        f"((o_orderkey * 37) % 101)::double / 100.0::double as v1, ((o_orderkey * 53 + 11) % 101)::double / 100.0::double as v2, "
        f"o_orderkey % {n} as k1, (o_orderkey // {n}) % {n} as k2, "
        "[0.0::double, 0.46::double, 0.51::double, 0.70::double, 0.90::double][o_orderkey % 5 + 1] as level from orders))"
    )


GRID_SQL = _grid_sql()

#: Classes that detections are made of; labels of every list, and what belongs to none.
CLASSES = (
    "Person", "person", "knife", "Gun", "blood", "dead body", "self-harm", "violence", "child", "toddler", "baby",
    "bottle", "chair", "scissors", "product", "rifle", "murder", "crowd", "human", "dog",
)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an image: its detections, from the lines of an order, sorted."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    d = F.struct(
        F.element_at(names, (F.col("l_partkey") % len(CLASSES) + 1).cast("int")).alias("class"),
        (((F.col("l_partkey") * 31 + F.col("l_linenumber")) % 101) / 100.0).alias("confidence"),
    )
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("image"))
        .agg(F.array_sort(F.collect_list(d)).alias("detections"))
    )


DETECTIONS_SQL = (
    "det as (select l_orderkey as image, [{words}][l_partkey % {n} + 1] as class, "
    "((l_partkey * 31 + l_linenumber) % 101)::double / 100.0::double as confidence from lineitem), "
    "dets as (select image, list_sort(list(struct_pack(class := class, confidence := confidence))) as detections from det group by image)"
).format(n=len(CLASSES), words=", ".join(quoted(c) for c in CLASSES))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of videos: video, frame, five risks, and what is seen now and then: a code, a promotion, a
    monument, hate, marketing words."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    score = lambda a, b: ((F.col("event_id") * a + b) % 101) / 100.0
    return e.select(
        F.col("user_id").alias("video"),
        (F.row_number().over(order) - 1).alias("frame"),
        (score(17, 0) * 0.6).alias("adult_score"),
        (score(29, 3) * 0.6).alias("violence_self_harm_score"),
        (score(41, 7) * 0.6).alias("weapon_score"),
        (score(53, 5) * 0.6).alias("blood_score"),
        (score(61, 2) * 0.6).alias("child_safety_score"),
        *[F.when(F.col("event_id") % every == 0, score(a, b)).otherwise(0.0).alias(k) for k, every, a, b in SEEN],
    )


#: Scores that few frames have: name, one frame in so many, and the factors of its value.
SEEN = (
    ("qr_code_score", 37, 19, 60), ("promotion_score", 23, 31, 9), ("heritage_score", 29, 43, 11), ("hate_speech_score", 211, 47, 1),
    ("marketing_keyword_count", 31, 3, 5), ("pii_score", 53, 13, 21),
)
FRAMES_SQL = (
    "frames as (select user_id as video, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, "
    + ", ".join(
        f"(((event_id * {a} + {b}) % 101)::double / 100.0::double) * 0.6::double as {k}"
        for k, a, b in (
            ("adult_score", 17, 0), ("violence_self_harm_score", 29, 3), ("weapon_score", 41, 7), ("blood_score", 53, 5),
            ("child_safety_score", 61, 2),
        )
    )
    + "".join(f", case when event_id % {every} = 0 then ((event_id * {a} + {b}) % 101)::double / 100.0::double else 0.0::double end as {k}" for k, every, a, b in SEEN)
    + " from events)"
)
