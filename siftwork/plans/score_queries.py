"""Queries over score grids, detections and prompts: ensembles, uncertainty, buckets, report, cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import lexicons as lex
from siftwork.operators import decision, fusion, prompts
from siftwork.operators import detections as det
from siftwork.plans import moderation
from siftwork.plans.text_queries import clamp_sql
from siftwork.plans.views import DETECTIONS_SQL, GRID_SQL, SPACE_SQL, detections, quoted, score_grid, table
from siftwork.sources import images
from siftwork.sources.uploads import batch_size, frame_rate, upload_status

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_RISK = lambda w: clamp_sql(
    f"adult_score * {w[0]}::double + child_safety_score * {w[1]}::double + violence_self_harm_score * {w[2]}::double + fraud_score * {w[3]}::double + "
    f"weapon_score * {w[4]}::double + (1.0::double - {clamp_sql('heritage_score')}) * {w[5]}::double"
)


@query(
    f"with {GRID_SQL} select item, round({_RISK(fusion.PRE_WEIGHTS)}, 9) as pre_risk, round({_RISK(fusion.IMAGE_WEIGHTS)}, 9) as image_risk, "
    f"round({_RISK(fusion.PRE_WEIGHTS)}, 9) > 0.60 and round({_RISK(fusion.PRE_WEIGHTS)}, 9) < 0.85 as second_look from grid"
)
def ensemble_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(k) for k in ("adult_score", "child_safety_score", "violence_self_harm_score", "fraud_score", "weapon_score", "heritage_score")]
    pre = F.round(fusion.weighted_risk(fusion.PRE_WEIGHTS, *parts), 9)
    return score_grid(spark, sf_dir).select(
        "item", pre.alias("pre_risk"), F.round(fusion.weighted_risk(fusion.IMAGE_WEIGHTS, *parts), 9).alias("image_risk"),
        fusion.needs_second_look(pre).alias("second_look"),
    )


_TEXTS = ("a temple idol at dawn", "nothing special here", "Shiva statue", "a street market")
_HERITAGE = " or ".join(f"contains(lower(txt), {quoted(w)})" for w in lex.HERITAGE_LABELS)


@query(
    f"with {GRID_SQL}, worded as (select *, [{', '.join(quoted(t) for t in _TEXTS)}][item % 4 + 1] as txt from grid), "
    f"flagged as (select *, case when heritage_score > 0.60 or {_HERITAGE} then 0.70::double else 1.0::double end as kept from worded) select item, "
    "weapon_score * kept as weapon_score, blood_score * kept as blood_score, violence_self_harm_score * kept as violence_self_harm_score, "
    "self_harm_score * kept as self_harm_score, child_safety_score from flagged"
)
def cultural_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("weapon_score", "blood_score", "violence_self_harm_score", "self_harm_score", "child_safety_score")
    texts = F.element_at(F.array(*[F.lit(t) for t in _TEXTS]), (F.col("item") % 4 + 1).cast("int"))
    safe = fusion.protected({k: F.col(k) for k in keys}, F.col("heritage_score"), texts)
    return score_grid(spark, sf_dir).select("item", *[v.alias(k) for k, v in safe.items()])


_VERDICT = "case item % 4 when 0 then 'APPROVED' when 1 then 'rejected' when 2 then 'UNDER_REVIEW' end"
_SURE = "((item * 13) % 121)::double / 100.0::double - 0.1::double"


def _verdicts(df: DataFrame) -> DataFrame:
    i = F.col("item")
    kind = F.when(i % 4 == 0, "APPROVED").when(i % 4 == 1, "rejected").when(i % 4 == 2, "UNDER_REVIEW")
    return df.withColumn("verdict", kind).withColumn("sure", ((i * 13) % 121) / 100.0 - 0.1)


@query(
    f"with {GRID_SQL}, v as (select item, upper({_VERDICT}) as k, {clamp_sql(_SURE)} as s from grid) select item, "
    "case k when 'REJECTED' then s when 'APPROVED' then 1.0::double - s else 0.5::double end as verdict_risk, case when k = 'APPROVED' then s else 0.0::double end as verdict_approves from v"
)
def verdict_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.verdict_risk(F.col("verdict"), F.col("sure"))
    return _verdicts(score_grid(spark, sf_dir)).select("item", *[v.alias(k) for k, v in found.items()])


_TOX_STEPS = {
    "toxicity": (3, 1), "severe_toxicity": (5, 2), "obscene": (7, 3), "identity_attack": (11, 4), "insult": (13, 5),
    "threat": (17, 6), "sexual_explicit": (19, 7),
}
_TOX = {k: f"((item * {a} + {b}) % 121)::double / 100.0::double" for k, (a, b) in _TOX_STEPS.items()}


@query(
    f"with {GRID_SQL}, p as (select item, {', '.join(f'{v} as {k}' for k, v in _TOX.items())} from grid) select item, "
    f"{clamp_sql('greatest(obscene * 0.75::double, sexual_explicit * 0.90::double)')} as adult, {clamp_sql('threat * 0.90::double')} as violence, "
    f"{clamp_sql('greatest(insult, severe_toxicity)')} as harassment, {clamp_sql('identity_attack * 1.10::double')} as hate_speech, {clamp_sql('toxicity')} as toxicity from p"
)
def toxicity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = {k: ((F.col("item") * a + b) % 121) / 100.0 for k, (a, b) in _TOX_STEPS.items()}
    return score_grid(spark, sf_dir).select("item", *[v.alias(k) for k, v in fusion.toxicity_scores(p).items()])


SIGNALS = ("adult_score", "child_safety_score", "violence_self_harm_score", "weapon_score", "fraud_score", "terrorism_score")
_SUM = " + ".join(SIGNALS)
_MEAN = f"(({_SUM}) / 6.0::double)"
_VAR = f"least(1.0::double, ({' + '.join(f'pow({s} - {_MEAN}, 2)' for s in SIGNALS)}) / 6.0::double * 4.0::double)"
_TOTAL = f"(({_SUM}) + 1e-10::double)"
_ENT = (
    f"(case when greatest({', '.join(SIGNALS)}) = 0 then 0.0::double else {clamp_sql('(' + ' + '.join(f'case when {s} / {_TOTAL} > 1e-10 then -({s} / {_TOTAL}) * log2({s} / {_TOTAL}) else 0.0::double end' for s in SIGNALS) + ') / log2(6.0::double)')} end)"
)
_MOST = f"greatest({', '.join(SIGNALS)})"
_DIS = clamp_sql(
    f"case when k = 'APPROVED' and {_MOST} > 0.50 then {_MOST} when k = 'REJECTED' and {_MOST} < 0.30 then 1.0::double - {_MOST} "
    f"when k = 'REJECTED' then abs({_MOST} - s) * 0.5::double else abs({_MOST} - (1.0::double - s)) * 0.5::double end"
)
_UNC = clamp_sql(f"{_VAR} * 0.30::double + {_ENT} * 0.30::double + (1.0::double - sim) * 0.20::double + {_DIS} * 0.20::double")


@query(
    f"with {GRID_SQL}, v as (select *, upper(coalesce({_VERDICT}, 'UNDER_REVIEW')) as k, {clamp_sql(_SURE)} as s, (item % 11)::double / 10.0::double as sim from grid) "
    f"select item, round({_VAR}, 6) as score_variance, round({_ENT}, 6) as score_entropy, round({_DIS}, 6) as disagreement, round({_UNC}, 6) as uncertainty from v"
)
def score_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = [F.col(k) for k in SIGNALS]
    df = _verdicts(score_grid(spark, sf_dir)).withColumn("sim", (F.col("item") % 11) / 10.0)
    return df.select(
        "item", F.round(fusion.variance(signals), 6).alias("score_variance"), F.round(fusion.entropy(signals), 6).alias("score_entropy"),
        F.round(fusion.disagreement(signals, F.col("verdict"), F.col("sure")), 6).alias("disagreement"),
        F.round(fusion.uncertainty(signals, F.col("sim"), F.col("verdict"), F.col("sure")), 6).alias("uncertainty"),
    )


@query(f"with {GRID_SQL} select item, round(1.0::double / (1.0::double + exp(-weapon_score / 1.6::double)), 9) as calibrated, round(1.0::double / (1.0::double + exp(-weapon_score / 1.4::double)), 9) as calibrated_object from grid")
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("weapon_score")
    return score_grid(spark, sf_dir).select(
        "item", F.round(fusion.calibrated(w), 9).alias("calibrated"),
        F.round(fusion.calibrated(w, fusion.OBJECT_TEMPERATURE), 9).alias("calibrated_object"),
    )


@query(f"with {GRID_SQL} select item, {decision.cascade_sql('rule')} as rule, {decision.cascade_sql('decision')} as decision, {decision.cascade_sql('code')} as code from grid")
def decide_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.decide_cascade(score_grid(spark, sf_dir)).select("item", "rule", "decision", "code")


@query(f"with {GRID_SQL}, d as (select {decision.cascade_sql('decision')} as decision, {decision.cascade_sql('code')} as code from grid) select decision, code, count(*) as items from d group by decision, code")
def cascade_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.decide_cascade(score_grid(spark, sf_dir)).groupBy("decision", "code").agg(F.count("*").alias("items"))


def _bround(x: str) -> str:
    """SQL of a rounding half to even."""
    return f"(case when abs({x} - floor({x}) - 0.5) < 1e-9 then 2 * round({x} / 2) else round({x}) end)::bigint"


def _reason_sql() -> str:
    """One CASE over the rules and codes, with the two that name a number written out."""
    share = f"'Rejected: ' || {_bround('video_unsafe_frame_ratio * 100')} || '% of video frames contain unsafe content (threshold 15%).'"
    run = f"'Rejected: ' || {_bround('video_consecutive_unsafe_frames')} || ' consecutive unsafe frames detected (threshold 3).'"
    whens = [f"when rule = 'R25' then {share}", f"when rule = 'R26' then {run}"]
    for name, said in sorted(decision.REASONS.items(), key=lambda x: -len(x[0])):
        if name not in ("R25", "R26"):
            rule, _, code = name.partition(" ")
            whens.append(f"when rule = '{rule}'" + (f" and code = '{code}'" if code else "") + f" then {quoted(said)}")
    return f"case {' '.join(whens)} end"


_VIDEO_KEYS = ("video_unsafe_frame_ratio", "video_consecutive_unsafe_frames")
_FILM = ", ".join(k if k not in _VIDEO_KEYS else f"{k} * {10 if k == _VIDEO_KEYS[1] else 1} as {k}" for k in decision.CASCADE_KEYS)


@query(
    f"with {GRID_SQL}, film as (select item, {_FILM} from grid), decided as (select *, {decision.cascade_sql('rule')} as rule, {decision.cascade_sql('code')} as code from film) "
    f"select item, rule, code, {_reason_sql()} as reason from decided"
)
def decide_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words for each decision; runs of unsafe frames are ten times the grid's scores."""
    film = score_grid(spark, sf_dir).withColumn(_VIDEO_KEYS[1], F.col(_VIDEO_KEYS[1]) * 10)
    return decision.decide_cascade(film).select("item", "rule", "code", "reason")


_P = lambda k: f"round(greatest(0.0::double, least(case when {k} <= 1.0 then {k} * 100.0::double else {k} end, 100.0::double)), 1)"
_KNOWN = set(decision.CASCADE_KEYS)
_CAT = {
    c: f"greatest(0.0::double, {', '.join(_P(k) for k in keys if k in _KNOWN) or '0.0::double'})" for c, keys in decision.ALIASES.items()
}
REPORT_CTE = (
    f"{GRID_SQL}, cats as (select item, ensemble_risk_score, {', '.join(f'{v} as {k}' for k, v in _CAT.items())} from grid), "
    "full_cats as (select * replace (round(greatest(graphic_violence, violence * 0.8::double), 1) as graphic_violence, round(greatest(nudity, adult_content * 0.6::double), 1) as nudity) from cats), "
    f"totals as (select *, round(greatest({_P('ensemble_risk_score')}, {', '.join(decision.ALIASES)}), 1) as overall_score from full_cats), "
    "levels as (select *, case when overall_score >= 90 or adult_content >= 90 or child_safety_risk >= 80 then 'CRITICAL' when overall_score >= 70 then 'HIGH RISK' "
    "when overall_score >= 40 or weapons >= 70 then 'MEDIUM RISK' when overall_score >= 20 then 'LOW RISK' else 'SAFE' end as risk_level from totals)"
)


@query(f"with {REPORT_CTE} select item, {', '.join(decision.ALIASES)} from levels")
def report_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.report(score_grid(spark, sf_dir), list(decision.CASCADE_KEYS)).select("item", *decision.ALIASES)


@query(
    f"with {REPORT_CTE} select item, overall_score, risk_level, case risk_level when 'CRITICAL' then 'Reject' when 'HIGH RISK' then 'Review Required' when 'MEDIUM RISK' then 'Review Required' else 'Accept' end as decision, "
    "case risk_level when 'CRITICAL' then 'Reject' when 'HIGH RISK' then 'Human Review' when 'MEDIUM RISK' then 'Human Review' when 'LOW RISK' then 'Allow with Monitoring' else 'Allow' end as recommendation from levels"
)
def report_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.report(score_grid(spark, sf_dir), list(decision.CASCADE_KEYS)).select(
        "item", "overall_score", "risk_level", "decision", "recommendation"
    )


_ALIAS_ROWS = ", ".join(f"({quoted(c)}, {quoted(k)})" for c, keys in decision.ALIASES.items() for k in keys)


@query(
    f"with {GRID_SQL}, alias(category, k) as (values {_ALIAS_ROWS}), long as (unpivot grid on {', '.join(decision.CASCADE_KEYS)} into name k value v) "
    f"select category, round(avg({_P('v')}), 6) as mean_percent, max({_P('v')}) as max_percent, count(*) as scores from long join alias using (k) where v > 0 group by category"
)
def alias_unpivot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as rows, joined to the categories they feed."""
    rows = [(c, k) for c, keys in decision.ALIASES.items() for k in keys]
    alias = spark.createDataFrame(rows, "category string, k string")
    pairs = ", ".join(f"'{k}', {k}" for k in decision.CASCADE_KEYS)
    long = score_grid(spark, sf_dir).select("item", F.expr(f"stack({len(decision.CASCADE_KEYS)}, {pairs}) as (name, v)")).where("v > 0")
    p = decision.percent(F.col("v"))
    return (
        long.join(F.broadcast(alias), F.col("name") == F.col("k"))
        .groupBy("category")
        .agg(F.round(F.avg(p), 6).alias("mean_percent"), F.max(p).alias("max_percent"), F.count("*").alias("scores"))
    )


@query(
    f"with {GRID_SQL}, base as (select item, 'weapons' as k, weapon_score as v from grid union all select item, 'blood', blood_score from grid), "
    "over as (select item, 'blood' as k, ((item * 7) % 101)::double / 100.0::double as v from grid where item % 2 = 0 union all select item, 'drugs', ((item * 3) % 101)::double / 100.0::double from grid where item % 5 = 0) "
    "select coalesce(o.item, b.item) as item, coalesce(o.k, b.k) as category, coalesce(o.v, b.v) as score from base b full outer join over o on b.item = o.item and b.k = o.k"
)
def score_override_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two sources by item and category; the second one's win."""
    g = score_grid(spark, sf_dir)
    i = F.col("item")
    base = g.select("item", F.expr("stack(2, 'weapons', weapon_score, 'blood', blood_score) as (category, score)"))
    over = (
        g.where(i % 2 == 0).select("item", F.lit("blood").alias("category"), (((i * 7) % 101) / 100.0).alias("o_score"))
        .union(g.where(i % 5 == 0).select("item", F.lit("drugs"), ((i * 3) % 101) / 100.0))
    )
    return base.join(over, ["item", "category"], "full_outer").select("item", "category", F.coalesce("o_score", "score").alias("score"))


_REMAP = "case lower({c}) " + " ".join(f"when '{k}' then '{v}'" for k, v in det.REMAPPED.items()) + " else lower({c}) end"


@query(
    f"with {DETECTIONS_SQL}, kept as (select image, {_REMAP.format(c='class')} as class, round(confidence, 4) as confidence from det where confidence >= 0.30), "
    "persons as (select image, count(*) as n, round(avg(confidence), 4) as c from kept where class = 'person' group by image), "
    "every as (select * from kept union all select image, 'crowd', c from persons where n >= 5) "
    "select class, count(*) as detections, max(confidence) as best from every group by class"
)
def det_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = det.with_crowd(det.remapped(F.col("detections")))
    rows = detections(spark, sf_dir).select(F.explode(found).alias("d")).select("d.class", "d.confidence")
    return rows.groupBy("class").agg(F.count("*").alias("detections"), F.max("confidence").alias("best"))


PROMPTS = ("a gun on a table", "blood and gore", "suicide note", "an assault", "a child at risk", "a quiet lake")


def _with_prompts(df: DataFrame) -> DataFrame:
    i = F.col("image")
    entries = F.array(*[F.struct(F.lit(p), ((i * (7 + j) + j) % 101) / 100.0) for j, p in enumerate(PROMPTS)])
    return df.withColumn("prompts", F.map_from_entries(entries))


def _label_sql(labels, but=()) -> str:
    own = [x for x in det.normal_labels(labels) if x not in det.normal_labels(but)]
    return f"coalesce(max(case when translate(lower(trim(class)), '-_', '  ') in ({', '.join(quoted(x) for x in own)}) then confidence end), 0.0::double)"


def _prompt_sql(terms) -> str:
    hits = [
        f"((image * {7 + j} + {j}) % 101)::double / 100.0::double"
        for j, p in enumerate(PROMPTS) if any(t in p for t in det.normal_labels(terms))
    ]
    return f"greatest(0.0::double, {', '.join(hits) or '0.0::double'})"


_FUSE = lambda y, c: clamp_sql(f"greatest({y} * 0.85::double, {c} * 0.60::double, case when {y} > 0.15 and {c} > 0.15 then sqrt({y} * {c}) else 0.0::double end * 0.95::double)")
_NAMES = ("weapon", "blood", "self_harm", "violence")
_BEFORE = {n: tuple(x for m in _NAMES[: _NAMES.index(n)] for x in det.BUCKETS[m]) for n in _NAMES}
SAFETY_CTE = (
    f"{DETECTIONS_SQL}, seen as (select image, {', '.join(f'{_label_sql(det.BUCKETS[n], _BEFORE[n])} as y_{n}' for n in _NAMES)}, "
    f"{_label_sql(lex.CHILD_LABELS + lex.CHILD_ALIASES)} as y_child, {_label_sql(lex.PERSON_LABELS)} as y_person, {_label_sql(lex.PROMOTION_OBJECTS)} as y_promo from det group by image), "
    f"both_ as (select *, {', '.join(f'{_prompt_sql(det.BUCKETS[n] + det.PROMPT_EXTRAS[n])} as c_{n}' for n in _NAMES)}, {_prompt_sql(lex.CHILD_TERMS)} as c_child from seen)"
)


@query(
    f"with {SAFETY_CTE}, f as (select image, {', '.join(f'''{_FUSE(f'y_{n}', f'c_{n}')} as {n}''' for n in _NAMES)} from both_) "
    "select image, round(weapon, 9) as weapon_score, round(blood, 9) as blood_score, round(self_harm, 9) as self_harm_score, round(greatest(weapon, blood, self_harm, violence), 9) as violence_self_harm_score from f"
)
def det_safety_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = det.safety_scores(F.col("detections"), F.col("prompts"))
    return _with_prompts(detections(spark, sf_dir)).select("image", *[F.round(v, 9).alias(k) for k, v in found.items()])


@query(
    f"with {SAFETY_CTE} select image, round({clamp_sql('greatest(y_child, c_child, y_person * 0.25::double)')}, 9) as child_presence_score, "
    f"round(greatest({_FUSE('y_child', 'c_child')}, case when y_person > 0.15 and c_child > 0.15 then least(y_person, c_child) * 0.15::double else 0.0::double end), 9) as child_safety_score from both_"
)
def child_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = det.child_scores(F.col("detections"), F.col("prompts"))
    return _with_prompts(detections(spark, sf_dir)).select("image", *[F.round(v, 9).alias(k) for k, v in found.items()])


@query(
    f"with {SAFETY_CTE}, s as (select image, y_promo * 0.25::double as a, ((image * 3) % 101)::double / 100.0::double as b, ((image * 5) % 101)::double / 200.0::double as c from both_) "
    "select image, round(least(1.0::double, greatest(a, b, c, (1.0::double - (1.0::double - a) * (1.0::double - b) * (1.0::double - c)) * 0.85::double)), 12) as advertising_score from s"
)
def promo_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("image")
    fused = det.noisy_or(det.promotion_support(F.col("detections")), ((i * 3) % 101) / 100.0, ((i * 5) % 101) / 200.0)
    return detections(spark, sf_dir).select("image", F.round(fused, 12).alias("advertising_score"))


PROMOTION_PROMPTS = ("sponsored", "Product-Advertisement", "affiliate marketing", "referral_marketing", "telegram promotion", "follow us", "a quiet lake")
_PROMO_SCORE = {p: f"((image * {11 + j} + {j}) % 101)::double / 100.0::double" for j, p in enumerate(PROMOTION_PROMPTS)}


def _promo_sql(labels, but) -> str:
    own = {x.lower().replace("-", " ").replace("_", " ") for x in labels} - {x.lower() for x in but}
    hits = [s for p, s in _PROMO_SCORE.items() if p.lower().replace("-", " ").replace("_", " ") in own]
    return f"greatest(0.0::double, {', '.join(hits) or '0.0::double'})"


def _or_sql(*parts: str) -> str:
    none = " * ".join(f"(1.0::double - {p})" for p in parts)
    return clamp_sql(f"greatest({', '.join(parts)}, (1.0::double - {none}) * 0.85::double)")


@query(
    f"with {SAFETY_CTE}, p as (select image, y_promo * 0.25::double as o, ((image * 3) % 101)::double / 200.0::double as t_ad, ((image * 5) % 101)::double / 200.0::double as t_af, ((image * 13) % 101)::double / 200.0::double as t_sm, "
    f"{_promo_sql(lex.ADVERTISING_PROMPTS, ())} as c_ad, {_promo_sql(lex.AFFILIATE_PROMPTS, lex.ADVERTISING_PROMPTS)} as c_af, "
    f"{_promo_sql(lex.SOCIAL_MEDIA_PROMPTS, lex.ADVERTISING_PROMPTS + lex.AFFILIATE_PROMPTS)} as c_sm from both_), "
    f"f as (select image, {_or_sql('t_ad', 'c_ad', 'o')} as ad, {_or_sql('t_af', 'c_af')} as af, {_or_sql('t_sm', 'c_sm')} as sm from p) "
    "select image, round(ad, 12) as advertising_score, round(af, 12) as affiliate_score, round(sm, 12) as social_media_score, round(greatest(ad, af, sm), 12) as promotion_score from f"
)
def promo_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotion from texts, prompts by their label, and objects."""
    i = F.col("image")
    entries = F.array(*[F.struct(F.lit(p), ((i * (11 + j) + j) % 101) / 100.0) for j, p in enumerate(PROMOTION_PROMPTS)])
    texts = {k: ((i * m) % 101) / 200.0 for k, m in (("advertising_score", 3), ("affiliate_score", 5), ("social_media_score", 13))}
    df = detections(spark, sf_dir).withColumn("prompts", F.map_from_entries(entries))
    found = det.promotion_scores(texts, F.col("prompts"), F.col("detections"))
    return df.select("image", *[F.round(v, 12).alias(k) for k, v in found.items()])


_RISKS = " ".join(f"when '{k}' then {w}::double" for k, w in det.RISK_WEIGHTS.items())


@query(
    f"with {DETECTIONS_SQL}, k as (select image, case lower(class) {_RISKS} else 0.0::double end as w, 1.0::double / (1.0::double + exp(-confidence / 1.4::double)) as conf from det) "
    "select image, round(least(1.0::double, max(w * conf)), 6) as object_risk from k group by image"
)
def object_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("image", F.round(det.object_risk(F.col("detections")), 6).alias("object_risk"))


_ANSWERS = ("a temple", "a temple ", "", "two people", "A temple")


@query(
    f"with a as (select page_id, list_transform(range(0, 4), lambda j: [{', '.join(quoted(a) for a in _ANSWERS)}][(page_id + j * (1 + page_id % 2)) % 5 + 1]) as s from pages), "
    "t as (select page_id, list_filter(list_transform(s[1:3], lambda x: trim(x)), lambda x: x <> '') as s from a) "
    "select page_id, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), '|') as captions from t"
)
def image_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captions that stay of a model's answers."""
    i, answers = F.col("page_id"), F.array(*[F.lit(a) for a in _ANSWERS])
    given = F.array(*[F.element_at(answers, ((i + j * (1 + i % 2)) % 5 + 1).cast("int")) for j in range(4)])
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(prompts.captions_of(given), "|").alias("captions"))


_SIDE, _SHARP = "(image * 7) % 90", "((image * 13) % 101)::double"
_DENSE, _VARIED = "((image * 3) % 11)::double / 500.0::double", "((image * 5) % 13)::double / 120.0::double"


@query(
    f"with {DETECTIONS_SQL}, m as (select image, case when image % 17 = 0 then null else {_SIDE} end as w, {_SIDE} + 5 as h, case when image % 19 = 0 then null else {_SHARP} end as sharp, "
    f"{_DENSE} as dense, {_VARIED} as varied, list_transform(detections, lambda d: lower(d.class)) as classes from dets) select image, "
    "case when w is null or sharp is null then 'CORRUPT' when least(w, h) < 32 then 'LOW_RES' when sharp < 40 then 'BLUR' else 'OK' end as quality, "
    "list_has_any(classes, ['book', 'cell phone', 'tv', 'laptop', 'stop sign', 'person']) or dense > 0.01 or varied > 0.05 as read_text from m"
)
def image_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an image can be judged, and whether its text is worth reading, from its measures and objects."""
    i = F.col("image")
    side, sharp = (i * 7) % 90, ((i * 13) % 101).cast("double")
    classes = F.transform("detections", lambda d: d["class"])
    return detections(spark, sf_dir).select(
        "image",
        images.quality_gate(F.when(i % 17 != 0, side), side + 5, F.when(i % 19 != 0, sharp)).alias("quality"),
        images.text_gate(classes, ((i * 3) % 11) / 500.0, ((i * 5) % 13) / 120.0).alias("read_text"),
    )


@query(
    f"with {DETECTIONS_SQL}, ranked as (select image, class, confidence, row_number() over (partition by image order by confidence desc, class) as n from det) "
    "select image, class as top_class, confidence from ranked where n = 1"
)
def top_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.array_min(F.transform("detections", lambda d: F.struct((-d["confidence"]).alias("c"), d["class"].alias("class"))))
    return detections(spark, sf_dir).select("image", best["class"].alias("top_class"), (-best["c"]).alias("confidence"))


@query(
    f"with {DETECTIONS_SQL}, o as (select image, class, row_number() over (partition by image order by class, confidence) as n from det), "
    "f as (select image, class, n, row_number() over (partition by image, lower(trim(class)) order by n) as k from o) "
    "select image, string_agg(trim(class), ',' order by n) as objects from f where k = 1 group by image"
)
def obj_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform("detections", lambda d: d["class"])
    return detections(spark, sf_dir).select("image", F.array_join(det.first_of_each(names), ",").alias("objects"))


@query(
    "with c as (select distinct conv_id, turn, turn // 3 as bag, list_distinct(list_filter(string_split(lower(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' '), lambda w: w <> '')) as w from conversations), "
    "p as (select a.conv_id, a.bag, case when len(a.w) = 0 and len(b.w) = 0 then 1.0::double when len(a.w) = 0 or len(b.w) = 0 then 0.0::double "
    "else len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w)))::double end as j from c a join c b on a.conv_id = b.conv_id and a.bag = b.bag and a.turn < b.turn), "
    "m as (select conv_id, bag, avg(j) as mean from p group by conv_id, bag) "
    "select conv_id, bag, round(coalesce(mean, 1.0::double), 6) as caption_similarity from (select distinct conv_id, bag from c) left join m using (conv_id, bag)"
)
def caption_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean likeness of each bag of three turns, pair by pair; one alone is like itself."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("text", "[ \t\n\r]+", " ")), " "), lambda w: w != ""))
    c = table(spark, sf_dir, "conversations").select("conv_id", F.expr("turn div 3").alias("bag"), "turn", words.alias("w")).distinct()
    a, b = c.alias("a"), c.alias("b")
    same = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.bag") == F.col("b.bag"))
    pairs = a.join(b, same & (F.col("a.turn") < F.col("b.turn")))
    mean = pairs.groupBy(F.col("a.conv_id").alias("of"), F.col("a.bag").alias("of_bag")).agg(
        F.avg(fusion.token_jaccard(F.col("a.w"), F.col("b.w"))).alias("mean")
    )
    every = c.select("conv_id", "bag").distinct()
    return every.join(mean, (F.col("conv_id") == F.col("of")) & (F.col("bag") == F.col("of_bag")), "left").select(
        "conv_id", "bag", F.round(F.coalesce("mean", F.lit(1.0)), 6).alias("caption_similarity")
    )


@query(
    "select page_id, case when n = 0 then 'empty' when n > 10485760 then 'too_large' when media not in ('image/jpeg', 'image/png', 'image/webp', 'image/gif') then 'bad_type' "
    "when suffix not in ('.jpg', '.jpeg', '.png', '.webp', '.gif') then 'bad_suffix' else 'ok' end as status from ("
    "select page_id, case when page_id % 7 = 0 then 0 when page_id % 11 = 0 then 20000000 else length(html) end as n, case when page_id % 5 = 0 then 'text/html' else 'image/png' end as media, "
    "case when page_id % 3 = 0 then '.txt' else '.png' end as suffix from pages)"
)
def upload_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    n = F.when(i % 7 == 0, 0).when(i % 11 == 0, 20_000_000).otherwise(F.length("html"))
    name = F.when(i % 3 == 0, "file.TXT").otherwise("file.PNG")
    media = F.when(i % 5 == 0, "text/html").otherwise("image/png")
    return table(spark, sf_dir, "pages").select("page_id", upload_status("image", name, media, n).alias("status"))


@query(
    "select o_orderkey as item, case when d is null or d <= 0 then 1.0::double else greatest(0.1::double, least(1.0::double, 120.0::double / d)) end as fps, "
    "case when q <= 5 then 4 when q <= 20 then 8 when q <= 50 then 16 else 32 end as batch from (select o_orderkey, case when o_orderkey % 9 = 0 then null else (o_orderkey % 2000)::double end as d, o_orderkey % 70 as q from orders)"
)
def rate_and_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    seconds = F.when(i % 9 != 0, (i % 2000).cast("double"))
    return table(spark, sf_dir, "orders").select(i.alias("item"), frame_rate(seconds).alias("fps"), batch_size(i % 70).alias("batch"))


_NAMED = ("arts", "history", "stories")
_LOGIT = lambda j, a: f"(((item * {a} + {j}) % 101)::double / 25.0::double - 2.0::double)"
_SIG = lambda j, a: f"(1.0::double / (1.0::double + exp(-{_LOGIT(j, a)})))"
_FUSED = {n: clamp_sql(f"{_SIG(j, 7)} * 0.50::double + {_SIG(j, 11)} * 0.25::double + {_SIG(j, 13) if n != 'stories' else '0.0::double'} * 0.25::double") for j, n in enumerate(_NAMED)}


@query(
    f"with {GRID_SQL}, f as (select item, {', '.join(f'{v} as {n}' for n, v in _FUSED.items())} from grid) select item, round(arts, 9) as arts, round(history, 9) as history, round(stories, 9) as stories, "
    "round(greatest(arts, history, stories), 9) as best, case when arts >= history and arts >= stories then 'arts' when history >= stories then 'history' else 'stories' end as top_name from f"
)
def category_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category scores of image, read text and caption from logits; the caption lacks a category."""
    i = F.col("item")

    def logits(a: int, names=_NAMED):
        return F.map_from_entries(F.array(*[F.struct(F.lit(n), ((i * a + j) % 101) / 25.0 - 2.0) for j, n in enumerate(names)]))

    fused = prompts.fuse_categories(
        prompts.sigmoid_map(logits(7)), prompts.sigmoid_map(logits(11)), prompts.sigmoid_map(logits(13, _NAMED[:2]))
    )
    df = score_grid(spark, sf_dir).select("item", fused.alias("c"))
    return df.select(
        "item", *[F.round(F.col("c")[n], 9).alias(n) for n in _NAMED], F.round(prompts.best_score(F.col("c")), 9).alias("best"),
        prompts.top_entry(F.col("c"))["name"].alias("top_name"),
    )


@query(
    f"with {GRID_SQL} select item, round(exp({_LOGIT(1, 3)}) / (exp({_LOGIT(0, 2)}) + exp({_LOGIT(1, 3)})), 9) as share, "
    "round(case when item % 2 = 0 then weapon_score else 1.0::double - weapon_score end, 4) as abuse from grid"
)
def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item")
    logits = F.array((i * 2 % 101) / 25.0 - 2.0, ((i * 3 + 1) % 101) / 25.0 - 2.0)
    label = F.when(i % 2 == 0, "Abusive").otherwise("clean")
    return score_grid(spark, sf_dir).select(
        "item", F.round(prompts.softmax_share(logits, 1), 9).alias("share"),
        prompts.abuse_score(label, F.col("weapon_score")).alias("abuse"),
    )


_STATES = ("loaded", "failed", "disabled", "not_loaded")


@query(
    f"with {GRID_SQL}, s as (select item, [{', '.join(quoted(x) for x in _STATES)}][item % 4 + 1] as live, [{', '.join(quoted(x) for x in _STATES)}][(item // 4) % 4 + 1] as tracked, item % 3 > 0 as warm, item % 101 as pct from grid) "
    "select item, case when live = 'loaded' then 'loaded' when tracked = 'failed' or live = 'failed' then 'failed' when live = 'disabled' or tracked = 'disabled' then 'disabled' when not warm then 'lazy' else tracked end as state, "
    "case when pct < 80 then 'healthy' when pct < 95 then 'warning' else 'offline' end as disk from s"
)
def component_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, names = F.col("item"), F.array(*[F.lit(x) for x in _STATES])
    live = F.element_at(names, (i % 4 + 1).cast("int"))
    tracked = F.element_at(names, (F.floor(i / 4) % 4 + 1).cast("int"))
    return score_grid(spark, sf_dir).select(
        "item", prompts.model_state(live, tracked, i % 3 > 0).alias("state"), prompts.resource_status(i % 101).alias("disk")
    )


@query(
    "with b as (select page_id, case when page_id % 4 = 0 then 0.2 else 0.9 end as c, page_id % 9 = 0 as skip, trim(regexp_replace(html, '<[^>]+>', ' ', 'g')) as t from pages) "
    f"select page_id, trim(regexp_replace(case when skip or c < 0.25 or t = '' then '' else t end || ' Extra', '{SPACE_SQL}', ' ', 'g')) as merged from b"
)
def ocr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of recognised blocks: unsure and skipped ones go, and what repeats another in another case."""
    i = F.col("page_id")
    block = lambda html, c, skip: F.struct(html.alias("html"), c.alias("confidence"), skip.alias("skipped"))
    blocks = F.array(
        block(F.col("html"), F.when(i % 4 == 0, 0.2).otherwise(0.9), i % 9 == 0),
        block(F.lit("<b>Extra</b>"), F.lit(0.5), F.lit(False)),
        block(F.lit("EXTRA"), F.lit(0.5), F.lit(None).cast("boolean")),
        block(F.lit("<i> </i>"), F.lit(0.9), F.lit(False)),
    )
    return table(spark, sf_dir, "pages").select("page_id", prompts.merge_fragments(prompts.read_blocks(blocks)).alias("merged"))


@query()
def image_moderation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole image path; its parts have SQL of their own."""
    i = F.col("image")
    df = _with_prompts(detections(spark, sf_dir)).select(
        "image", "detections", "prompts", (((i * 29) % 101) / 100.0).alias("adult_score"), (((i * 31) % 101) / 100.0).alias("heritage_score"),
        F.when(i % 3 == 0, "buy now at www.example.com").alias("ocr_text"), F.when(i % 5 == 0, "a temple at dawn").alias("caption"),
        F.when(i % 7 == 0, "https://t.me/some").alias("code_text"),
    )
    return moderation.moderate_images(df).select("image", "overall_score", "risk_level", "report_decision", "rule", "decision", "code")
