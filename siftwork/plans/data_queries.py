"""Queries over caches, frames, logs and labels: joins, runs, windows, reports, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import lexicons as lex
from siftwork.operators import decision, evaluation, frames, monitor, similarity
from siftwork.plans import moderation
from siftwork.plans.score_queries import PROMPTS
from siftwork.plans.text_queries import count_sql
from siftwork.plans.views import CLASSES, FRAMES_SQL, NORM_SQL, listed, posts, table
from siftwork.plans.views import frames as frame_view
from siftwork.sources import sinks
from siftwork.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# Cached decisions: every third document's hash is known; a query's hash differs in doc_id % 8 bits.
_CACHE = (
    "cache as (select doc_id as cached_id, substr(md5(doc_id::varchar), 1, 16) as h, case when doc_id % 2 = 0 then 'APPROVED' else 'REJECTED' end as decision from documents where doc_id % 3 = 0), "
    "items as (select doc_id as item, substr(md5(doc_id::varchar), 1, 16) as h from documents)"
)


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 16)
    docs = table(spark, sf_dir, "documents").select("doc_id", h.alias("h"))
    kind = F.when(F.col("doc_id") % 2 == 0, "APPROVED").otherwise("REJECTED")
    cache = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("cached_id"), F.col("h").alias("c_h"), kind.alias("decision"))
    return docs.withColumnRenamed("doc_id", "item"), cache


@query(f"with {_CACHE} select item, decision from items left join cache using (h)")
def hash_exact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, cache = _cache(spark, sf_dir)
    return items.join(cache, F.col("h") == F.col("c_h"), "left").select("item", "decision")


@query(f"with {_CACHE} select item from items where h not in (select h from cache)")
def cache_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, cache = _cache(spark, sf_dir)
    return items.join(cache, F.col("h") == F.col("c_h"), "left_anti").select("item")


@query(
    f"with {_CACHE}, b as (select cached_id, ('0x' || h)::ubigint as cb from cache), q as (select item, xor(('0x' || h)::ubigint, ((1 << (item % 8)::int) - 1)::ubigint) as qb from items), "
    "p as (select item, cached_id, bit_count(xor(qb, cb)) as distance from q join b on bit_count(xor(qb, cb)) <= 5) "
    "select item, cached_id, distance from (select *, row_number() over (partition by item order by cached_id) as n from p) where n = 1"
)
def hash_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cached hash, in the cache's order, within five bits of each query."""
    items, cache = _cache(spark, sf_dir)
    flips = F.expr("shiftleft(1L, cast(item % 8 as int)) - 1L")
    asked = items.select("item", similarity.hash_bits(F.col("h")).bitwiseXOR(flips).alias("q_bits"))
    known = cache.select("cached_id", similarity.hash_bits(F.col("c_h")).alias("c_bits_all"))
    return similarity.first_within(asked, known, "item", "q_bits", "cached_id", "c_bits_all")


@query(
    "with v as (select vec_id, embedding::double[] as e from embeddings), n as (select a.vec_id as item, list_transform(list_zip(a.e, b.e), lambda z: z[1] + (case when a.vec_id % 2 = 0 then 0.1::double else 0.6::double end) * z[2]) as q "
    "from v a join v b on b.vec_id = a.vec_id + 1), u as (select item, list_transform(q, lambda x: x / sqrt(list_inner_product(q, q))) as q from n), "
    "c as (select vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as e from v), s as (select item, vec_id, list_inner_product(q, e) as sim from u, c), "
    "k as (select *, row_number() over (partition by item order by round(sim, 12) desc, vec_id) as n from s where sim >= 0.93) select item, vec_id as cached_id, round(sim, 6) as similarity from k where n = 1"
)
def embed_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of the whole cache most like each query, from an inner product of 0.93."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("before"), F.col("embedding").alias("e2"))
    step = F.when(F.col("vec_id") % 2 == 0, 0.1).otherwise(0.6)
    moved = F.zip_with("embedding", "e2", lambda x, y: x.cast("double") + F.col("step") * y.cast("double"))
    asked = v.join(after, F.col("vec_id") == F.col("before")).withColumn("step", step).select(
        F.col("vec_id").alias("item"), similarity.unit(moved).alias("q")
    )
    known = v.select(F.col("vec_id").alias("cached_id"), similarity.unit(F.col("embedding")).alias("e"))
    best = similarity.best_match(asked, known, "item", "q", "cached_id", "e")
    return best.select("item", "cached_id", F.round("similarity", 6).alias("similarity"))


@query(f"with {NORM_SQL}, lexicon as (select unnest({listed(lex.HERITAGE_KEYWORDS)}) as phrase) select phrase, count(*) as posts from normed join lexicon on contains(t, phrase) group by phrase")
def lexicon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many posts hold each phrase: the list stays a literal, so posts are not multiplied by it."""
    from siftwork.functions.text import normalise, words_array

    found = F.filter(words_array(lex.HERITAGE_KEYWORDS), lambda p: F.contains(F.col("t"), p))
    rows = posts(spark, sf_dir).select(normalise(F.col("text")).alias("t")).select(F.explode(found).alias("phrase"))
    return rows.groupBy("phrase").agg(F.count("*").alias("posts"))


_RISK = "greatest(adult_score, violence_self_harm_score, weapon_score, blood_score, child_safety_score)"
_RUNS = (
    f"{FRAMES_SQL}, flagged as (select *, {_RISK} >= 0.55 as unsafe from frames), islands as (select video, unsafe, row_number() over (partition by video order by frame) - row_number() over (partition by video, unsafe order by frame) as isl from flagged), "
    "runs as (select video, unsafe, isl, count(*) as n from islands group by all), longest as (select video, max(case when unsafe then n else 0 end) as longest_run from runs group by video), "
    "totals as (select video, max(adult_score) as adult_score, max(violence_self_harm_score) as violence_self_harm_score, max(weapon_score) as weapon_score, max(blood_score) as blood_score, max(child_safety_score) as child_safety_score, "
    "max(qr_code_score) as qr_code_score, max(promotion_score) as promotion_score, max(heritage_score) as heritage_score, max(hate_speech_score) as hate_speech_score, "
    "max(marketing_keyword_count) as marketing_keyword_count, max(pii_score) as pii_score, "
    "count(*) as n_frames, sum(unsafe::int)::bigint as n_unsafe from flagged group by video), videos as (select *, n_unsafe::double / n_frames::double as unsafe_ratio from totals join longest using (video))"
)


@query(f"with {_RUNS} select * from videos")
def video_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.summarise(frame_view(spark, sf_dir))


# what is said in every third video: scores that frames have too, and some that they lack
SAID = {"adult_score": 7, "ensemble_risk_score": 11, "hate_speech_score": 13, "terrorism_score": 17, "fraud_score": 19, "promotion_score": 23}
_SAID = ", ".join(f"((video * {m}) % 101)::double / 100.0::double as s_{k}" for k, m in SAID.items())
_FRAME_KEYS = (
    "adult_score", "violence_self_harm_score", "weapon_score", "blood_score", "child_safety_score",
    "qr_code_score", "promotion_score", "heritage_score", "hate_speech_score", "marketing_keyword_count", "pii_score",
)


def _larger_sql(k: str) -> str:
    parts = ["0.0::double", *([k] if k in _FRAME_KEYS else []), *([f"coalesce(s_{k}, 0.0::double)"] if k in SAID else [])]
    return f"greatest({', '.join(parts)})"


_VIDEO_SQL = {k: _larger_sql(k) for k in decision.CASCADE_KEYS} | {
    "nsfw_score": _larger_sql("adult_score"),
    "ensemble_risk_score": f"greatest({_larger_sql('ensemble_risk_score')}, least(1.0::double, unsafe_ratio * 1.5::double))",
    "video_unsafe_frame_ratio": "unsafe_ratio",
    "video_consecutive_unsafe_frames": "longest_run::double",
}
_WITH_SAID = f"{_RUNS}, spoken as (select video, {_SAID} from videos where video % 3 = 0), heard as (select v.*, s.* exclude (video) from videos v left join spoken s on v.video = s.video)"
_VIDEO_COLS = ", ".join(f"{v} as {k}" for k, v in _VIDEO_SQL.items())


def _said(videos: DataFrame) -> DataFrame:
    v = F.col("video")
    return videos.where(v % 3 == 0).select("video", *[(((v * m) % 101) / 100.0).alias(k) for k, m in SAID.items()])


@query(f"with {_WITH_SAID} select video, {_VIDEO_COLS} from heard")
def video_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = frames.summarise(frame_view(spark, sf_dir))
    return frames.merge_transcript(videos, _said(videos))


@query(f"with {FRAMES_SQL} select video, frame, round(adult_score, 4) as adult_score, round(violence_self_harm_score, 4) as violence_self_harm_score, round(weapon_score, 4) as weapon_score, round(blood_score, 4) as blood_score, round(child_safety_score, 4) as child_safety_score, round({_RISK}, 4) as risk, {_RISK} >= 0.55 as unsafe from frames")
def frame_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.snapshots(frame_view(spark, sf_dir))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of requests."""
    kinds = F.array(*[F.lit(x) for x in ("image", "video", "text", "pdf", "docx")])
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("content_type"), "props",
    )


_LOG = "log as (select event_id, ts, user_id, event_type, value, ['image', 'video', 'text', 'pdf', 'docx'][event_id % 5 + 1] as content_type, props from events)"


@query(f"with {_LOG} select content_type, event_type, count(*) as requests, count(*) filter (event_type = 'error') as failed, round(avg(value), 6) as mean_value from log group by content_type, event_type")
def mon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy("content_type", "event_type").agg(
        F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("failed"),
        F.round(F.avg("value"), 6).alias("mean_value"),
    )


_KINDS = ("image", "video", "pdf", "docx", "text", "audio")
_FLAGS = ("adult_score", "violence_self_harm_score", "weapon_score", "blood_score", "child_safety_score")


@query(
    f"with {_LOG}, named as (select unnest({listed(_KINDS)}) as kind), n as (select content_type, count(*) as c from log group by content_type), {FRAMES_SQL}, "
    "shares as (unpivot (select " + ", ".join(f"{k} * 100 as {k}" for k in _FLAGS) + " from frames) on * into name kind value p) "
    "select 'content_type' as counter, kind as name, coalesce(c, 0) as total from named left join n on kind = content_type "
    "union all select 'category_flag', kind, count(*) filter (p > 50) from shares group by kind"
)
def mon_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every content type, those without any as 0, and how often each category was above 50 percent."""
    shown = frame_view(spark, sf_dir).select(*[(F.col(k) * 100).alias(k) for k in _FLAGS])
    return monitor.by_kind(log(spark, sf_dir), "content_type", _KINDS).union(monitor.category_flags(shown, _FLAGS))


def _rates(seconds: int) -> str:
    return f"(select count(*) from log, (select max(ts) as now from log) where epoch(now)::bigint - epoch(ts)::bigint < {seconds})"


@query(f"with {_LOG} select {_rates(60)} as last_60, {_rates(60)}::double / 60.0::double as rate_60, {_rates(300)} as last_300, {_rates(300)}::double / 300.0::double as rate_300")
def mon_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    minute = monitor.trailing_rate(rows, 60).select(F.col("requests").alias("last_60"), F.col("per_second").alias("rate_60"))
    five = monitor.trailing_rate(rows, 300).select(F.col("requests").alias("last_300"), F.col("per_second").alias("rate_300"))
    return minute.join(F.broadcast(five))  # one row each


def _history(width: int) -> str:
    return (
        f"with {_LOG}, back as (select floor((epoch(now)::bigint - epoch(ts)::bigint) / {width})::bigint as b from log, (select max(ts) as now from log)), "
        "n as (select b, count(*) as c from back where b between 0 and 59 group by b) select 59 - i as bucket, coalesce(c, 0) as requests from range(60) t(i) left join n on b = i"
    )


@query(_history(3600))
def mon_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.history(log(spark, sf_dir), 3600)


@query(_history(10))
def mon_history_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.history(log(spark, sf_dir), 10)


@query(f"with {_LOG} select event_id, content_type, value from log order by value desc, event_id limit 5")
def mon_slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monitor.last_n(log(spark, sf_dir), 5, [F.desc("value"), F.col("event_id")])
    return rows.select("event_id", "content_type", "value")


@query(f"with {_LOG}, r as (select *, row_number() over (partition by content_type order by ts desc, event_id desc) as n from log) select content_type, round(avg(value), 6) as mean, min(value) as least, max(value) as most, count(*) as samples from r where n <= 100 group by content_type")
def mon_model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.recent_stats(log(spark, sf_dir), "content_type", "value", [F.desc("ts"), F.desc("event_id")])


@query(f"with {_LOG} select event_id, event_type, user_id from log where event_type = 'error' order by ts desc, event_id desc limit 50")
def mon_recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = log(spark, sf_dir).where("event_type = 'error'")
    return monitor.last_n(errors, 50, [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type", "user_id")


_LE = " union all ".join(
    f"select content_type, '{b}' as le, count(*) filter (value <= {b}) as count from log group by content_type" for b in monitor.BUCKETS
)


@query(f"with {_LOG} {_LE} union all select content_type, '+Inf', count(*) from log group by content_type")
def mon_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.histogram(log(spark, sf_dir), "value", "content_type")


@query(f"with {_LOG} select event_id, props from (select event_id, props, ts from log where contains(lower(props), '1') and event_type <> 'view' order by ts desc, event_id desc limit 100)")
def mon_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = log(spark, sf_dir).where(F.contains(F.lower("props"), F.lit("1")) & (F.col("event_type") != "view"))
    return monitor.last_n(hits, 100, [F.desc("ts"), F.desc("event_id")]).select("event_id", "props")


@query("select vec_id, label from embeddings order by vec_id desc limit 400")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of a cache that holds 400 entries: the newest."""
    return similarity.keep_newest(table(spark, sf_dir, "embeddings").select("vec_id", "label"), 400, [F.desc("vec_id")])


@query("select vec_id, label from embeddings where vec_id not in (select vec_id from embeddings order by vec_id limit (select greatest(1, (count(*) * 0.1)::bigint) from embeddings))")
def cache_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.trim_oldest(table(spark, sf_dir, "embeddings").select("vec_id", "label"), 0.1, 100, "vec_id", nearest=True)


_N = count_sql(lex.PROMOTIONAL_PHRASES + lex.SPAM_PHRASES)
_CONF = (
    "count(*) filter (e and p) as tp, count(*) filter (not e and p) as fp, count(*) filter (e and not p) as fn, count(*) filter (not e and not p) as tn, count(*) as total"
)


@query(
    f"with {NORM_SQL}, m as (select source, toxic = 1 as e, {_N} > 0 as p from normed join labels using (doc_id)), g as (select source, {_CONF} from m group by source union all select 'OVERALL', {_CONF} from m), "
    "r as (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0 end as pr, case when tp + fn > 0 then tp::double / (tp + fn) else 0 end as re from g) "
    "select source, tp, fp, fn, tn, total, round(pr, 6) as precision, round(re, 6) as recall, round(case when pr + re > 0 then 2.0::double * pr * re / (pr + re) else 0 end, 6) as f1, "
    "round(case when fp + tn > 0 then fp::double / (fp + tn) else 0 end, 6) as fp_rate, round(case when fn + tp > 0 then fn::double / (fn + tp) else 0 end, 6) as fn_rate from r"
)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a phrase rule fits the toxic label, by source and over all."""
    from siftwork.functions.text import has_any, normalise

    hit = has_any(normalise(F.col("text")), lex.PROMOTIONAL_PHRASES + lex.SPAM_PHRASES)
    marked = posts(spark, sf_dir).select("doc_id", "source", hit.alias("hit")).join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluation.confusion(marked, "source", F.col("toxic") == 1, F.col("hit"))


@query(f"with {_LOG} select content_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, max(value) as most, round(count(*) / sum(value), 6) as throughput from log group by content_type")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency_summary(log(spark, sf_dir), "value", "content_type")


@query(f"with {_LOG} select time_bucket(interval 10 seconds, ts) as start, count(*) as requests from log group by 1")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.tumbling(log(spark, sf_dir), "10 seconds")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "requests")


@query(
    f"with {_LOG}, w as (select time_bucket(interval 1 minute, ts) - k * interval 1 minute as start from log, range(5) r(k)) select start, count(*) as requests from w group by start"
)
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.sliding(log(spark, sf_dir), "5 minutes", "1 minute")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "requests")


@query(
    f"with {_LOG}, g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from log), "
    "s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g) "
    "select user_id, min(ts) as start, count(*) as requests from s group by user_id, session"
)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.sessions(log(spark, sf_dir), "user_id", "30 minutes")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "requests")


@query(
    f"with {_LOG}, m as (select user_id, ts, event_id, event_type <> 'purchase' as f, sum(case when event_type <> 'purchase' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from log), "
    "r as (select user_id, g, count(*) as failures, min(ts) as first_at, max(ts) as last_at from m where f group by user_id, g) select user_id, failures, first_at, last_at from r where failures >= 5"
)
def breaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monitor.breaker(log(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") != "purchase", 5)
    return rows.select("user_id", "failures", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_at", "last_at")])


@query(
    f"with a as (select unnest({listed(x.lower() for x in CLASSES)}) as w), b as (select unnest({listed(lex.WEAPON_LABELS + lex.CHILD_LABELS)}) as w), c as (select unnest({listed(PROMPTS)}) as w) "
    "select 'union' as op, w from (select w from a union select w from b union select w from c) union all select 'intersect', w from (select w from a intersect select w from b) union all select 'except', w from (select w from b except select w from a)"
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda words: spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "w string")
    a, b, c = one(x.lower() for x in CLASSES), one(lex.WEAPON_LABELS + lex.CHILD_LABELS), one(PROMPTS)
    named = lambda op, df: df.select(F.lit(op).alias("op"), "w")
    return (
        named("union", a.union(b).union(c).distinct())
        .union(named("intersect", a.intersect(b)))
        .union(named("except", b.exceptAll(a).distinct()))
    )


@query(
    "with r as (select event_id, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.k'), '') as page, len(json_keys(props)) as n_keys from events) select page, count(*) as events, sum(n_keys)::bigint as keys from r group by page"
)
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    page = F.coalesce(F.get_json_object("props", "$.page"), F.get_json_object("props", "$.k"), F.lit(""))
    return e.select(page.alias("page"), F.size(F.json_object_keys("props")).cast("long").alias("n")).groupBy("page").agg(
        F.count("*").alias("events"), F.sum("n").alias("keys")
    )




@query(f"with {_WITH_SAID}, scored as (select video, {_VIDEO_COLS} from heard) select video, {decision.cascade_sql('rule')} as rule, {decision.cascade_sql('decision')} as decision, {decision.cascade_sql('code')} as code from scored")
def video_moderation(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = frame_view(spark, sf_dir)
    said = _said(shots.select("video").distinct())
    return moderation.moderate_videos(shots, said).select("video", "rule", "decision", "code")


@query(f"with {_LOG}, n as (select count(*)::double as requests, count(*) filter (event_type = 'error')::double as failed, max(value)::double as slowest from log) unpivot n on requests, failed, slowest into name metric value value")
def mon_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the log as (metric, value) rows, as they are exported."""
    totals = log(spark, sf_dir).agg(
        F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("value").alias("slowest")
    )
    return sinks.as_metrics(totals)
