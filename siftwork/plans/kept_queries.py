"""Queries over what is kept and over time: indexes, rings, logs, metrics, sketches, trailing rates, decisions in force, SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.sql import register_functions
from siftwork.operators import decision, sketches, timeline
from siftwork.operators.lineage import shared_folder
from siftwork.plans.data_queries import _LOG, log
from siftwork.plans.views import GRID_SQL, score_grid, table
from siftwork.sources import logs
from siftwork.sources.kept_index import KeptIndex
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


def fresh_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/siftwork-{kind}-{uuid.uuid4().hex}"


@query(
    "with u as (select vec_id, case when vec_id % 2 = 0 then label + 10 else label end as label from embeddings where vec_id % 3 <> 0 or vec_id % 2 = 0) "
    "select * from u where vec_id not in (select vec_id from u order by vec_id limit (select case when count(*) > 100 then greatest(1, floor(count(*) * 0.1)::int) else 0 end from u))"
)
def kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after two upserts, one of them offered twice, and a trim."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))
    index = KeptIndex(spark, fresh_folder(spark, "index"), "vec_id", buckets=4)
    index.upsert(v.where("vec_id % 3 <> 0"), ["vec_id"], "cache", 0)
    for add in (10, 20):
        index.upsert(v.where("vec_id % 2 = 0").withColumn("label", F.col("label") + add), ["vec_id"], "cache", 1)
    index.trim(0.1, 100, "vec_id")
    index.vacuum(keep=1)
    return index.read()


@query(f"with {_LOG} select place, event_type, event_id from (select row_number() over (partition by event_type order by ts desc, event_id desc) as place, event_type, event_id from log) where place <= 20")
def ring_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty events of each kind."""
    return streams.rings(log(spark, sf_dir).select("event_type", "ts", "event_id"), "event_type", ["ts", "event_id"], 20).drop("ts")


@query(
    f"with {_LOG}, r as (select * from log where event_type <> 'purchase'), d as (select user_id, ts as decided_ts, event_id as decision_id from log where event_type = 'purchase') "
    "select event_id, decision_id from r left join d on r.user_id = d.user_id and decided_ts >= ts and decided_ts <= ts + interval 6 hours"
)
def request_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the purchases of its user in the six hours after it."""
    all_rows = log(spark, sf_dir)
    asked = all_rows.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    answers = all_rows.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("decided_ts"), F.col("event_id").alias("decision_id"))
    return streams.decided(asked, answers, "user_id", "6 hours").select("event_id", "decision_id")


@query(
    f"with {_LOG}, l as (select *, event_id % 97 = 0 as bad, case when event_type = 'error' then 'ERROR' else 'INFO' end as level, 'app.' || content_type as logger, date_trunc('milliseconds', ts) as ms from log) "
    "select level, logger, count(*) as lines, min(ms) as first_at, max(ms) as last_at, count(distinct event_id) as messages from l where not bad group by level, logger "
    "union all select null, null, count(*), null, null, count(distinct event_id) from l where bad"
)
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as lines of a log, some of them broken, and read through the log source."""
    logs.register(spark)
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    good = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), level, F.lit(" app."), F.col("content_type"), F.lit(" event "), F.col("event_id").cast("string")
    )
    folder = fresh_folder(spark, "logs")
    log(spark, sf_dir).select(F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(good)).write.text(folder)
    lines = spark.read.format("rotated_logs").option("pattern", "part-*").load(folder)
    naive = lambda c: c.cast("timestamp_ntz")
    return lines.groupBy("level", "logger").agg(
        F.count("*").alias("lines"), naive(F.min("ts")).alias("first_at"), naive(F.max("ts")).alias("last_at"), F.countDistinct(F.coalesce("message", "bad")).alias("messages")
    )


@query(f"with {_LOG} select content_type, event_type, count(*)::double as value from log group by content_type, event_type")
def metric_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters written as lines for scrapers and read back."""
    logs.register(spark)
    folder = fresh_folder(spark, "metrics")
    counts = log(spark, sf_dir).groupBy("content_type", "event_type").agg(F.count("*").cast("double").alias("value"))
    labels = F.create_map(F.lit("content_type"), "content_type", F.lit("event_type"), "event_type")
    counts.select(F.lit("requests_total").alias("name"), labels.alias("labels"), "value").write.format("metrics").mode("append").save(folder)
    found = spark.read.format("metrics").load(folder).where("name = 'requests_total'")
    return found.select(F.col("labels")["content_type"].alias("content_type"), F.col("labels")["event_type"].alias("event_type"), "value")


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query(f"with {_LOG} select content_type, count(*) as n, count(distinct time_bucket(interval 1 hour, ts)) as windows, true as p50_ok, true as p95_ok, true as p99_ok from log where value is not null group by content_type")
def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from hourly sketches put together, and whether their true ranks are within the sketch's bound."""
    rows = log(spark, sf_dir)
    hourly = sketches.windowed(rows, "value", "content_type", "1 hour")
    found = sketches.with_quantiles(sketches.merged(hourly, ["content_type"]), SHARES)
    return sketches.within_bound(found, rows, "value", "content_type", SHARES)


def _trailing(seconds: int) -> str:
    return f"count(*) over (order by epoch_us(ts) range between {seconds * 1_000_000 - 1} preceding and current row) as last_{seconds}"


@query(f"with {_LOG} select event_id, {_trailing(60)}, {_trailing(300)}, {_trailing(86400)} from log")
def rate_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in the minute, the five minutes and the day up to each event."""
    return timeline.trailing_counts(log(spark, sf_dir).select("event_id", "ts"), "event_id", [60, 300, 86400]).drop("ts")


@query(
    f"with {_LOG}, e as (select user_id, ts, max(event_id) as entry from log where event_type = 'purchase' group by user_id, ts) "
    "select r.event_id, e.entry from (select * from log where event_type <> 'purchase') r asof left join e on r.user_id = e.user_id and r.ts >= e.ts"
)
def decision_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of its user that each other event came after."""
    rows = log(spark, sf_dir)
    entries = rows.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("entry_ts"), F.col("event_id").alias("entry"))
    asked = rows.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return timeline.in_force(asked, entries, "user_id", "ts", "entry_ts", ["entry"]).select("event_id", "entry")


@query("select doc_id, row_number() over () - 1 as position from documents")
def batch_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each document in the table, by which results are given back."""
    return timeline.with_file_ordinal(table(spark, sf_dir, "documents").select("doc_id"), "position")


@query(f"with {GRID_SQL} select item, {decision.cascade_sql('rule')} as rule, {decision.cascade_sql('decision')} as decision, {decision.cascade_sql('code')} as code from grid")
def sql_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade as a SQL user calls it."""
    register_functions(spark)
    view = f"siftwork_grid_{uuid.uuid4().hex}"
    score_grid(spark, sf_dir).createOrReplaceTempView(view)
    named = ", ".join(f"{k} => {k}" for k in decision.CASCADE_KEYS)
    found = spark.sql(f"select item, d.rule, d.decision, d.code from (select item, decide({named}) as d from {view})")
    spark.catalog.dropTempView(view)
    return found
