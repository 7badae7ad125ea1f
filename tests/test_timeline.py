"""Ordinals, trailing counts, decisions in force, sketches and SQL functions on traps."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions import text
from siftwork.functions.sql import register_functions
from siftwork.operators import decision, similarity, sketches, timeline


def test_ordinals_over_partitions(spark):
    df = spark.range(0, 100, 1, 7).where("id % 10 <> 3").withColumn("x", F.lit("a"))
    rows = timeline.with_ordinal(df, settled=True).collect()
    assert [r["ordinal"] for r in rows] == list(range(90)) and [r["id"] for r in rows] == [i for i in range(100) if i % 10 != 3]
    # an order of its own, with empty partitions
    mixed = spark.range(0, 40, 1, 3).repartition(7).sortWithinPartitions(F.desc("id")).where("id > 20")
    found = timeline.with_ordinal(mixed, "at").collect()
    assert [r["at"] for r in found] == list(range(19))
    assert timeline.with_ordinal(spark.range(0)).collect() == []


def test_trailing_counts(spark):
    random.seed(1)
    start = datetime.datetime(2024, 1, 1, 23, 59, 0, tzinfo=datetime.timezone.utc)
    times = [start + datetime.timedelta(microseconds=random.choice([0, 1, 999_999, 10**6]) + 10**6 * random.choice([0, 1, 5, 60, 61, 200, 90_000])) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(times)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp").repartition(3)
    found = {r["id"]: (r["last_1"], r["last_60"], r["last_86400"]) for r in timeline.trailing_counts(df, "id", [1, 60, 86400]).collect()}
    back = lambda t, s: sum(t - datetime.timedelta(seconds=s) < u <= t for u in times)
    assert found == {i: (back(t, 1), back(t, 60), back(t, 86400)) for i, t in enumerate(times)} | {1000: (None, None, None)}
    assert timeline.trailing_counts(df.where("id < 0"), "id", [60]).collect() == []


def test_decisions_in_force_over_pieces_of_time(spark):
    random.seed(2)
    at = lambda m: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=m)
    entries = [("ab"[i % 2], at(random.randrange(0, 6000, 10)), i) for i in range(60)] + [("a", at(100), 500), ("a", at(100), 501), (None, at(0), 7), ("b", None, 8)]
    asked = [(i, "abc"[i % 3], at(random.randrange(0, 9000, 5))) for i in range(150)] + [(900, "a", at(100)), (901, None, at(5)), (902, "a", None), (903, "a", at(100))]
    left = spark.createDataFrame(asked, "id long, key string, ts timestamp").repartition(3)
    right = spark.createDataFrame(entries, "key string, entry_ts timestamp, entry long").repartition(2)
    found = {r["id"]: r["entry"] for r in timeline.in_force(left, right, "key", "ts", "entry_ts", ["entry"], piece_seconds=3600).collect()}

    def plain(k, t):
        known = [(u, e) for q, u, e in entries if q is not None and q == k and u is not None and t is not None and u <= t]
        return max(known)[1] if known else None

    assert found == {i: plain(k, t) for i, k, t in asked} and found[900] == found[903] == 501


def test_sketches_by_window_equal_one_sketch(spark):
    random.seed(3)
    rows = [("ab"[i % 2], datetime.datetime(2024, 1, 1 + i % 9, tzinfo=datetime.timezone.utc), random.lognormvariate(0, 2) if i % 50 else None) for i in range(8000)]
    log = spark.createDataFrame([*rows, ("a", rows[0][1], float("nan")), ("none", rows[0][1], None)], "kind string, ts timestamp, v double")
    hourly = sketches.windowed(log, "v", "kind", "1 day")
    assert hourly.count() == 18 and hourly.agg(F.sum("n")).first()[0] == 7840
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = sketches.with_quantiles(sketches.merged(hourly, ["kind"]), shares)
    ok = sketches.within_bound(found, log, "v", "kind", shares).collect()
    assert {(r["kind"], r["windows"]) for r in ok} == {("a", 9), ("b", 9)} and all(r[f"{s}_ok"] for r in ok for s in shares)
    wrong = found.withColumn("p50", F.col("p95"))
    assert not any(r["p50_ok"] for r in sketches.within_bound(wrong, log, "v", "kind", shares).collect())


def test_sql_functions(spark):
    assert {"decide", "normalise_text", "hash_distance"} <= set(register_functions(spark))
    row = spark.sql("select decide(adult_score => 0.95) as a, decide() as b, decide(qr_code_score => cast(null as double), blood_score => 0.9).code as c, decide_rule(weapon_score => 0.9) as d").first()
    assert (row["a"]["rule"], row["b"]["decision"], row["c"], row["d"]) == ("R01", "APPROVED", "GORE_CONTENT", "R05")
    texts = spark.createDataFrame([("  A b\t\nC ",), ("",), (None,), (" É",)], "t string")
    texts.createOrReplaceTempView("texts_of_a_test")
    both = spark.sql("select t, normalise_text(t) as n from texts_of_a_test").withColumn("m", text.normalise(F.col("t"))).collect()
    assert [r["n"] for r in both] == [r["m"] for r in both] and both[0]["n"] == "a b c"
    assert spark.sql("select hash_distance(5, 6)").first()[0] == spark.range(1).select(similarity.hamming(F.lit(5), F.lit(6))).first()[0] == 2
    plan = spark.sql("select decide(adult_score => id / 10.0D).code as c from range(5)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert len(decision.CASCADE_KEYS) == 41


@pytest.mark.parametrize("n", [0, 1])
def test_carry_of_little(spark, n):
    df = spark.createDataFrame([("a", 0, 1, 5)][:n], "k string, p int, o int, v int")
    assert [r["c"] for r in timeline.carry_forward(df, ["k"], "p", "o", F.col("v"), "c").collect()] == [5][:n]
