from pyspark.sql import functions as F

from siftwork.streaming import streams


def drained(df, tmp_path, name):
    out, mark = str(tmp_path / name), str(tmp_path / f"{name}-mark")
    streams.append_to(df, out, mark).awaitTermination(120)
    return df.sparkSession.read.parquet(out)


def source(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def test_tumbling_windows_match_the_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    streamed = drained(streams.tumbling(source(spark, sf_dir), "10 seconds", late="0 seconds"), tmp_path, "tumbling")
    # the newest windows stay open until the watermark passes them
    got = {(r["start"], r["requests"]) for r in streamed.collect()}
    want = {(r["start"], r["requests"]) for r in streams.tumbling(batch, "10 seconds").collect()}
    assert got <= want and len(want) - len(got) <= 2


def test_first_seen(spark, sf_dir, tmp_path):
    rows = drained(streams.first_seen(source(spark, sf_dir), "event_type", late="400 days"), tmp_path, "first")
    assert rows.count() == rows.select("event_type").distinct().count()


def test_circuit_breaker(spark, tmp_path):
    times = [(f"2024-01-01 00:00:{s:02d}", bad) for s, bad in enumerate([True, True, True, False, True])] + [("2024-01-01 00:02:00", True)]
    rows = spark.createDataFrame([("a", t, b) for t, b in times], "k string, t string, failed boolean")
    rows.withColumn("ts", F.col("t").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t string, failed boolean, ts timestamp").parquet(str(tmp_path / "in"))
    out = drained(streams.circuit_breaker(stream, "k", "failed", most=3), tmp_path, "breaker").orderBy("ts").collect()
    assert [(r["failures"], r["is_open"]) for r in out] == [(1, False), (2, False), (3, True), (0, False), (1, False), (2, False)]


def test_sliding_windows_join_the_cache_and_count(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    wide = lambda df: streams.sliding(df, "2 hours", "1 hour", late="0 seconds")
    got = {(r["start"], r["requests"]) for r in drained(wide(source(spark, sf_dir)), tmp_path, "sliding").collect()}
    assert got <= {(r["start"], r["requests"]) for r in wide(batch).collect()}
    cache = spark.createDataFrame([("view", "APPROVED")], "event_type string, decision string")
    joined = drained(streams.with_cached(source(spark, sf_dir), cache, "event_type"), tmp_path, "joined")
    assert joined.where("event_type = 'view' and decision is null").count() == 0
    assert joined.count() == batch.count() and joined.where("event_type <> 'view' and decision is not null").count() == 0


def test_counters_outlive_a_restart(spark, tmp_path):
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    totals = {}

    def keep(df, _):
        totals.update({r["kind"]: r["total"] for r in df.collect()})

    for kinds in (["a", "a", "b"], ["a", "c"]):
        spark.createDataFrame([(k,) for k in kinds], "kind string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("kind string").parquet(folder)
        counted = streams.counters(stream, ["kind"]).writeStream.outputMode("update").option("checkpointLocation", mark).foreachBatch(keep)
        counted.trigger(availableNow=True).start().awaitTermination(120)
    assert totals == {"a": 3, "b": 1, "c": 1}


def test_an_open_circuit_expires(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", True), ("a", "2024-01-01 00:00:01", True), ("b", "2024-01-01 06:00:00", False), ("a", "2024-01-01 06:00:01", True)]
    for i, row in enumerate(rows):
        one = spark.createDataFrame([row], "k string, t string, failed boolean").withColumn("ts", F.col("t").cast("timestamp"))
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, t string, failed boolean, ts timestamp").parquet(str(tmp_path / "in"))
        out = drained(streams.circuit_breaker(stream, "k", "failed", most=3), tmp_path, "breaker").orderBy("ts").collect()
    # the two failures of the morning were forgotten by the evening
    assert [r["failures"] for r in out] == [1, 2, 0, 1]
