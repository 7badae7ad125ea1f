"""The kept index, rings, stream-stream joins, the log source and the metric sink: restarts, lateness, failures."""

import os

import pytest
from pyspark.sql import functions as F

from siftwork.sources import kept_index, logs
from siftwork.streaming import streams


def entries(df):
    return sorted(map(tuple, df.collect()))


def batch(spark, rows):
    return spark.createDataFrame(rows, "key long, at long, what string")


def test_upserts_trims_and_snapshots(spark, tmp_path):
    index = kept_index.KeptIndex(spark, str(tmp_path / "ix"), "key", buckets=3)
    with pytest.raises(ValueError):
        index.read()
    assert index.upsert(batch(spark, [(k, k, "a") for k in range(20)]), ["at"], "s", 0)
    assert index.upsert(batch(spark, [(k, 100 + k, "b") for k in range(10, 30)] + [(10, 1, "old"), (10, 200, "new")]), ["at"], "s", 1)
    assert not index.upsert(batch(spark, [(1, 1, "again")]), ["at"], "s", 1) and not index.upsert(batch(spark, [(1, 1, "again")]), ["at"], "s", 0)
    want = {k: (k, k, "a") for k in range(20)} | {k: (k, 100 + k, "b") for k in range(10, 30)} | {10: (10, 200, "new")}
    assert entries(index.read()) == sorted(want.values())
    index.compact()
    assert len(index.manifest()["segments"]) == 1 and entries(index.read()) == sorted(want.values())
    index.trim(0.1, 10, "at")
    assert entries(index.read()) == sorted(v for v in want.values() if v[1] > 2)
    assert entries(index.read(1)) == [(k, k, "a") for k in range(20)]
    assert index.upsert(batch(spark, [(0, 5, "back")]), ["at"])
    gone = index.vacuum(keep=1)
    assert len(gone) == 3 and (0, 5, "back") in entries(index.read()) and index.versions() == [5]
    assert not index.upsert(batch(spark, [(1, 1, "again")]), ["at"], "s", 1)


def test_a_change_meanwhile(spark, tmp_path, monkeypatch):
    index, other = (kept_index.KeptIndex(spark, str(tmp_path / "ix"), "key") for _ in range(2))
    index.upsert(batch(spark, [(1, 1, "a")]), ["at"])
    plain = kept_index.KeptIndex._write

    def slow(self, df):
        segment = plain(self, df)
        if self is index:
            other.upsert(batch(spark, [(2, 2, "b")]), ["at"])
        return segment

    monkeypatch.setattr(kept_index.KeptIndex, "_write", slow)
    with pytest.raises(kept_index.Conflict):
        index.compact()
    assert index.upsert(batch(spark, [(3, 3, "c")]), ["at"])
    assert entries(index.read()) == [(1, 1, "a"), (2, 2, "b"), (3, 3, "c")]
    # a manifest that is being written does not count
    (tmp_path / "ix" / "manifests" / "000000000099.json").write_text('{"version": 99')
    assert index.manifest()["version"] == 4


def test_a_followed_stream_stops_and_restarts(spark, tmp_path):
    schema = "key long, at long, what string"
    index = kept_index.KeptIndex(spark, str(tmp_path / "ix"), "key")
    took = []
    for n in range(3):
        batch(spark, [(k, n, f"run {n}") for k in range(n * 5, n * 5 + 10)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 1:
            # a failure between the upsert and the stream's own commit: the batch is offered again
            plain = index.upsert

            def failing(*args, **more):
                took.append(plain(*args, **more))
                raise RuntimeError("lost")

            index.upsert = failing
            with pytest.raises(Exception, match="lost"):
                index.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["at"], "posts", str(tmp_path / "mark")).awaitTermination(120)
            index.upsert = plain
        index.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["at"], "posts", str(tmp_path / "mark"), compact_after=3).awaitTermination(120)
    assert took == [True]
    assert entries(index.read()) == [(k, min(2, k // 5), f"run {min(2, k // 5)}") for k in range(20)]
    assert index.manifest()["batches"] == {"posts": 2} and len(index.manifest()["segments"]) == 1


def arriving(spark, tmp_path, name, schema, batches):
    """Run ``then`` after each batch has come in as a file."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        yield spark.readStream.schema(schema).parquet(str(tmp_path / name))


def test_rings_equal_the_table_and_stay_small(spark, tmp_path):
    schema = "kind string, ts timestamp, event long"
    whole = [("ab"[i % 2] if i % 7 else "rare", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i) for i in range(300)]
    rows = spark.createDataFrame(whole, "kind string, t string, event long").select("kind", F.col("t").cast("timestamp").alias("ts"), "event").collect()
    state, ring = {}, {}
    spark.conf.set(*streams.ROCKSDB)
    try:
        for stream in arriving(spark, tmp_path, "in", schema, [rows[100:200], rows[:100], rows[200:]]):
            def keep(df, _):
                for r in df.collect():
                    ring.setdefault(r["kind"], {})[r["place"]] = r["event"]

            q = streams.rings(stream, "kind", ["ts", "event"], 5).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).foreachBatch(keep)
            q = q.trigger(availableNow=True).start()
            q.awaitTermination(120)
            state = q.lastProgress["stateOperators"][0]
    finally:
        spark.conf.unset(streams.ROCKSDB[0])
    table = streams.rings(spark.createDataFrame(rows, schema), "kind", ["ts", "event"], 5).collect()
    want = {}
    for r in table:
        want.setdefault(r["kind"], {})[r["place"]] = r["event"]
    assert ring == want and {k: max(v.values()) for k, v in want.items()} == {"a": 298, "b": 299, "rare": 294}
    assert state["numRowsTotal"] <= 3 * 5 + 3


def test_decisions_join_their_requests(spark, tmp_path):
    at = lambda m, s=0: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:{s:02d}"
    asked = [[(1, at(0)), (2, at(1)), (3, at(2))], [(4, at(30)), (1, at(31))], [(5, at(90)), (99, at(3))], [(6, at(200))]]
    answers = [[(1, at(0, 30), "ok"), (1, at(4), "ok again"), (2, at(9), "too late for its request")], [(4, at(29), "before"), (4, at(33), "no")], [(5, at(91), "ok"), (98, at(4), "late")], [(7, at(200), "x")]]
    typed = lambda rows, schema: spark.createDataFrame(rows, schema)
    q_schema, a_schema = "key long, ts timestamp", "key long, decided_ts timestamp, decision string"
    got, dropped = [], 0
    for n in range(4):
        typed(asked[n], "key long, t string").select("key", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "q"))
        typed(answers[n], "key long, t string, decision string").select("key", F.col("t").cast("timestamp").alias("decided_ts"), "decision").coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        left, right = spark.readStream.schema(q_schema).parquet(str(tmp_path / "q")), spark.readStream.schema(a_schema).parquet(str(tmp_path / "a"))
        joined = streams.decided(left, right, "key", "5 minutes", late="10 minutes")
        q = joined.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        q.awaitTermination(120)
        dropped += sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    batch_rows = streams.decided(spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "a")), "key", "5 minutes")
    want = {tuple(r) for r in batch_rows.collect()}
    assert len(got) == len(set(got)) and dropped >= 2
    # the late rows, and requests that may still be answered, are not in the stream's output
    assert {r[0] for r in want - set(got)} == {99, 6} and set(got) <= want
    assert sorted((r[0], r[3]) for r in got if r[3]) == [(1, "ok"), (1, "ok again"), (4, "no"), (5, "ok")]


def line(n, level="INFO", text="served"):
    return f"2024-01-01 00:{n // 60 % 60:02d}:{n % 60:02d},{n % 1000:03d} {level} app.mod {text} {n}\n"


def test_logs_in_batch(spark, tmp_path, monkeypatch):
    logs.register(spark)
    monkeypatch.setattr(logs, "RANGE", 101)
    (tmp_path / "app.log").write_text("".join(line(n) for n in range(50)) + "Traceback:\n  boom é\n\n" + line(50, "ERROR") + "2024-13-01 00:00:00,000 INFO a b\nunfinished")
    (tmp_path / "app.log.1").write_text(line(100, text="x" * 300) + line(101))
    (tmp_path / "other.txt").write_text("no log\n")
    (tmp_path / "empty.log").write_text("")
    rows = spark.read.format("rotated_logs").load(str(tmp_path)).collect()
    assert sorted(r["message"] for r in rows if r["bad"] is None) == sorted([f"served {n}" for n in range(51)] + ["x" * 300 + " 100", "served 101"])
    assert sorted(r["bad"] for r in rows if r["bad"] is not None) == sorted(["Traceback:", "  boom é", "", "2024-13-01 00:00:00,000 INFO a b", "unfinished"])
    assert {r["level"] for r in rows} == {"INFO", "ERROR", None} and all((r["ts"] is None) == (r["bad"] is not None) for r in rows)
    assert spark.read.format("rotated_logs").option("pattern", "none*").load(str(tmp_path)).count() == 0


def test_logs_as_a_stream_over_rotation_and_restarts(spark, tmp_path):
    logs.register(spark)
    folder, mark, out = tmp_path / "logs", str(tmp_path / "mark"), str(tmp_path / "out")
    folder.mkdir()

    def run():
        stream = spark.readStream.format("rotated_logs").load(str(folder))
        streams.append_to(stream, out, mark).awaitTermination(120)
        return sorted(r["message"] for r in spark.read.parquet(out).collect())

    named = lambda ns: sorted(f"served {n}" for n in ns)
    (folder / "app.log").write_text("".join(line(n) for n in range(10)) + line(10)[:20])
    assert run() == named(range(10))
    # the line is finished, the file is rotated and another one begun
    (folder / "app.log").write_text("".join(line(n) for n in range(15)))
    os.rename(folder / "app.log", folder / "app.log.1")
    (folder / "app.log").write_text(line(15)[:5])
    assert run() == named(range(15))
    (folder / "app.log").write_text("".join(line(n) for n in range(15, 18)))
    assert run() == named(range(18))
    assert run() == named(range(18))


METRICS = "name string, labels map<string,string>, value double"


def test_metrics_are_written_whole_or_not_at_all(spark, tmp_path):
    logs.register(spark)
    path = str(tmp_path / "metrics")
    rows = [("requests", {"kind": 'a"b\\c\nd', "at": "x,y={z}"}, 3.0), ("requests", {}, 0.5), ("slow", None, 1e-9), ("slow", {"k": None}, float("inf"))]
    spark.createDataFrame(rows, METRICS).repartition(3).write.format("metrics").mode("append").save(path)
    read = lambda: sorted((r["name"], tuple(sorted(r["labels"].items())), r["value"]) for r in spark.read.format("metrics").load(path).collect())
    want = sorted((n, tuple(sorted((k, v or "") for k, v in (labels or {}).items())), v) for n, labels, v in rows)
    assert read() == want

    @F.udf("double")
    def failing(i):
        if i == 7:
            raise ValueError("broken row")
        return float(i)

    bad = spark.range(0, 10, 1, 4).select(F.lit("bad").alias("name"), F.create_map(F.lit("i"), F.col("id").cast("string")).alias("labels"), failing("id").alias("value"))
    with pytest.raises(Exception, match="broken row"):
        bad.write.format("metrics").mode("append").save(path)
    assert read() == want and all(n.startswith("run-") for n in os.listdir(path))
    spark.createDataFrame(rows[1:2], METRICS).write.format("metrics").mode("overwrite").save(path)
    assert read() == [("requests", (), 0.5)] and len(os.listdir(path)) == 1
