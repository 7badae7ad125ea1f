"""Windows, sessions and de-duplication that read alike from a stream and from a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 minute"


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late) if df.isStreaming else df


def tumbling(df: DataFrame, width: str, ts: str = "ts", late: str = LATE) -> DataFrame:
    counts = _timed(df, ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("requests"))
    return counts.select(F.col("window.start").alias("start"), "requests")


def sliding(df: DataFrame, width: str, step: str, ts: str = "ts", late: str = LATE) -> DataFrame:
    counts = _timed(df, ts, late).groupBy(F.window(ts, width, step)).agg(F.count("*").alias("requests"))
    return counts.select(F.col("window.start").alias("start"), "requests")


def sessions(df: DataFrame, key: str, gap: str, ts: str = "ts", late: str = LATE) -> DataFrame:
    counts = _timed(df, ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("requests"))
    return counts.select(key, F.col("session_window.start").alias("start"), "requests")


def first_seen(df: DataFrame, key: str, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Rows whose key has not come before within the watermark (in a table: ever)."""
    if df.isStreaming:
        return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


def with_cached(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Stream or table rows with the cached decision for their key, null where there is none."""
    return df.join(cache, key, "left")


def circuit_breaker(df: DataFrame, key: str, failed: str, ts: str = "ts", most: int = 5, cooldown_s: int = 60, forget_s: int = 3600, late: str = LATE) -> DataFrame:
    """State of each key's circuit after every row of a stream: failures in a row, and open or closed.

    ``most`` failures in a row open the circuit for ``cooldown_s`` seconds of event time; a success, or the
    end of that time, closes it. The state of a key that is silent for ``forget_s`` seconds of event time is dropped,
    as the watermark passes it, so states do not outnumber the keys in use.
    """
    key_type = df.schema[key].dataType.simpleString()
    state_type = "failures int, opened double"

    def step(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, opened = state.get if state.exists else (0, -1.0)
        rows = []
        for batch in batches:
            for at, bad in batch.sort_values(ts)[[ts, failed]].itertuples(index=False):
                now = at.timestamp()
                if opened >= 0 and now - opened >= cooldown_s:
                    failures, opened = 0, -1.0
                if not bad:
                    failures, opened = 0, -1.0
                elif opened < 0:
                    failures += 1
                    if failures >= most:
                        opened = now
                rows.append((names[0], at, failures, opened >= 0))
        state.update((failures, opened))
        state.setTimeoutTimestamp(max(int(1000 * (rows[-1][1].timestamp() + forget_s)), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, ts, "failures", "is_open"])

    return (
        _timed(df.select(key, ts, failed), ts, late)
        .groupBy(key)
        .applyInPandasWithState(
            step, f"{key} {key_type}, {ts} timestamp, failures int, is_open boolean", state_type, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def counters(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts that only grow: run in complete or update mode with a checkpoint, they outlive a restart."""
    return df.groupBy(*by).agg(F.count("*").alias("total"))


def append_to(df: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Write a stream as Parquet; without ``every`` it takes what is there and ends."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


class _Ring(StatefulProcessor):
    """The newest rows of a key, as list state that expires."""

    def __init__(self, schema: T.StructType, order: list[str], n: int, keep_ms: int):
        self.schema, self.order, self.n, self.keep_ms = schema, order, n, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", self.schema, self.keep_ms or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        held = pd.DataFrame([tuple(r) for r in self.ring.get()], columns=names)
        parts = [p for p in (held, *[r[names] for r in rows]) if len(p)]
        newest = pd.concat(parts, ignore_index=True).sort_values(self.order, ascending=False, kind="stable").head(self.n)
        self.ring.put([tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else None if x is pd.NaT else x for x in r) for r in newest.astype(object).itertuples(index=False)])
        newest = newest.reset_index(drop=True)
        newest.insert(0, "place", range(1, len(newest) + 1))
        yield newest

    def close(self) -> None:
        pass


def rings(df: DataFrame, key: str, order: list[str], n: int, keep_ms: int = 0) -> DataFrame:
    """The newest ``n`` rows of each key as a stream goes on: after every micro-batch the whole ring of each key that got rows, ``place`` 1 the newest.

    State is ``n`` rows a key; with ``keep_ms`` rows expire so many milliseconds of processing time after they came (such a stream has batches without
    data too, so it runs until it is stopped). The session needs the RocksDB
    state store (``ROCKSDB``). From a table: the rings at its end.
    """
    if not df.isStreaming:
        newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
        return df.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n).select(F.col("place").cast("long").alias("place"), *df.columns)
    schema = T.StructType([T.StructField("place", T.LongType()), *df.schema.fields])
    ring = _Ring(df.schema, order, n, keep_ms)
    return df.groupBy(key).transformWithStateInPandas(ring, schema, "Update", "ProcessingTime" if keep_ms else "None")


#: The state store that rings need: key, value of the session's setting.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def decided(requests: DataFrame, decisions: DataFrame, key: str, within: str, ts: str = "ts", decided_at: str = "decided_ts", late: str = LATE) -> DataFrame:
    """Every request with the decisions that followed it within an interval, or with nulls where none did.

    Both sides may be streams: each has a watermark of ``late``, so a request waits no longer than the interval and the watermark before it comes out
    unmatched, and rows later than the watermark are dropped. From tables: the same rows, none late.
    """
    left, right = _timed(requests, ts, late), _timed(decisions, decided_at, late)
    answers = right.withColumnRenamed(key, "__key")
    after = (F.col(decided_at) >= F.col(ts)) & (F.col(decided_at) <= F.col(ts) + F.expr(f"interval {within}"))
    return left.join(answers, (F.col(key) == F.col("__key")) & after, "left").drop("__key")
