"""An index of entries by key that is kept between runs: upserts from batches and streams, trims, snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.similarity import trim_oldest
from siftwork.sources import files


class Conflict(RuntimeError):
    """Someone else changed the index meanwhile."""


class KeptIndex:
    """Entries in Parquet segments under a folder, and numbered manifests that say which segments count.

    A change writes a segment of its own and then a manifest with the next number, which exists as a whole or not at all; readers take the
    newest one, so they see a change whole or not at all, and a job that fails leaves files that no manifest names. Of entries of one
    key the one of the latest segment counts. A segment is hash-partitioned by key into ``buckets`` folders, so entries of
    a key lie in the same bucket of every segment. Two writers can't commit the same number: an upsert tries
    again on the other's manifest, a rewrite gives up with ``Conflict``.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # manifests

    def versions(self) -> list[int]:
        found = files.names(self.spark, f"{self.path}/manifests")
        return sorted(int(n.split(".")[0]) for n in found if n.endswith(".json") and n.split(".")[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or an older one; one that is being written does not count yet."""
        for n in sorted((v for v in self.versions() if version is None or v == version), reverse=True):
            text = files.read_text(self.spark, f"{self.path}/manifests/{n:012d}.json")
            if text.endswith("\n"):
                return json.loads(text)
        if version is not None:
            raise ValueError(f"no version {version} of {self.path}")
        return {"version": 0, "segments": [], "batches": {}, "schema": None}

    def _commit(self, manifest: dict) -> bool:
        return files.create(self.spark, f"{self.path}/manifests/{manifest['version']:012d}.json", json.dumps(manifest) + "\n")

    # changes

    def _write(self, df: DataFrame) -> dict:
        name = f"segments/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        held = df.withColumn("bucket", bucket).repartition(self.buckets, "bucket")
        held.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return {"name": name, "schema": df.schema.jsonValue()}

    def upsert(self, df: DataFrame, order: list[str], source: str | None = None, batch: int | None = None, tries: int = 10) -> bool:
        """Add entries, or put them in place of those of their keys; of several with one key in ``df`` the last by ``order`` is taken.

        A batch of a numbered source is taken once, however often it is offered: the manifest keeps the last number of each
        source. Returns False if it had been taken.
        """
        seen = lambda m: source is not None and m["batches"].get(source, -1) >= batch
        if seen(self.manifest()):
            return False
        columns = df.columns
        newest = df.groupBy(self.key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__e")).select("__e.*")
        segment = self._write(newest)
        for _ in range(tries):
            now = self.manifest()
            if seen(now):
                return False
            segments = [*now["segments"], {"name": segment["name"], "seq": now["version"] + 1}]
            batches = now["batches"] | ({source: batch} if source is not None else {})
            if self._commit({"version": now["version"] + 1, "segments": segments, "batches": batches, "schema": now["schema"] or segment["schema"]}):
                return True
        raise Conflict(f"{tries} other changes came first")

    def _replace(self, change: Callable[[DataFrame], DataFrame]) -> None:
        now = self.manifest()
        if not now["segments"]:
            return
        segment = self._write(change(self._read(now)))
        after = {"version": now["version"] + 1, "segments": [{"name": segment["name"], "seq": now["version"] + 1}], "batches": now["batches"], "schema": now["schema"]}
        if not self._commit(after):
            raise Conflict("the index was changed during a rewrite")

    def compact(self) -> None:
        """One segment that holds each key's entry alone."""
        self._replace(lambda df: df)

    def trim(self, share: float, most: int, order: str) -> None:
        """Drop the oldest share of the entries by ``order``, one at least, when there are more than ``most``."""
        self._replace(lambda df: trim_oldest(df, share, most, order))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the segments that none of the newest ``keep`` manifests names, and older manifests. Nothing may be writing. Returns what went."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        named = {s["name"] for v in kept for s in self.manifest(v)["segments"]}
        gone = [f"segments/{n}" for n in files.names(self.spark, f"{self.path}/segments") if f"segments/{n}" not in named]
        for name in [f"manifests/{v:012d}.json" for v in old] + gone:
            files.delete(self.spark, f"{self.path}/{name}")
        return gone

    # reads

    def _read(self, manifest: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        if not manifest["segments"]:
            raise ValueError(f"nothing was put into {self.path}")
        schema = StructType.fromJson(manifest["schema"])
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{s['name']}").withColumn("__seq", F.lit(s["seq"])) for s in manifest["segments"]]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.union(p)
        columns = schema.fieldNames()
        if len(parts) == 1:
            return whole.select(*columns)
        return whole.groupBy(self.key).agg(F.max_by(F.struct(*columns), "__seq").alias("__e")).select("__e.*")

    def read(self, version: int | None = None) -> DataFrame:
        """The entries as they are, or as they were at a version."""
        return self._read(self.manifest(version))

    def follow(self, stream: DataFrame, order: list[str], source: str, checkpoint: str, compact_after: int = 32):
        """Upsert a stream's micro-batches, each once; segments are made one when there are ``compact_after``. Takes what is there and ends."""

        def take(df: DataFrame, batch: int) -> None:
            self.upsert(df, order, source, batch)
            if len(self.manifest()["segments"]) >= compact_after:
                self.compact()

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
