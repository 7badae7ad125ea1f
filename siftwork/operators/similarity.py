"""Joins by likeness: perceptual hashes within a Hamming distance, vectors above an inner product."""

from __future__ import annotations

import functools
import itertools
import math
import operator
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.text import once
from siftwork.operators.lineage import checkpointed

BITS = 64


def hash_bits(hexadecimal: Column) -> Column:
    """A 16-digit hexadecimal hash as a signed 64-bit integer."""
    return F.conv(hexadecimal, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_join(items: DataFrame, cache: DataFrame, item_hash: str, cache_hash: str, most: int = 5) -> DataFrame:
    """All pairs within ``most`` bits, without comparing every pair.

    The bits are cut into most + 2 bands; hashes that differ in ``most`` bits at most agree in two bands, so an
    equi-join on the bits of two bands finds every pair (for 5 bits 18 or more bits, so few others). A pair is kept
    at its first two common bands alone, so none is repeated. Adds ``distance``. Null hashes match nothing.
    """
    count = most + 2
    edges = [round(BITS * i / count) for i in range(count + 1)]
    couples = list(itertools.combinations(range(count), 2))

    def band(h: Column, i: int) -> Column:
        return F.shiftrightunsigned(F.shiftleft(h, BITS - edges[i + 1]), BITS - (edges[i + 1] - edges[i]))

    def banded(df: DataFrame, column: str, pair: str, bits: str) -> DataFrame:
        h = F.col(column)
        keys = [F.struct(F.lit(n).alias("pair"), F.shiftleft(band(h, i), edges[j + 1] - edges[j]).bitwiseOR(band(h, j)).alias("bits")) for n, (i, j) in enumerate(couples)]
        return df.where(h.isNotNull()).withColumn("__b", F.explode(F.array(*keys))).select(*df.columns, F.col("__b.pair").alias(pair), F.col("__b.bits").alias(bits))

    left, right = banded(items, item_hash, "__pair", "__bits"), banded(cache, cache_hash, "__c_pair", "__c_bits")
    alike = [band(F.col(item_hash).bitwiseXOR(F.col(cache_hash)), i) == 0 for i in range(count)]
    first = F.coalesce(*[F.when(alike[i] & alike[j], F.lit(n)) for n, (i, j) in enumerate(couples)])
    joined = left.join(right, (F.col("__pair") == F.col("__c_pair")) & (F.col("__bits") == F.col("__c_bits")))
    return (
        joined.withColumn("distance", hamming(F.col(item_hash), F.col(cache_hash)))
        .where((F.col("distance") <= most) & (F.col("__pair") == first))
        .drop("__pair", "__bits", "__c_pair", "__c_bits")
    )


def first_within(items: DataFrame, cache: DataFrame, item: str, item_hash: str, cached: str, cache_hash: str, most: int = 5) -> DataFrame:
    """The smallest cached key within ``most`` bits of each item's hash, with its ``distance``.

    Equal hashes are one hash on both sides, so copies of an item or a cached entry meet once.
    """
    asked = items.select(F.col(item_hash).alias("__q")).where(F.col("__q").isNotNull()).distinct()
    known = cache.groupBy(F.col(cache_hash).alias("__c")).agg(F.min(cached).alias(cached))
    pairs = hamming_join(asked, known, "__q", "__c", most)
    best = pairs.groupBy("__q").agg(F.min(F.struct(cached, "distance")).alias("__best"))
    return items.join(best, F.col(item_hash) == F.col("__q")).select(item, F.col(f"__best.{cached}").alias(cached), F.col("__best.distance").alias("distance"))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def unit(v: Column) -> Column:
    """The vector at length 1, null for a zero one; vector and length are computed once, not for each component."""
    def scaled(x: Column) -> Column:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
        return once(norm, lambda n: F.when(n > 0, F.transform(x, lambda c: c.cast("double") / n)))

    return once(v, scaled)


#: Tables of random hyperplanes to begin with, and at most; buckets that an item asks in each.
TABLES, MORE_TABLES, PROBES = 8, 16, 32
#: Cached vectors of a bucket, about, and the bits of a bucket's number.
BUCKET, LEAST_BITS, MOST_BITS = 1, 12, 30
#: Cached vectors of neighbouring buckets that meet their items in one task, about; rows of each side in one group.
REGION, GROUP_ROWS = 4096, 4096
#: Items whose match is looked for in the whole cache to measure recall, and the recall below which all are.
SAMPLE, RECALL = 256, 0.9
ROUNDING = 1e-9
#: Vectors that a task hands to Spark at once, in bytes.
SLICE_BYTES = 16 * 2**20


def sound(v: Column) -> Column:
    """True for a vector that is there, is not empty, holds finite numbers alone and is not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


class Planes:
    """Hyperplanes through the origin, the same wherever they are made: ``bits`` for each table and length of vectors."""

    def __init__(self, bits: int, tables: int):
        self.bits, self.tables = bits, tables
        self.made: dict[int, np.ndarray] = {}

    def sides(self, v: np.ndarray) -> np.ndarray:
        """How far each vector is on the positive side of each plane: (vectors, tables, bits)."""
        dim = v.shape[1]
        if dim not in self.made:
            self.made[dim] = np.random.default_rng([17, dim]).standard_normal((MORE_TABLES, MOST_BITS, dim))[: self.tables, : self.bits]
        return np.einsum("nd,tbd->ntb", v, self.made[dim], optimize=True)

    def buckets(self, sides: np.ndarray) -> np.ndarray:
        return (sides > 0) @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def probes(self, sides: np.ndarray) -> np.ndarray:
        """The buckets that a vector near this one most likely is in: its own, and those across the nearest planes."""
        n, tables, bits = sides.shape
        near = np.argsort(np.abs(sides), axis=2)[:, :, : min(PLANES_NEAR, bits)]
        gap = np.take_along_axis(np.abs(sides), near, 2)
        flips = np.array(list(itertools.product((0, 1), repeat=near.shape[2])), np.int64)
        cost = (gap**2) @ flips.T
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :PROBES]
        masks = (np.int64(1) << (bits - 1 - near).astype(np.int64)) @ flips.T
        return self.buckets(sides)[:, :, None] ^ np.take_along_axis(masks, best, 2)


#: Planes nearest to an item of which any may be crossed.
PLANES_NEAR = 7


def best_match(
    items: DataFrame, cache: DataFrame, item: str, item_vector: str, cached: str, cache_vector: str, least: float = 0.93, measured: dict | None = None
) -> DataFrame:
    """The unit vector of the whole cache with the highest inner product for each unit item, if it reaches ``least``.

    Several tables of random hyperplanes deal the cache into buckets; an item asks, in each table, its own bucket and those across the planes
    that it is nearest to, and is compared with the vectors there. Buckets are cut so that they hold some ``BUCKET`` vectors, however large the cache is. Neighbouring buckets meet
    their items in one group, and large groups are split on both sides, so no task gets a hot bucket whole. Equal vectors
    are one vector on both sides (the smallest cached key stands for its copies).

    Recall is measured: ``SAMPLE`` items are compared with the whole cache. Below ``RECALL`` the tables are doubled once, and
    after that all items are compared with the whole cache in blocks, which is exact. ``measured``, if given, receives
    ``recall``, ``tables`` (0: exact), ``compared`` (pairs) and ``pairs`` (all pairs of distinct vectors).

    Ties (of the product rounded to 12 places) go to the smaller key. Vectors that are null or empty, hold null or non-finite components, or are zero
    match nothing and hide nothing; vectors of different lengths do not meet.
    """
    item_kind, cached_kind = "bigint", cache.schema[cached].dataType.simpleString()
    # the filter sees the vector once, whatever it is computed from
    kept = lambda v: once(v.cast("array<double>"), lambda x: F.when(sound(x), x))
    clean = lambda df, key, v: df.select(F.col(key).alias("key"), kept(F.col(v)).alias("v")).where(F.col("v").isNotNull())
    said = checkpointed(clean(items, item, item_vector))
    known = checkpointed(clean(cache, cached, cache_vector).groupBy("v").agg(F.min("key").alias("key")))
    asked = checkpointed(said.select("v").distinct().withColumn("key", F.monotonically_increasing_id()))
    size = known.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, size) / BUCKET))))
    sample = asked.orderBy(F.xxhash64("v"), "key").limit(SAMPLE).toArrow()
    wanted = _exactly(sample, known, least) if len(sample) else {}
    best, tables, recall = None, TABLES, 0.0
    while tables <= MORE_TABLES:
        pairs = checkpointed(_by_tables(asked, known, item_kind, cached_kind, Planes(bits, tables), least, size))
        best = _best_of(pairs, least)
        mine = F.broadcast(asked.sparkSession.createDataFrame(pa.table({"of": sample.column("key")})))
        # one row for each sampled item that has a match
        got = {r["key"]: r["similarity"] for r in best.join(mine, F.col("key") == F.col("of")).select("key", "similarity").collect()}
        recall = sum(got.get(k, -2.0) >= s - ROUNDING for k, s in wanted.items()) / len(wanted) if wanted else 1.0
        if recall >= RECALL:
            break
        tables *= 2
    if recall < RECALL:
        pairs, tables = checkpointed(_in_blocks(asked, known, item_kind, cached_kind, least)), 0
        best = _best_of(pairs, least)
    if measured is not None:
        compared = pairs.agg(F.sum("compared")).first()[0] or 0
        measured |= {"recall": recall, "tables": tables, "compared": compared, "pairs": size * asked.count()}
    named = best.select(F.col("key").alias("of"), "cached", "similarity").join(asked.select("key", "v"), F.col("key") == F.col("of")).select(
        F.col("v").alias("of_v"), "cached", "similarity"
    )
    return said.join(named, F.col("v") == F.col("of_v")).select(F.col("key").alias(item), F.col("cached").alias(cached), "similarity")


def _by_length(batch: pa.RecordBatch, copies: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each length of vectors, and their matrix; no more rows at once than fit ``SLICE_BYTES`` if each leaves in so many ``copies``."""
    lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        most = max(1, SLICE_BYTES // (8 * copies * dim))
        for lo in range(0, len(rows), most):
            part = batch.take(pa.array(rows[lo : lo + most]))
            yield part, _rows(part.column("v"))


def _by_tables(asked: DataFrame, known: DataFrame, item_kind: str, cached_kind: str, planes: Planes, least: float, size: int) -> DataFrame:
    """(key, cached, similarity, compared): the best of the buckets that an item asks, by groups of regions."""
    inside = max(0, planes.bits - max(0, math.ceil(math.log2(max(1, size / REGION)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, v in _by_length(batch, planes.tables):
                bucket = planes.buckets(planes.sides(v))
                row, table = (x.ravel() for x in np.indices(bucket.shape))
                yield _dealt(part, row, v.shape[1], table, bucket.ravel() >> inside, pa.array(bucket.ravel()[:, None].tolist(), pa.list_(pa.int64())))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # an item leaves once for each region that it asks, of which a larger cache has more
            for part, v in _by_length(batch, planes.tables * PROBES):
                probes = planes.probes(planes.sides(v))
                row, table, _ = (x.ravel() for x in np.indices(probes.shape))
                bucket = probes.ravel()
                order = np.lexsort((bucket, table, row))
                row, table, bucket = row[order], table[order], bucket[order]
                region = bucket >> inside
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (table[1:] != table[:-1]) | (region[1:] != region[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(bucket)].astype(np.int32)), pa.array(bucket))
                yield _dealt(part, row[first], v.shape[1], table[first], region[first], lists)

    schema = "key {0}, v array<double>, dim int, tab int, region long, buckets array<bigint>"
    return _met(asked.mapInArrow(ask, schema.format(item_kind)), known.mapInArrow(deal, schema.format(cached_kind)), item_kind, cached_kind, least)


def _dealt(part: pa.RecordBatch, row: np.ndarray, dim: int, table: np.ndarray, region: np.ndarray, buckets: pa.Array) -> pa.RecordBatch:
    rows = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [part.column("key").take(rows), part.column("v").take(rows), pa.array(np.full(len(row), dim, np.int32)), pa.array(table.astype(np.int32)), pa.array(region), buckets],
        ["key", "v", "dim", "tab", "region", "buckets"],
    )


def _in_blocks(asked: DataFrame, known: DataFrame, item_kind: str, cached_kind: str, least: float) -> DataFrame:
    """Every item beside every cached vector of its length, in blocks."""
    one = lambda df: df.select("key", "v", F.size("v").alias("dim"), F.lit(0).alias("tab"), F.lit(0).cast("long").alias("region"), F.array(F.lit(0).cast("long")).alias("buckets"))
    return _met(one(asked), one(known), item_kind, cached_kind, least)


def _met(asking: DataFrame, dealt: DataFrame, item_kind: str, cached_kind: str, least: float) -> DataFrame:
    """Both sides of each region side by side, parts of the cache by chunks of the items, none larger than a group."""
    cell = ["dim", "tab", "region"]
    parts = lambda df, name: df.groupBy(*[F.col(c).alias(f"{name}_{c}") for c in cell]).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias(name))
    same = lambda name, other: functools.reduce(operator.and_, [F.col(f"{name}_{c}") == (F.col(f"{other}_{c}") if other else F.col(c)) for c in cell])
    sizes = checkpointed(parts(dealt, "parts").join(parts(asking, "chunks"), same("parts", "chunks")).drop(*[f"chunks_{c}" for c in cell]))
    own = lambda n: F.pmod(F.xxhash64("key", F.lit(n)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*cell, "key", "v", "buckets"]
    held = dealt.join(sizes, same("parts", "")).select(*columns, own("parts").alias("part"), every("chunks").alias("chunk"))
    come = asking.join(sizes, same("parts", "")).select(*columns, every("parts").alias("part"), own("chunks").alias("chunk"))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, cached, near, compared = [], [], [], 0
        if len(left) and len(right):
            queries, members = _rows(left.column("v").combine_chunks()), _rows(right.column("v").combine_chunks())
            names = right.column("key").to_pylist()
            bucket = right.column("buckets").combine_chunks().flatten().to_numpy()
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            lists = left.column("buckets").combine_chunks()
            probe, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(left)), pc.list_value_length(lists).to_numpy())
            best: dict[int, tuple[float, object]] = {}
            sort = np.argsort(probe, kind="stable")
            probe, row = probe[sort], row[sort]
            starts = np.flatnonzero(np.r_[True, probe[1:] != probe[:-1]])
            for lo, hi in zip(starts, np.r_[starts[1:], len(probe)], strict=True):
                a, b = np.searchsorted(bucket, probe[lo]), np.searchsorted(bucket, probe[lo], "right")
                if a == b:
                    continue
                some = order[a:b]
                for at in range(lo, hi, 512):
                    rows = row[at : min(hi, at + 512)]
                    product = queries[rows] @ members[some].T
                    compared += product.size
                    top = product.max(1)
                    for i in np.flatnonzero(top >= least - ROUNDING).tolist():
                        ties = some[np.flatnonzero(product[i] >= top[i] - 1e-12)].tolist()
                        found = (-round(float(top[i]), 12), min(names[t] for t in ties), float(top[i]))
                        best[int(rows[i])] = min(best.get(int(rows[i]), found), found)
            at = list(best)
            keys = left.column("key").take(pa.array(at, pa.int64())).to_pylist()
            cached, near = [best[i][1] for i in at], [best[i][2] for i in at]
        # one row more carries how many products the group took
        return pa.table(
            [
                pa.array([*keys, None], left.schema.field("key").type), pa.array([*cached, None], right.schema.field("key").type), pa.array([*near, None], pa.float64()),
                pa.array([0] * len(keys) + [compared], pa.int64()),
            ],
            ["key", "cached", "similarity", "compared"],
        )

    by = [*cell, "part", "chunk"]
    return come.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(match, f"key {item_kind}, cached {cached_kind}, similarity double, compared long")


def _best_of(pairs: DataFrame, least: float) -> DataFrame:
    order = F.struct(-F.round("similarity", 12), F.col("cached"))
    best = pairs.where(F.col("similarity") >= least).groupBy("key").agg(F.min_by(F.struct("cached", "similarity"), order).alias("best"))
    return best.select("key", "best.cached", "best.similarity")


def _exactly(sample: pa.Table, known: DataFrame, least: float) -> dict:
    """The best product of each sampled item in the whole cache, where it reaches ``least``."""
    asked = [(np.flatnonzero([len(x) == dim for x in sample.column("v").to_pylist()]), dim) for dim in {len(x) for x in sample.column("v").to_pylist()}]
    vectors = sample.column("v").to_pylist()
    by_dim = {dim: (rows, np.array([vectors[i] for i in rows])) for rows, dim in asked}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full(len(vectors), -np.inf)
        for batch in batches:
            for _, v in _by_length(batch):
                if v.shape[1] in by_dim:
                    rows, queries = by_dim[v.shape[1]]
                    best[rows] = np.maximum(best[rows], (queries @ v.T).max(1))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(best)), pa.int32()), pa.array(best)], ["at", "best"])

    found = known.mapInArrow(look, "at int, best double").groupBy("at").agg(F.max("best").alias("best")).where(F.col("best") >= least)
    keys = sample.column("key").to_pylist()
    return {keys[r["at"]]: r["best"] for r in found.collect()}


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def keep_newest(cache: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """The ``most`` newest entries: a limit is the feature, taken with a partial sort in every task."""
    return cache.orderBy(*order).limit(most)


def trim_oldest(cache: DataFrame, share: float, most: int, order: str, buckets: int = 1024, ranked: int = 100_000, nearest: bool = False) -> DataFrame:
    """Drop the oldest ``share`` of the entries (one at least) by a numeric ``order`` when there are more than ``most``.

    A share that is no whole number of entries is cut down to one, or goes to the nearest (halves up) if ``nearest``.

    Entries without an order (null or NaN) are the oldest. Of entries of equal order those with the smallest hash of their columns are dropped first. The entries are counted in
    buckets of equal width; the bucket with the cut is cut into buckets of its own until it holds ``ranked`` entries at most, which are ranked.
    """
    without = F.col(order).isNull() | F.isnan(F.col(order).cast("double"))
    size, unknown = cache.agg(F.count("*"), F.count_if(without)).first()
    if size <= most:
        return cache
    left = max(1, int((size * Decimal(str(share))).to_integral_value(ROUND_HALF_UP)) if nearest else int(size * share))
    if unknown > left:
        return cache.where(~without).union(_without_lowest(cache.where(without), None, left, buckets, ranked))
    return _without_lowest(cache.where(~without), order, left - unknown, buckets, ranked)


def _without_lowest(rows: DataFrame, order: str | None, left: int, buckets: int, ranked: int) -> DataFrame:
    """The rows but for the ``left`` lowest by a column, or by the hash of all columns."""
    if left <= 0:
        return rows
    name, columns = "__by", rows.columns
    hashed = F.xxhash64(*[F.col(c) for c in columns])
    cut = rows.withColumn(name, F.col(order) if order else hashed.cast("decimal(20,0)"))
    kept: list[DataFrame] = []
    while True:
        size, least, largest = cut.agg(F.count("*"), F.min(name), F.max(name)).first()
        if size <= left:
            return _all_of(kept, rows)
        width = (float(largest) - float(least)) / buckets
        if size <= ranked or width <= 0:
            break
        bucket = F.least(F.floor((F.col(name).cast("double") - float(least)) / width), F.lit(buckets - 1))
        counts = {r["b"]: r["n"] for r in cut.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}  # one row for each bucket
        at, gone = 0, 0
        while gone + counts.get(at, 0) <= left:
            gone += counts.get(at, 0)
            at += 1
        kept.append(cut.where(bucket > at))
        cut, left = cut.where(bucket == at), left - gone
    if size <= ranked:
        # few rows: a ranking of those alone
        place = F.row_number().over(Window.orderBy(name, hashed))
        kept.append(cut.withColumn("__place", place).where(F.col("__place") > left))
    elif order:
        kept.append(_without_lowest(cut.select(*columns), None, left, buckets, ranked))
    else:
        # rows of one hash are copies of one row: as many as are left of them
        kept.append(rows.sparkSession.range(size - left).withColumnRenamed("id", "__copy").join(F.broadcast(cut.limit(1))))
    return _all_of(kept, rows)


def _all_of(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0)
    for p in parts:
        out = out.union(p.select(*like.columns))
    return out
