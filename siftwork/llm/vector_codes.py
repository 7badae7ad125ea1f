"""Operator 12: product codes of vectors from integer codebooks, trained by Yinyang Lloyd rounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.common import checkpointed, removed, small_batches, table, written
from siftwork.llm.vectors import finite, matrix

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Entries that share one lower bound, about.
GROUP = 4
#: Integer components beyond this would not leave squared distances in 64 bits.
LARGEST = 2**24
#: Integers in the codebooks of all lengths together, and labels whose sums are broadcast, at most.
CODEBOOK_INTS, BROADCAST_LABELS = 2**24, 2**20
FAR = np.iinfo(np.int64).max


def edges(dim: int, parts: int) -> list[int]:
    """Where equal consecutive parts begin and end; a length that parts do not divide is cut as evenly as may be."""
    return [i * dim // parts for i in range(parts + 1)]


@dataclass
class Codebook:
    """The entries of each part position for vectors of one length, their groups, and how far each moved last."""

    entries: list[np.ndarray]
    groups: list[np.ndarray]
    drift: list[np.ndarray]

    @classmethod
    def start(cls, seeds: np.ndarray, parts: int) -> Codebook:
        at = edges(seeds.shape[1], parts)
        entries = [seeds[:, a:b].astype(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
        return cls(entries, [grouped(e) for e in entries], [np.zeros(len(seeds)) for _ in entries])

    def moved(self, counts: list[np.ndarray], sums: list[np.ndarray]) -> Codebook:
        """Each entry replaced by the floor of its parts' mean; an unused one stays."""
        entries = [np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], e) for n, s, e in zip(counts, sums, self.entries, strict=True)]
        drift = [np.nextafter(np.sqrt(((a - b) ** 2).sum(1).astype(np.float64)), np.inf) * (a != b).any(1) for a, b in zip(entries, self.entries, strict=True)]
        return Codebook(entries, self.groups, drift)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def grouped(entries: np.ndarray) -> np.ndarray:
    """The group of each entry: a few plain rounds of clustering over the first entries (any grouping gives right results)."""
    count = max(1, len(entries) // GROUP)
    centres = entries[np.linspace(0, len(entries) - 1, count).astype(int)].astype(np.float64)
    for _ in range(5):
        group = ((entries[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([entries[group == g].mean(0) if (group == g).any() else centres[g] for g in range(count)])
    return group


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x - entries) ** 2).sum(-1)


def assign(x: np.ndarray, entries: np.ndarray, group: np.ndarray, drift: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """One round for the parts ``x`` at one position. ``near`` (index of the nearest entry), ``upper`` (a bound of the
    distance to it) and ``lower`` (for each group, a bound of the distance to its other entries) change in place.
    Returns how many integer distances were computed.

    Bounds follow the drift of the entries and are rounded outwards. Where the upper bound is below all lower bounds
    the nearest entry can't have changed. Else it is measured; then the groups are scanned that the lower bound
    does not rule out. Squared distances are integers, so ties are seen and go to the lower index: an entry of
    a group that was not scanned is strictly farther.
    """
    count = lower.shape[1]
    group_drift = np.array([drift[group == g].max(initial=0.0) for g in range(count)])
    upper[:] = _above(upper + drift[near])
    lower[:] = _below(lower - group_drift)
    open_ = np.flatnonzero(upper >= lower.min(1))
    own = _squared(x[open_], entries[near[open_]])
    upper[open_] = _above(np.sqrt(own.astype(np.float64)))
    left = upper[open_] >= lower[open_].min(1)
    measured = len(open_)
    open_, own = open_[left], own[left]
    if not len(open_):
        return measured
    known = np.full((len(open_), len(entries)), FAR, np.int64)
    known[np.arange(len(open_)), near[open_]] = own
    scanned = lower[open_] <= upper[open_, None]
    for g in range(count):
        rows, members = np.flatnonzero(scanned[:, g]), np.flatnonzero(group == g)
        if len(rows) and len(members):
            known[np.ix_(rows, members)] = _squared(x[open_[rows], None, :], entries[None, members])
            measured += len(rows) * len(members)
    best = known.argmin(1)
    rows = np.arange(len(open_))
    near[open_] = best
    upper[open_] = _above(np.sqrt(known[rows, best].astype(np.float64)))
    known[rows, best] = FAR
    for g in range(count):
        others = known[:, group == g].min(1, initial=FAR)
        bound = np.where(others == FAR, np.inf, np.sqrt(others.astype(np.float64)))
        lower[open_, g] = _below(np.where(scanned[:, g], bound, np.minimum(bound, lower[open_, g])))
    return measured


def _sums(x: np.ndarray, near: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(near, minlength=size)
    sums = np.zeros((size, x.shape[1]), np.int64)
    np.add.at(sums, near, x)
    return counts, sums


def _narrow(ints: np.ndarray) -> np.ndarray:
    fits = np.abs(ints).max(initial=0) < 2**15
    return ints.astype(np.int16 if fits else np.int32)


@dataclass
class Block:
    """Vectors of one length with what the rounds know of them."""

    dim: int
    ids: pa.Array
    labels: pa.Array
    ints: np.ndarray
    near: np.ndarray
    upper: np.ndarray
    lower: list[np.ndarray]

    @classmethod
    def fresh(cls, ids: pa.Array, labels: pa.Array, ints: np.ndarray, book: Codebook) -> Block:
        """Bounds that rule out nothing."""
        n, parts = len(ints), len(book.entries)
        lower = [np.full((n, g.max(initial=0) + 1), -np.inf, np.float32) for g in book.groups]
        return cls(ints.shape[1], ids, labels, ints, np.zeros((parts, n), np.uint8), np.full((parts, n), np.inf, np.float32), lower)

    @classmethod
    def read(cls, row: dict, book: Codebook, ids: pa.Array, labels: pa.Array) -> Block:
        n, parts = len(ids), len(book.entries)
        width = [g.max(initial=0) + 1 for g in book.groups]
        flat = np.frombuffer(row["lower"], np.float32)
        cuts = np.cumsum([n * w for w in width])[:-1]
        return cls(
            row["dim"], ids, labels, np.frombuffer(row["ints"], f"i{len(row['ints']) // (n * row['dim'])}").reshape(n, -1).astype(np.int64),
            np.frombuffer(row["near"], np.uint8).reshape(parts, n).copy(), np.frombuffer(row["upper"], np.float32).reshape(parts, n).copy(),
            [x.reshape(n, -1).copy() for x in np.split(flat, cuts)],
        )

    def advance(self, book: Codebook) -> tuple[np.ndarray, np.ndarray, int]:
        """Assign all parts anew; the counts and sums of each entry's parts, and the distances that it took."""
        at = edges(self.dim, len(book.entries))
        counts, sums, measured = [], [], 0
        for p, entries in enumerate(book.entries):
            x = self.ints[:, at[p] : at[p + 1]]
            measured += assign(x, entries, book.groups[p], book.drift[p], self.near[p], self.upper[p], self.lower[p])
            n, s = _sums(x, self.near[p], len(entries))
            counts.append(n)
            sums.append(s.ravel())
        return np.concatenate(counts), np.concatenate(sums), measured

    def errors(self, book: Codebook) -> np.ndarray:
        at = edges(self.dim, len(book.entries))
        return sum(_squared(self.ints[:, at[p] : at[p + 1]], e[self.near[p]]) for p, e in enumerate(book.entries))


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _state(block: Block, totals: tuple[np.ndarray, np.ndarray, int]) -> pa.RecordBatch:
    counts, sums, measured = totals
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block.dim], pa.int32()), _listed(block.ids), _listed(block.labels), pa.array([_narrow(block.ints).tobytes()], pa.binary()),
            pa.array([block.near.tobytes()], pa.binary()), pa.array([block.upper.tobytes()], pa.binary()),
            pa.array([b"".join(x.tobytes() for x in block.lower)], pa.binary()),
            pa.array([np.concatenate([counts, sums]).tolist()], pa.list_(pa.int64())), pa.array([measured], pa.int64()),
        ],
        ["dim", "ids", "labels", "ints", "near", "upper", "lower", "totals", "measured"],
    )


def _blocks(batch: pa.RecordBatch, books: dict[int, Codebook]) -> Iterator[Block]:
    for i, row in enumerate(batch.select(["dim", "ints", "near", "upper", "lower"]).to_pylist()):
        yield Block.read(row, books[row["dim"]], batch.column("ids")[i].values, batch.column("labels")[i].values)


def _next(state: DataFrame, books: dict[int, Codebook]) -> dict[int, Codebook]:
    """The codebooks after a round, from the blocks' counts and sums: as many rows as there are integers in the codebooks."""
    totals = state.select("dim", F.posexplode("totals").alias("at", "x")).groupBy("dim", "at").agg(F.sum("x").alias("x")).toArrow()
    found = {dim: np.zeros(sum(len(e) + e.size for e in b.entries), np.int64) for dim, b in books.items()}
    dims, at, x = (totals.column(c).to_numpy() for c in ("dim", "at", "x"))
    for dim, flat in found.items():
        flat[at[dims == dim]] = x[dims == dim]
    out = {}
    for dim, book in books.items():
        k = len(book.entries[0])
        counts, sums = found[dim][: k * len(book.entries)].reshape(-1, k), found[dim][k * len(book.entries) :]
        cuts = np.cumsum([e.size for e in book.entries])[:-1]
        out[dim] = book.moved(list(counts), [s.reshape(k, -1) for s in np.split(sums, cuts)])
    return out


def encode_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", costs: list[int] | None = None,
) -> DataFrame:
    """Codes of all vectors by codebooks that are trained on all vectors, in integers.

    A component x counts as floor(scale x); a vector is cut into ``parts`` consecutive parts. The codebook of a part
    position starts as that part of the ``entries`` smallest ids, and in each of ``rounds`` rounds every
    part goes to its nearest entry (ties to the lower index) and every entry to the floor of its parts' mean; an
    unused entry stays. Then parts are assigned once more.

    The rounds are Yinyang's: entries are put into groups once, each vector keeps one lower bound for each group and one upper
    bound, and only groups whose bound fails after the entries' drift are scanned (``assign``). Vectors stay in the blocks that the first
    read put them in, beside their bounds; a round reads the blocks of the one before, writes its own, and
    only counts and sums of the entries are shuffled. Blocks of a round are deleted once the next has been written.
    ``costs``, if given, receives the number of distances that each pass computed.

    Returns one row per vector that counts: id, ``label``, ``code`` (two hex digits a part), ``error``,
    ``label_error`` (sum over rows of equal label, nulls together) and ``codebooks_sha256``. Vectors that are null or empty, hold null or
    non-finite components, or a component beyond 2^24 in integers (their squared distances would not fit 64 bits) take no
    part. Vectors of different lengths have codebooks of their own, trained side by side; a length that ``parts`` does not divide is cut as evenly as may be. Repeated ids
    are vectors of their own, in order of their components; null ids come last. An empty table gives an empty result; other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index takes two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    small_batches(spark)
    kept = vectors.where(finite(F.col(vector_col))).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    ).where(~F.exists("v", lambda x: F.abs(F.floor(x * scale)) > LARGEST))
    id_kind, label_kind = (kept.schema[c].dataType.simpleString() for c in ("id", "label"))
    lengths = kept.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    count = lengths.agg(F.sum(F.col("dim").cast("long") * entries)).first()[0] or 0
    if count > CODEBOOK_INTS:
        raise ValueError(f"the vectors have so many lengths that codebooks would hold {count} integers")
    first = Window.partitionBy(F.size("v")).orderBy(F.asc_nulls_last("id"), "v")
    seeds = kept.withColumn("at", F.row_number().over(first)).where(F.col("at") <= entries).select("at", "v").orderBy("at").toArrow()
    by_dim: dict[int, list] = {}
    for v in seeds.column("v").to_pylist():
        by_dim.setdefault(len(v), []).append(v)
    books = {dim: Codebook.start(np.floor(np.array(v) * scale), parts) for dim, v in by_dim.items()}

    def begin(books: dict[int, Codebook]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
                for dim in np.unique(dims).tolist():
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    ints = np.floor(matrix(part.column("v")) * scale).astype(np.int64)
                    block = Block.fresh(part.column("id"), part.column("label"), ints, books[dim])
                    yield _state(block, block.advance(books[dim]))

        return run

    def again(books: dict[int, Codebook]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in _blocks(batch, books):
                    yield _state(block, block.advance(books[block.dim]))

        return run

    def last(books: dict[int, Codebook]):
        digests = {dim: b.digest() for dim, b in books.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in _blocks(batch, books):
                    _, _, measured = block.advance(books[block.dim])
                    digits, n = block.near.T.tobytes().hex(), len(block.ids)
                    width = 2 * len(block.near)
                    yield pa.RecordBatch.from_arrays(
                        [
                            block.ids, block.labels, pa.array([digits[i * width : (i + 1) * width] for i in range(n)]), pa.array(block.errors(books[block.dim])),
                            pa.array([digests[block.dim]] * n), pa.array([measured] + [0] * (n - 1), pa.int64()),
                        ],
                        ["id", "label", "code", "error", "codebooks_sha256", "measured"],
                    )

        return run

    schema = f"dim int, ids array<{id_kind}>, labels array<{label_kind}>, ints binary, near binary, upper binary, lower binary, totals array<bigint>, measured bigint"
    state = written(kept.mapInArrow(begin(books), schema))
    for k in range(rounds):
        if costs is not None:
            costs.append(state.agg(F.sum("measured")).first()[0] or 0)
        books = _next(state, books)
        if k + 1 < rounds:
            state, old = written(state.mapInArrow(again(books), schema)), state
            removed(old)
    coded = written(state.mapInArrow(last(books), f"id {id_kind}, label {label_kind}, code string, error bigint, codebooks_sha256 string, measured bigint"))
    if costs is not None:
        costs.append(coded.agg(F.sum("measured")).first()[0] or 0)
    removed(state)
    sums = checkpointed(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    beside = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return coded.join(beside, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", "codebooks_sha256"
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(table(spark, sf_dir, "embeddings")).drop("label")


def _op12_sql() -> str:
    """The rounds one after another; the vectors of a table have one length."""
    nearest = """
near{k} as materialized (
  select vec_id, label, nth, part, x, arg_min(entry, [d, entry]) as entry, min(d) as d
  from (select p.vec_id, p.label, p.nth, p.part, p.x, b.entry,
               cast(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) as bigint) as d
        from parts p join book{k} b on p.part = b.part)
  group by vec_id, label, nth, part, x
)"""
    moved = """
book{n} as materialized (
  select b.part, b.entry, coalesce(m.x, b.x) as x
  from book{k} b left join (
    select part, entry, list(cast(floor(s / c) as bigint) order by i) as x from (
      select part, entry, i, sum(x[i]) as s, count(*) as c from near{k}, range(1, 65536) r(i) where i <= len(x) group by part, entry, i
    ) group by part, entry
  ) m on b.part = m.part and b.entry = m.entry
)"""
    steps = [nearest.format(k=0)]
    for k in range(ROUNDS):
        steps += [moved.format(k=k, n=k + 1), nearest.format(k=k + 1)]
    return f"""
with kept as (
  select vec_id, label, row_number() over (order by vec_id nulls last, embedding) as nth,
         list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
  select vec_id, label, nth, part, list_slice(v, 1 + (part * len(v)) // {PARTS}, ((part + 1) * len(v)) // {PARTS}) as x
  from kept, range({PARTS}) r(part)
), book0 as materialized (select part, nth - 1 as entry, x from parts where nth <= {ENTRIES}),
{",".join(steps)}, coded as (
  select vec_id, label, nth, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error
  from near{ROUNDS} group by vec_id, label, nth
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) from book{ROUNDS}) as codebooks_sha256
from coded
"""


OP12_SQL = _op12_sql()
