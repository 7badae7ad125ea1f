"""Operator 5: exact top-k by inner product with a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.common import checkpointed, table
from siftwork.llm.vectors import finite

SCALE = 256
#: A vector's components are dealt to so many lists; each list scores a vector by its own components.
LISTS = 4
#: Queries and candidates meet in blocks of about so many rows, fewer where their integers would take over so many bytes.
QUERY_BLOCK = 16_384
ROW_BLOCK = 4096
BLOCK_BYTES = 8 << 20
#: Queries of a block that are multiplied at once.
QUERY_SLICE = 512
#: Blocks of rows that meet one copy of a block of queries: together about as large as that copy.
SPREAD = 4
#: Once so few of a block's entries are left, their scores are resolved one by one.
SPARSE = 0.1


def _blocks(rows: DataFrame, name: str, most: int) -> DataFrame:
    """Rows packed into blocks: (``name``, dim, ids, values). A block holds vectors of one length."""
    size = rows.groupBy("dim").agg(F.count("*").alias("n"))
    count = size.select(F.col("dim").alias("of_dim"), F.ceil(F.col("n") / F.expr(f"greatest(1, least({most}, {BLOCK_BYTES} div (8 * dim)))")).cast("int").alias("n_blocks"))
    dealt = rows.join(F.broadcast(count), F.col("dim") == F.col("of_dim")).select(
        "dim", F.pmod(F.xxhash64("id", F.lit(name)), F.col("n_blocks")).cast("int").alias(name), "id", "ints"
    )

    def pack(key: tuple, data: pa.Table) -> pa.Table:
        order = np.argsort(data.column("id").to_numpy(), kind="stable")
        ids = data.column("id").to_numpy()[order].astype(np.int64)
        ints = data.column("ints").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), name: pa.array([key[1].as_py()], pa.int32()),
            f"{name}_ids": pa.array([ids.tobytes()], pa.binary()), f"{name}_ints": pa.array([_narrow(ints).tobytes()], pa.binary()),
        })

    schema = f"dim int, {name} int, {name}_ids binary, {name}_ints binary"
    return dealt.groupBy("dim", name).applyInArrow(pack, schema)


def _narrow(ints: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes."""
    return ints.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= ints.min(initial=0) and ints.max(initial=0) <= np.iinfo(t).max))


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of the batches, of which one is unpacked at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _slices(dim: int) -> list[slice]:
    edges = np.linspace(0, dim, min(LISTS, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every sum fits 53 bits, in integers beyond."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k highest scores, ties to the smaller id, best first."""
    k = min(k, score.shape[1])
    low = np.iinfo(np.int64).min
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    row, col = np.nonzero((score >= kth[:, None]) & (score > low))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.full((len(score), k), -1, np.int64)
    out[row[place < k], place[place < k]] = col[place < k]
    return out


def _unpack(ids: bytes, ints: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(ints, f"i{len(ints) // (len(ids) * dim)}").reshape(-1, dim).astype(np.int64)


def gather(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Phase 1 in one block: for each query the rows that some list scores among its k highest, with their sums (the k
    best of them are enough), and the k-th highest score of each list: no other row scores more there."""
    low = np.iinfo(np.int64).min
    lists = [np.where(q_ids[:, None] == c_ids[None, :], low, _product(q[:, s], c[:, s])) for s in _slices(q.shape[1])]
    seen = np.zeros(lists[0].shape, bool)
    tops = np.full((len(q), len(lists)), low)
    rows = np.arange(len(q))
    for j, one in enumerate(lists):
        best = _best(one, c_ids, k)
        for col in best.T:
            seen[rows[col >= 0], col[col >= 0]] = True
        if best.shape[1] == k:
            tops[:, j] = np.where(best[:, -1] >= 0, one[rows, best[:, -1]], low)
    total = np.where(seen, sum(np.where(x == low, 0, x) for x in lists), low)
    best = _best(total, c_ids, k)
    found = [b[b >= 0] for b in best]
    return found, np.where(best >= 0, total[rows[:, None], best], low), tops


def resolve(
    q: np.ndarray, c: np.ndarray, cutoff: np.ndarray, tops: np.ndarray, taken: list[list[int]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3 in one block: (query, row, score) of all rows that reach the query's cutoff, but for those
    ``taken`` in phase 1, and how many products of phase 3 it took. No other row scores more than ``tops`` in a list.

    List by list the rows are dropped whose known scores and the tops of the lists left do not reach the cutoff.
    Lists are multiplied whole while many rows are left, then entry by entry.
    """
    slices = _slices(q.shape[1])
    left = tops.sum(1)[:, None] - np.cumsum(tops, 1)
    known = _product(q[:, slices[0]], c[:, slices[0]])
    at = 1
    open_ = known + left[:, 0, None] >= cutoff[:, None]
    for i, some in enumerate(taken):
        open_[i, some] = False
    while at < len(slices) and open_.mean() > SPARSE:
        known += _product(q[:, slices[at]], c[:, slices[at]])
        open_ &= known + left[:, at, None] >= cutoff[:, None]
        at += 1
    row, col = np.nonzero(open_)
    score, products = known[row, col], 0
    for j in range(at, len(slices)):
        products += len(row)
        for lo in range(0, len(row), 100_000):
            part = slice(lo, lo + 100_000)
            score[part] += np.einsum("ij,ij->i", q[row[part], slices[j]], c[col[part], slices[j]])
        keep = score + left[row, j] >= cutoff[row]
        row, col, score = row[keep], col[keep], score[keep]
    return row, col, score, products


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` rows with the highest integer inner product for each query, exactly.

    A component x counts as floor(SCALE x). Queries are the rows whose id is divisible by ``every``;
    candidates are all rows with another id. Rows are packed into blocks; a query block meets every
    candidate block, which is the set of queries against all rows and never all pairs of rows. The
    components are dealt to ``LISTS`` lists, so a row's score is the sum of its list scores.

    1. Every block gathers, from each list, the k rows that the list scores highest, with their sums. The
       k-th highest sum of a query over all blocks is a safe cutoff: no row below it is in the answer.
    2. The cutoff is joined to the blocks' reports. A row that was not gathered scores at most the k-th
       highest of its block in each list. Where these together miss the cutoff (or none reaches the uniform share,
       the cutoff divided by the number of lists), the block has nothing more for the query. The others are
       opened: rows are collected list by list while what they scored and may still score reaches the cutoff.
    3. The remaining scores of the collected entries are resolved one by one.

    Returns ``query_id``, ``rank`` (from 1), id, ``score``; ties go to the smaller id. A repeated id is
    a candidate for each of its rows, and the entries of all rows of a repeated query are ranked together.
    A query with fewer than k candidates gets them all. Vectors that are null
    or empty or hold null or non-finite components take no part; vectors of different lengths do not meet.
    Rows with a null id take no part. An empty table gives an empty result; other columns are ignored.
    """
    ints = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = vectors.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), ints.alias("ints")
    )
    packed = checkpointed(_blocks(rows, "c", ROW_BLOCK))
    asked = checkpointed(_blocks(rows.where(F.col("id") % every == 0), "q", QUERY_BLOCK))
    copies = _copies(packed, asked)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _one_by_one(batches):
            all_ids, all_q = _unpack(r["q_ids"], r["q_ints"], r["dim"])
            c_ids, c = _unpack(r["c_ids"], r["c_ints"], r["dim"])
            for lo in range(0, len(all_ids), QUERY_SLICE):
                q_ids, q = all_ids[lo : lo + QUERY_SLICE], all_q[lo : lo + QUERY_SLICE]
                found, totals, tops = gather(q_ids, q, c_ids, c, k)
                n = len(q_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, r["dim"], np.int32)), pa.array(np.full(n, r["c"], np.int32)), pa.array(np.full(n, r["q"], np.int32)),
                        pa.array(range(lo, lo + n), pa.int32()), pa.array(q_ids), pa.array([f.tolist() for f in found], pa.list_(pa.int32())),
                        pa.array([c_ids[f].tolist() for f in found], pa.list_(pa.int64())),
                        pa.array([t[: len(f)].tolist() for f, t in zip(found, totals, strict=True)], pa.list_(pa.int64())),
                        pa.array(tops.tolist(), pa.list_(pa.int64())),
                    ],
                    ["dim", "c", "q", "row", "query_id", "taken", "ids", "scores", "tops"],
                )

    report = checkpointed(
        _met(packed, asked, copies).mapInArrow(first, "dim int, c int, q int, row int, query_id long, taken array<int>, ids array<long>, scores array<long>, tops array<long>")
    )
    order = Window.partitionBy("dim", "q", "row").orderBy(F.desc("score"))
    kth = report.select("dim", "q", "row", F.explode("scores").alias("score")).withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select(
        F.col("dim").alias("t_dim"), F.col("q").alias("t_q"), F.col("row").alias("t_row"), F.col("score").alias("cutoff")
    )
    reported = report.join(kth, (F.col("dim") == F.col("t_dim")) & (F.col("q") == F.col("t_q")) & (F.col("row") == F.col("t_row")), "left")
    # a block in which no list has a k-th row was gathered whole
    low = F.lit(np.iinfo(np.int64).min)
    partly = F.array_min("tops") > low
    together = F.aggregate("tops", F.lit(0).cast("long"), lambda s, x: s + x)
    share = F.ceil(F.col("cutoff") / F.size("tops"))
    more = reported.where(partly & F.col("cutoff").isNotNull() & (together >= F.col("cutoff")) & F.exists("tops", lambda x: x >= share))
    # the open queries of a block of queries with a block of rows: at most as many as the first holds
    opened = more.groupBy("dim", "c", "q").agg(F.collect_list(F.struct("row", "cutoff", "tops", "taken")).alias("open")).withColumnsRenamed(
        {"dim": "o_dim", "c": "o_c", "q": "o_q"}
    )
    with_rows = opened.join(packed, (F.col("o_dim") == F.col("dim")) & (F.col("o_c") == F.col("c"))).drop("o_dim", "o_c")
    pairs = _beside(with_rows, "o_q", copies).select("dim", "q_ids", "q_ints", "c_ids", "c_ints", "open")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _one_by_one(batches):
            q_ids, q = _unpack(r["q_ids"], r["q_ints"], r["dim"])
            c_ids, c = _unpack(r["c_ids"], r["c_ints"], r["dim"])
            for lo in range(0, len(r["open"]), QUERY_SLICE):
                part = r["open"][lo : lo + QUERY_SLICE]
                some = np.array([x["row"] for x in part])
                cutoff, tops = np.array([x["cutoff"] for x in part]), np.array([x["tops"] for x in part])
                row, col, score, _ = resolve(q[some], c, cutoff, tops, [x["taken"] for x in part])
                other = q_ids[some[row]] != c_ids[col]
                row, col, score = row[other], col[other], score[other]
                # the k best of the block are enough
                best = np.lexsort((c_ids[col], -score, row))
                row, col, score = row[best], col[best], score[best]
                top = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[some[row[top]]]), pa.array(c_ids[col[top]]), pa.array(score[top])], ["query_id", "id", "score"])

    resolved = pairs.mapInArrow(rest, "query_id long, id long, score long")
    entries = report.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("e"))
    gathered = entries.select("query_id", F.col("e.ids").alias("id"), F.col("e.scores").alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = gathered.union(resolved).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _copies(packed: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of queries, once for each run of ``SPREAD`` blocks of rows, so no task gets all rows for one block of queries."""
    runs = packed.groupBy("dim").agg(F.max(F.expr(f"c div {SPREAD}")).alias("runs")).withColumnRenamed("dim", "of_dim")
    # one row for each length of vectors
    return asked.join(F.broadcast(runs), F.col("dim") == F.col("of_dim")).select(
        F.col("dim").alias("q_dim"), "q", "q_ids", "q_ints", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs").cast("long"))).alias("run")
    )


def _met(packed: DataFrame, asked: DataFrame, copies: DataFrame) -> DataFrame:
    """Every block of queries beside every block of rows of its length."""
    n_asked = asked.groupBy("dim").agg(F.max("q").alias("last")).withColumnRenamed("dim", "of_dim")
    grid = packed.join(F.broadcast(n_asked), F.col("dim") == F.col("of_dim")).select(
        "dim", "c", "c_ids", "c_ints", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("at")
    )
    return _beside(grid, "at", copies).select("dim", "c", "c_ids", "c_ints", "q", "q_ids", "q_ints")


def _beside(rows: DataFrame, at: str, copies: DataFrame) -> DataFrame:
    """Blocks of rows with the block of queries that column ``at`` names. Blocks are few and much work, so a number of partitions keeps them apart."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = rows.withColumn("of_run", F.expr(f"c div {SPREAD}")).repartition(parts, "dim", at, "of_run")
    right = copies.repartition(parts, "q_dim", "q", "run")
    return left.join(right, (F.col("dim") == F.col("q_dim")) & (F.col(at) == F.col("q")) & (F.col("of_run") == F.col("run")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as ints
  from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(range(1, len(q.ints) + 1), lambda i: q.ints[i] * c.ints[i])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.ints) = len(c.ints)
)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 5
"""
