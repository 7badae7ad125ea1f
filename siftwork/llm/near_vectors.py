"""Operator 4: near-duplicate vectors by range search in a robust-pruned flat graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.common import checkpointed, sortable, table, unsorted
from siftwork.llm.components import connected_components
from siftwork.llm.vectors import finite, matrix

#: Vectors of a label that one shard is meant to hold; the pivots are sampled at this rate.
SHARD = 1000
#: Pivots in all, so what every task gets is bounded (16,384 vectors).
PIVOTS = 16_384
#: A larger shard is cut into parts of at most about so many vectors.
PART = 4096
#: Shards that a vector belongs to.
OVERLAP = 3
CANDIDATES = 48
DEGREE = 20
ALPHA = 1.2
GREEDY_STEPS = 12
#: The range search walks through vectors this far below the threshold.
SLACK = 0.02
#: Vectors that the first audit asks; it asks four times as many while they have fewer than ``AUDITED_LINKS``.
AUDITED = 256
AUDITED_LINKS = 1000
AUDITED_MOST = 16_384
#: Bytes of vectors that are taken to the driver and broadcast as pivots, and as an audit's sample.
SAMPLE_BYTES = 64 << 20
RECALL = 0.9
#: Either links of ``rep`` within a group; or a node ``root`` that it is connected with; or a pair, which may repeat,
#: of ``rep`` and the larger ``pair``, with the links that it gives each.
LINK_COLUMNS = "rep {0}, n_links long, root {0}, pair {0}, pair_links long"
#: Overlap beyond which shards are given up and all vectors of a label are compared.
OVERLAP_MOST = 24


def robust_graph(vectors: np.ndarray) -> np.ndarray:
    """Neighbours of each vector, -1 where it has fewer; edges go both ways where there is room.

    From its nearest candidates a vector takes the nearest, drops those that lie closer to the one taken
    than 1/ALPHA of their own distance, and goes on until DEGREE are taken.
    """
    n = len(vectors)
    graph = np.full((n, 2 * DEGREE), -1, np.int32)
    if n < 2:
        return graph
    most = min(CANDIDATES, n - 1)
    for lo in range(0, n, 256):
        own = np.arange(lo, min(n, lo + 256))
        near = vectors[own] @ vectors.T
        near[np.arange(len(own)), own] = -np.inf
        cand = np.argpartition(-near, most - 1, axis=1)[:, :most]
        score = np.take_along_axis(near, cand, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
        among = np.matmul(vectors[cand], vectors[cand].transpose(0, 2, 1))
        far, between = 1 - score, 1 - among
        open_ = np.ones(cand.shape, bool)
        rows = np.arange(len(own))
        for k in range(DEGREE):
            some = open_.any(1)
            if not some.any():
                break
            best = open_.argmax(1)
            graph[own[some], k] = cand[rows, best][some]
            open_[rows, best] = False
            # squared distances of unit vectors are twice these, so ALPHA counts squared
            open_ &= ALPHA**2 * between[rows, best] > far
    back = [[] for _ in range(n)]
    for i in range(n):
        for j in graph[i, :DEGREE]:
            if j < 0:
                break
            if len(back[j]) < DEGREE:
                back[j].append(i)
    for j, own in enumerate(back):
        graph[j, DEGREE : DEGREE + len(own)] = own
    return graph


def range_search(
    vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) with inner product of at least ``least`` that the search reaches.

    Greedy steps start at the medoid and at the query's own node where the part holds it. Then the range
    expands: every node reached within ``SLACK`` of the range is opened until none is left.
    """
    n, found_q, found_v = len(vectors), [], []
    medoid = int((vectors @ vectors.mean(0)).argmax())
    for lo in range(0, len(queries), 256):
        block, at = queries[lo : lo + 256], own[lo : lo + 256]
        m = len(block)
        rows = np.arange(m)
        score = np.full((m, n), -np.inf)
        opened = np.zeros((m, n), bool)

        def visit(q: np.ndarray, v: np.ndarray) -> None:
            new = (v >= 0) & (score[q, np.maximum(v, 0)] == -np.inf)
            keys = np.unique(q[new].astype(np.int64) * n + v[new])
            for k in range(0, len(keys), 200_000):
                a, b = keys[k : k + 200_000] // n, keys[k : k + 200_000] % n
                score[a, b] = np.einsum("ij,ij->i", block[a], vectors[b])

        visit(rows, np.full(m, medoid))
        visit(rows, at)
        for _ in range(GREEDY_STEPS):
            best = np.where(opened, -np.inf, score).argmax(1)
            opened[rows, best] = True
            near = graph[best]
            visit(np.repeat(rows, near.shape[1]), near.ravel())
        while True:
            q, v = np.nonzero((score >= least - SLACK) & ~opened)
            if not len(q):
                break
            opened[q, v] = True
            for k in range(0, len(q), 50_000):
                near = graph[v[k : k + 50_000]]
                visit(np.repeat(q[k : k + 50_000], near.shape[1]), near.ravel())
        q, v = np.nonzero(score >= least)
        found_q.append(q + lo)
        found_v.append(v)
    if not found_q:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_v)


def all_pairs(vectors: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (query, member) with inner product of at least ``least``, compared in blocks."""
    found_q, found_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo in range(0, len(queries), 256):
        q, v = np.nonzero(queries[lo : lo + 256] @ vectors.T >= least)
        found_q.append(q + lo)
        found_v.append(v)
    return np.concatenate(found_q), np.concatenate(found_v)


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes a node that the edges (a, b) connect it with, the same for all of a part."""
    part = np.arange(n)
    while len(a):
        before = part.copy()
        low = np.minimum(part[a], part[b])
        np.minimum.at(part, a, low)
        np.minimum.at(part, b, low)
        part = part[part]
        if (part == before).all():
            break
    return part


def _unit(column) -> np.ndarray:
    x = matrix(column)
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _choose_pivots(classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """A bounded sample of the distinct vectors, by a hash of their ids, for each label and length."""
    width = F.size("embedding").cast("long") * 8
    total, size = classes.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    rate = min(1.0 / SHARD, PIVOTS / 2 / max(1, total), SAMPLE_BYTES / 2 / max(1, size))
    dice = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1_000_000_007)) / 1_000_000_007
    # no vector weighs much of the bound, so the sample stays near half of it; spaces without pivots are one shard
    sample = classes.where((dice < rate) & (width <= SAMPLE_BYTES // 256)).select("space", "embedding").limit(PIVOTS).toArrow()
    pivots: dict[tuple[str, int], list] = {}
    spaces = sample.column("space").to_pylist()
    for i, space in enumerate(spaces):
        pivots.setdefault(space, []).append(i)
    column = sample.column("embedding").combine_chunks()
    return {space: _unit(column.take(pa.array(rows))) for space, rows in pivots.items()}


def _assign(classes: DataFrame, pivots, overlap: int) -> DataFrame:
    """Rows (space, cell, primary, rep, weight, embedding): the ``overlap`` nearest pivots of each vector."""
    rep_type = classes.schema["rep"].dataType.simpleString()
    vector_type = classes.schema["embedding"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots.value
        for batch in batches:
            spaces = np.array(batch.column("space").to_pylist(), object)
            for space in dict.fromkeys(spaces.tolist()):
                rows = np.flatnonzero(spaces == space)
                part = batch.take(pa.array(rows))
                centres = known.get(space)
                if centres is None:
                    cells = np.zeros((len(rows), 1), np.int64)
                else:
                    near = _unit(part.column("embedding")) @ centres.T
                    cells = np.argsort(-near, axis=1, kind="stable")[:, :overlap]
                for k in range(cells.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("space"),
                            pa.array(cells[:, k].astype(np.int32)),
                            pa.array(np.full(len(rows), k == 0)),
                            part.column("rep"),
                            part.column("weight"),
                            part.column("embedding"),
                        ],
                        ["space", "cell", "primary", "rep", "weight", "embedding"],
                    )

    return classes.select("space", "rep", "weight", "embedding").mapInArrow(
        assign, f"space string, cell int, primary boolean, rep {rep_type}, weight long, embedding {vector_type}"
    )


def _links(classes: DataFrame, pivots, overlap: int, least: float) -> DataFrame:
    """Rows (rep, n_links, root, pair, pair_links), see ``LINK_COLUMNS``, from the shards of the nearest pivots.

    Vectors of one primary shard meet in one group, which credits both ends of their pairs. A pair of two
    primary shards may be found from one end or from both, so it is a row of its own.
    """
    rep_type = classes.schema["rep"].dataType.simpleString()
    shards = checkpointed(_assign(classes, pivots, overlap))
    parts = shards.groupBy("space", "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("n_parts"))
    placed = (
        shards.join(parts.withColumnsRenamed({"space": "of_space", "cell": "of_cell"}),
                    (F.col("space") == F.col("of_space")) & (F.col("cell") == F.col("of_cell")))
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("n_parts")).cast("int"))
        .drop("of_space", "of_cell")
    )

    def build(key: tuple, data: pa.Table) -> pa.Table:
        graph = robust_graph(_unit(data.column("embedding")))
        reps = data.column("rep").combine_chunks()
        counts = (graph >= 0).sum(1)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        near = reps.take(pa.array(graph[graph >= 0]))
        return pa.table({"node": reps, "near": pa.ListArray.from_arrays(ends, near)})

    keys = ["space", "cell", "part"]
    lists = placed.groupBy(*keys).applyInArrow(build, f"node {rep_type}, near array<{rep_type}>")
    # a vector's lists from all its shards make one
    graph = checkpointed(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    members = placed.join(graph, F.col("rep") == F.col("node")).select(
        *keys, "n_parts", "primary", "rep", "weight", "embedding", "near"
    )
    # a group holds the members of a part and the vectors that ask them from one part (home), their own or another
    keys = [*keys, "home"]
    no_list = F.expr(f"cast(array() as array<{rep_type}>)")
    every = F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))
    own = members.withColumn("home", every).select(
        *keys, "primary", F.lit(True).alias("member"), "rep", "weight", "embedding", F.when(F.col("home") == F.col("part"), F.col("near")).otherwise(no_list).alias("near")
    )
    others = (
        members.where("primary and n_parts > 1")
        .withColumn("other", every)
        .where("other <> part")
        .select(
            "space", "cell", F.col("other").alias("part"), F.col("part").alias("home"), "primary", F.lit(False).alias("member"),
            "rep", "weight", "embedding", no_list.alias("near"),
        )
    )

    def search(key: tuple, data: pa.Table) -> pa.Table:
        empty = _link_rows(data.column("rep").type)
        is_member = data.column("member").to_numpy(zero_copy_only=False)
        if not is_member.any():
            return empty
        held = data.filter(pa.array(is_member))
        reps = held.column("rep").combine_chunks()
        place = {r: i for i, r in enumerate(reps.to_pylist())}
        lists = [[place[x] for x in near if x in place] for near in held.column("near").to_pylist()]
        graph = np.full((len(lists), max(1, max(map(len, lists)))), -1, np.int32)
        for i, near in enumerate(lists):
            graph[i, : len(near)] = near
        at_home_here = key[3].as_py() == key[2].as_py()
        asks = data.filter(data.column("primary")) if at_home_here else data.filter(pa.array(~is_member))
        if not len(asks):
            return empty
        asking = asks.column("rep").to_pylist()
        own_node = np.array([place.get(r, -1) for r in asking])
        vectors, queries = _unit(held.column("embedding")), _unit(asks.column("embedding"))
        # a vector of another part has no node to enter at, so it is compared with all members
        at_home, abroad = np.flatnonzero(own_node >= 0), np.flatnonzero(own_node < 0)
        q, v = range_search(vectors, graph, queries[at_home], own_node[at_home], least)
        far_q, far_v = all_pairs(vectors, queries[abroad], least)
        q, v = np.concatenate([at_home[q], abroad[far_q]]), np.concatenate([v, far_v])
        other = own_node[q] != v
        q, v = q[other], v[other]
        # parts of what is connected here: a query stands at its node, or at a node of its own
        nodes = np.where(own_node >= 0, own_node, len(lists) + np.arange(len(asking)))
        n = len(lists) + len(asking)
        ids = reps.to_pylist() + asking
        weight = np.concatenate([held.column("weight").to_numpy(), asks.column("weight").to_numpy()])
        a, b = nodes[q], v
        part = _components(n, a, b)
        tied = np.flatnonzero(part != np.arange(n))
        # pairs of one primary shard: once here, and of two parts only where the lower one asks
        both = held.column("primary").to_numpy(zero_copy_only=False)[v]
        lower = (own_node[q] >= 0) | (key[3].as_py() < key[2].as_py())
        inner = np.unique(np.minimum(a, b)[both & lower] * n + np.maximum(a, b)[both & lower])
        low, high = inner // n, inner % n
        counts = (np.bincount(low, weight[high], n) + np.bincount(high, weight[low], n)).astype(np.int64)
        return _link_rows(
            reps.type,
            [(ids[i], counts[i]) for i in np.flatnonzero(counts)],
            [(ids[i], ids[part[i]]) for i in tied],
            [
                (ids[i], weight[j], ids[j], weight[i]) if ids[i] < ids[j] else (ids[j], weight[i], ids[i], weight[j])
                for i, j in zip(a[~both].tolist(), b[~both].tolist(), strict=True)
            ],
        )

    return own.union(others).groupBy(*keys).applyInArrow(search, LINK_COLUMNS.format(rep_type))


def _link_rows(kind: pa.DataType, links: list[tuple] = (), tied: list[tuple] = (), pairs: list[tuple] = ()) -> pa.Table:
    """The rows of ``LINK_COLUMNS``: (rep, links), (rep, root) and (rep, links, pair, links)."""
    rows = [(r, n, None, None, None) for r, n in links] + [(r, 0, t, None, None) for r, t in tied]
    rows += [(r, n, None, p, m) for r, n, p, m in pairs]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [kind, pa.int64(), kind, kind, pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rep", "n_links", "root", "pair", "pair_links"])


def _counted(found: DataFrame) -> DataFrame:
    """(rep, n_links): links within groups, and of each pair of two primary shards once, at both ends."""
    pairs = found.where("pair is not null").groupBy("rep", "pair").agg(F.max("n_links").alias("n"), F.max("pair_links").alias("m"))
    ends = pairs.select(F.explode(F.array(F.struct("rep", "n"), F.struct(F.col("pair").alias("rep"), F.col("m").alias("n")))).alias("end"))
    return (
        found.where("pair is null").select("rep", "n_links")
        .union(ends.select("end.rep", "end.n"))
        .groupBy("rep")
        .agg(F.sum("n_links").alias("n_links"))
    )


def _exact_links(classes: DataFrame, least: float) -> DataFrame:
    """As ``_links``, from all pairs of a space: its vectors are cut into blocks, and each pair of blocks meets in one group."""
    rep_type = classes.schema["rep"].dataType.simpleString()
    sizes = classes.groupBy(F.col("space").alias("of_space")).agg(F.ceil(F.count("*") / PART).cast("int").alias("n_blocks"))
    placed = classes.join(sizes, F.col("space") == F.col("of_space")).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")
    )
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "space",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        (F.col("block") <= F.col("other")).alias("first"),
        "rep",
        "weight",
        "embedding",
    )

    def compare(key: tuple, data: pa.Table) -> pa.Table:
        first = data.column("first").to_numpy(zero_copy_only=False)
        units, weight = _unit(data.column("embedding")), data.column("weight").to_numpy()
        asks = np.flatnonzero(first)
        same = key[1].as_py() == key[2].as_py()
        held = asks if same else np.flatnonzero(~first)
        q, v = all_pairs(units[held], units[asks], least)
        q, v = asks[q], held[v]
        if same:
            q, v = q[q < v], v[q < v]
        n = len(data)
        counts = (np.bincount(q, weight[v], n) + np.bincount(v, weight[q], n)).astype(np.int64)
        part = _components(n, q, v)
        tied = np.flatnonzero(part != np.arange(n))
        reps = data.column("rep").to_pylist()
        return _link_rows(
            data.column("rep").type,
            [(reps[i], counts[i]) for i in np.flatnonzero(counts)],
            [(reps[i], reps[part[i]]) for i in tied],
        )

    return dealt.groupBy("space", "low", "high").applyInArrow(compare, LINK_COLUMNS.format(rep_type))


def _audit(classes: DataFrame, counted: DataFrame, least: float) -> float:
    """Share found of the links, against all vectors for two bounded samples: any vectors, and vectors with links found.

    The first grows until ``AUDITED_LINKS`` true links are in it or ``AUDITED_MOST`` vectors (or ``SAMPLE_BYTES`` of them) are asked; its linked vectors
    also give the mean of their shares. Where links are sparse it may hold few or none, so the second says how many
    links a vector with some has, and the true links are estimated over both kinds of vectors. The lowest of these
    counts. Only if no link was found anywhere and none is in the first sample is the recall taken to be 1.
    """
    widest = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    most = max(1, min(AUDITED_MOST, SAMPLE_BYTES // (8 * widest)))
    asked = min(AUDITED, most)
    while True:
        true, got = _audited(classes, counted, least, asked)
        total = sum(true.values())
        if total >= AUDITED_LINKS or len(true) < asked or asked >= most:
            break
        asked = min(4 * asked, most)
    found = 1.0
    if total:
        shares = [min(got.get(r, 0), n) / n for r, n in true.items() if n]
        found = min(sum(min(got.get(r, 0), n) for r, n in true.items()) / total, sum(shares) / len(shares))
    if total >= AUDITED_LINKS:
        return found
    linked = counted.where("n_links > 0").select(F.col("rep").alias("l_rep"))
    n_linked, n_all = linked.count(), classes.count()
    if n_linked:
        some, got_some = _audited(classes.join(linked, F.col("rep") == F.col("l_rep"), "left_semi"), counted, least, min(4 * AUDITED, most), classes)
        without = [n for r, n in true.items() if not got.get(r, 0)]
        missed = (n_all - n_linked) * (sum(without) / len(without) if without else 0.0)
        true_a_linked = sum(some.values()) / len(some)
        got_a_linked = sum(min(got_some.get(r, 0), n) for r, n in some.items()) / len(some)
        if true_a_linked or missed:
            found = min(found, n_linked * got_a_linked / (n_linked * true_a_linked + missed))
    return found


def _audited(of: DataFrame, counted: DataFrame, least: float, asked: int, classes: DataFrame | None = None) -> tuple[dict, dict]:
    """Links of each of ``asked`` vectors of ``of`` at most, by comparing them with all vectors, and the links found."""
    classes = of if classes is None else classes
    sample = of.orderBy(F.xxhash64("rep", F.lit("audit"))).limit(asked).toArrow()
    if not len(sample):
        return {}, {}
    spaces, reps = np.array(sample.column("space").to_pylist(), object), sample.column("rep").to_pylist()
    rows = sample.column("embedding").combine_chunks()
    units = {s: (np.flatnonzero(spaces == s), _unit(rows.take(pa.array(np.flatnonzero(spaces == s))))) for s in dict.fromkeys(spaces.tolist())}
    shared = classes.sparkSession.sparkContext.broadcast(units)
    n_reps = len(reps)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_reps, np.int64)
        for batch in batches:
            own = np.array(batch.column("space").to_pylist(), object)
            for space in set(own.tolist()) & set(shared.value):
                part = batch.filter(pa.array(own == space))
                at, vectors = shared.value[space]
                members, weight = _unit(part.column("embedding")), part.column("weight").to_numpy()
                for lo in range(0, len(members), 256):
                    near = vectors @ members[lo : lo + 256].T >= least
                    total[at] += near @ weight[lo : lo + 256]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_reps)), pa.array(total)], ["at", "n"])

    rep_type = classes.schema["rep"].dataType
    spark = classes.sparkSession
    truth = (
        classes.select("space", "weight", "embedding").mapInArrow(compare, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    )
    own = {r: w for r, w in zip(reps, sample.column("weight").to_pylist(), strict=True)}
    true = {reps[r["at"]]: r["n"] - own[reps[r["at"]]] for r in truth.collect()}
    wanted = spark.createDataFrame([(r,) for r in reps], f"asked {rep_type.simpleString()}")
    got = {r["rep"]: r["n_links"] for r in counted.join(wanted, F.col("rep") == F.col("asked")).collect()}
    return true, got


def near_vectors(
    vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Links between vectors of one label whose cosine is at least ``least``, and their components.

    Equal vectors (by 128 bits of hash) count as one with a weight. The pivots of a label are a bounded sample of its vectors;
    each vector belongs to the shards of its ``OVERLAP`` nearest pivots, and a large shard is cut into
    parts, which meet two by two. Each part builds a robust-pruned graph; a vector's neighbour lists from all its shards are
    united. In the part of its nearest pivot (and all parts of that shard) a vector runs a greedy search
    from the medoid that expands through the range; with other parts of its shard it is compared member by
    member. What is returned was verified in double precision, so no link is false. The recall is audited
    against all vectors for a sample, by link and by vector; below ``RECALL`` the overlap doubles and the
    search is run again. Where ``OVERLAP_MOST`` misses it too, all vectors of a label are compared in blocks.

    Returns one row per input row: id, ``n_links`` (other rows linked directly), ``component_id`` (smallest
    id reached, its own included), ``kept`` (id = component_id). A vector that is null, zero or empty or
    holds null or non-finite components, or has a null label or id, links with nothing. Vectors of
    different lengths never link. Repeated rows link with one another. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label")
    )
    whole = finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(whole, F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull())
    # adding 0.0 makes the two zeros one
    plain = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    good = rows.where("ok").select(
        "id", "embedding", F.concat_ws("|", F.size("embedding").cast("string"), "label").alias("space")
    ).withColumns({"k1": F.xxhash64("space", plain), "k2": F.xxhash64(F.lit("again"), "space", plain)})
    # names sort as the ids do, so a component's smallest name begins with its smallest id; two classes can share
    # their smallest id where ids repeat, and the hash tells them apart
    id_kind = vectors.schema[id_col].dataType.simpleString()
    classes = good.groupBy("k1", "k2").agg(
        F.min("id").alias("least_id"), F.count("*").alias("weight"), F.first("space").alias("space"), F.first("embedding").alias("embedding")
    )
    name = F.concat(sortable(F.col("least_id"), id_kind), F.hex("k1"), F.lit("-"), F.hex("k2"))
    named = checkpointed(classes.select(name.alias("rep"), "k1", "k2", "weight", "space", "embedding"))
    context = vectors.sparkSession.sparkContext
    pivots = context.broadcast(_choose_pivots(named))
    overlap = OVERLAP
    while True:
        exact = overlap > OVERLAP_MOST
        found = checkpointed(_exact_links(named, least) if exact else _links(named, pivots, overlap, least))
        counted = _counted(found)
        if exact or _audit(named, counted, least) >= RECALL:
            break
        overlap *= 2
    parts = connected_components(found.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # what is joined from here on has no vectors
    joined = named.select("rep", "weight", "k1", "k2").join(counted.withColumnRenamed("rep", "c_rep"), F.col("rep") == F.col("c_rep"), "left").join(
        parts, F.col("rep") == F.col("node"), "left"
    )
    first_name = F.coalesce("component", "rep")
    first_id = first_name if id_kind == "string" else F.substring(first_name, 1, 20)
    classes_out = joined.select(
        F.col("k1").alias("o1"), F.col("k2").alias("o2"), (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        unsorted(first_id, id_kind).alias("component_id"),
    )
    linked = good.select("id", "k1", "k2").join(classes_out, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2"))).select(
        F.col("id").alias(id_col), F.col("links").alias("n_links"), "component_id"
    )
    alone = rows.where("not ok").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select("*", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
