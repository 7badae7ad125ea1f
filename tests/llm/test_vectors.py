"""Vector operators against brute force, and on traps."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import near_vectors, topk
from siftwork.llm.components import connected_components

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, extra long, cell int, part int, rep string"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def traps(spark):
    v = [1.0, 2.0, 3.0]
    data = [
        (0, v), (50, v), (50, v), (1, [2.0, 4.0, 6.0]), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, NAN, 0.0]),
        (6, [1.0, INF, 0.0]), (100, [1.0, None, 0.0]), (None, v), (7, [1.0, 2.0]), (8, [-1.0, -2.0, -3.0]), (9, [1.0, 2.0, 3.1]),
    ]
    more = [(150, v, None)]
    return spark.createDataFrame([(i, e, 1, 1, 1, 1, "x") for i, e in data] + [(i, e, n, 1, 1, 1, "x") for i, e, n in more], SCHEMA)


def brute_links(data, least=0.98):
    ids = [i for i, _, _ in data]
    units = []
    for i, e, label in data:
        good = i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
        units.append(np.array(e, float) / np.linalg.norm(np.array(e, float)) if good else None)
    links, parent = defaultdict(int), {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(data)):
        for b in range(a):
            if units[a] is None or units[b] is None or data[a][2] != data[b][2] or len(units[a]) != len(units[b]):
                continue
            if units[a] @ units[b] >= least:
                links[a] += 1
                links[b] += 1
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    return links, root


def test_near_vector_traps(traps):
    data = [(r["vec_id"], r["embedding"], r["label"]) for r in rows(traps)]
    links, root = brute_links(data)
    want = sorted((repr(i), links[k], repr(root(i) if i is not None else None)) for k, (i, _, _) in enumerate(data))
    found = rows(near_vectors.near_vectors(traps))
    assert sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"])) for r in found) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert near_vectors.near_vectors(traps.limit(0)).count() == 0


def clusters(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 16))
    at = np.minimum(rng.geometric(0.05, n) - 1, 59)
    x = centres[at] + rng.normal(scale=rng.choice([0.02, 0.15, 0.4], n)[:, None], size=(n, 16))
    data = [(i, x[i].astype(np.float32).tolist(), int(at[i] % 3)) for i in range(n)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(5)


@pytest.mark.parametrize("shard, part", [(1000, 4096), (100, 60)])
def test_near_vectors_recall(spark, monkeypatch, shard, part):
    monkeypatch.setattr(near_vectors, "SHARD", shard)
    monkeypatch.setattr(near_vectors, "PART", part)
    data, df = clusters(spark)
    links, _ = brute_links(data)
    found = {r["vec_id"]: r["n_links"] for r in rows(near_vectors.near_vectors(df))}
    assert all(found[i] <= links[i] for i in range(len(data)))
    assert sum(found.values()) >= near_vectors.RECALL * sum(links.values())


def test_audit_counts_what_is_missing(spark):
    _, df = clusters(spark, 300)
    classes = df.select(F.lit("16|0").alias("space"), F.col("vec_id").cast("string").alias("rep"), F.lit(1).cast("long").alias("weight"), "embedding")
    none = classes.select("rep", F.lit(0).cast("long").alias("n_links"))
    assert near_vectors._audit(classes, none, 0.98) == 0.0


def brute_top(data, k=5, every=50):
    ints = [(i, [int(np.floor(256 * float(x))) for x in e]) for i, e in data]
    out = {}
    for q, a in ints:
        if q % every == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q and len(a) == len(b)]
            out.setdefault(q, []).extend(scored)
    return {(q, n + 1, i, -s) for q, scored in out.items() for n, (s, i) in enumerate(sorted(scored)[:k])}


def test_all_vectors_are_compared_where_the_last_overlap_misses(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 8))
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    # so many shards that 24 of them hold a part of a vector's links only, and several blocks
    monkeypatch.setattr(near_vectors, "SHARD", 4)
    monkeypatch.setattr(near_vectors, "PART", 200)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    links, root = brute_links(data, 0.3)
    found = rows(near_vectors.near_vectors(df, 0.3))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(i, links[i], root(i)) for i in range(len(data))]


def test_parts_of_a_shard_find_each_other(spark, monkeypatch):
    rng = np.random.default_rng(6)
    # islands: clusters of 60 in their part, none near its medoid
    x = np.repeat(rng.normal(size=(20, 16)), 120, 0) + rng.normal(scale=0.01, size=(2400, 16))
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    monkeypatch.setattr(near_vectors, "SHARD", 10_000_000)
    monkeypatch.setattr(near_vectors, "PART", 1200)
    monkeypatch.setattr(near_vectors, "RECALL", 0.0)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    links, root = brute_links(data)
    found = rows(near_vectors.near_vectors(df))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(i, links[i], root(i)) for i in range(len(data))]


def test_a_found_pair_counts_at_both_ends(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(300, 8)))]
    monkeypatch.setattr(near_vectors, "SHARD", 4)
    monkeypatch.setattr(near_vectors, "RECALL", 0.0)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    links, _ = brute_links(data, 0.8)
    found = rows(near_vectors.near_vectors(df, 0.8))
    sizes = defaultdict(int)
    for r in found:
        sizes[r["component_id"]] += 1
        assert r["n_links"] <= links[r["vec_id"]]
    assert max(sizes.values()) > 1
    assert all((r["n_links"] > 0) == (sizes[r["component_id"]] > 1) for r in found)
    assert sum(r["n_links"] for r in found) % 2 == 0


def test_topk_traps(traps):
    good = [(r["vec_id"], r["embedding"]) for r in rows(traps) if r["vec_id"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    found = rows(topk.top_k(traps.where("vec_id is null or vec_id <> 50")))
    want = brute_top([x for x in good if x[0] != 50])
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == want
    assert topk.top_k(traps).count() > 0
    assert topk.top_k(traps.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 37])
def test_topk_matches_brute_force_with_ties_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "ROW_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", max(3, block // 100))
    monkeypatch.setattr(topk, "QUERY_SLICE", max(2, block // 600))
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (600, 6)) / 4
    x[200:400] = x[200]
    data = [(i * 5, x[i].tolist()) for i in range(600)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    found = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(df))}
    assert found == brute_top([(i, np.float64(e)) for i, e in data])


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 4 * 50)
    data = [(i, 4, [i, 1, 2, 3]) for i in range(1000)]
    blocks = topk._blocks(spark.createDataFrame(data, "id long, dim int, ints array<long>"), "q", 4096).collect()
    assert len(blocks) == 20 and sum(len(b["q_ids"]) for b in blocks) == 8000


def test_topk_is_exact_beyond_doubles(spark):
    data = [(i, [float(2**19 + i), float(2**19 - 3 * i)]) for i in range(0, 200, 10)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(df))}
    assert found == brute_top(data)


def test_phase_three_resolves_few_products():
    rng = np.random.default_rng(8)
    c = np.floor(256 * rng.normal(size=(4000, 64))).astype(np.int64)
    c[1000:1040] = c[:40] + rng.integers(-3, 4, (40, 64))
    q, q_ids, c_ids = c[:40], np.arange(40), np.arange(4000)
    found, totals, tops = topk.gather(q_ids, q, c_ids, c, 5)
    exact = q @ c.T
    for i in range(40):
        assert totals[i, : len(found[i])].tolist() == exact[i, found[i]].tolist()
    cutoff = totals[:, 4]
    row, col, score, products = topk.resolve(q, c, cutoff, tops, [f.tolist() for f in found])
    assert products < 0.1 * exact.size
    assert score.tolist() == exact[row, col].tolist()
    for i in range(40):
        near = set(np.flatnonzero(exact[i] >= cutoff[i])) - {i}
        assert near == set(found[i][totals[i, : len(found[i])] >= cutoff[i]].tolist()) | set(col[row == i].tolist()) - {i}


def test_pivots_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "SHARD", 1)
    rows = [(f"{i:04}", "8|a", [float(i + 1)] * 8) for i in range(2000)] + [("wide", "9000|a", [1.0] * 9000)]
    df = spark.createDataFrame(rows, "rep string, space string, embedding array<double>")
    monkeypatch.setattr(near_vectors, "SAMPLE_BYTES", 256 * 100)
    pivots = near_vectors._choose_pivots(df)
    assert set(pivots) <= {"8|a"} and sum(p.nbytes for p in pivots.values()) <= 256 * 100
    assert near_vectors._choose_pivots(df.limit(0)) == {}


def test_sparse_links_are_audited(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32))
    x[7] = x[2001] + 1e-4
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(near_vectors.near_vectors(df))}
    assert found == {i: (1, 7) if i in (7, 2001) else (0, i) for i in range(3000)}
    classes = df.select(F.lit("32|1").alias("space"), F.col("vec_id").cast("string").alias("rep"), F.lit(1).cast("long").alias("weight"), "embedding")
    one_end = spark.createDataFrame([("7", 1), ("2001", 0)], "rep string, n_links long")
    assert near_vectors._audit(classes, one_end, 0.98) < near_vectors.RECALL


def test_ids_of_any_kind_and_negative_ones(spark):
    v, other = [1.0, 2.0], [2.0, -1.0]
    data = [(-5, v), (3, v), (12, other), (-7, other), (100, [1.0, 1.0])]
    ids = spark.createDataFrame([(i, e, 1) for i, e in data], "vec_id long, embedding array<float>, label int")
    want = {-5: -5, 3: -5, 12: -7, -7: -7, 100: 100}
    assert {r["vec_id"]: r["component_id"] for r in rows(near_vectors.near_vectors(ids))} == want
    names = ids.withColumn("vec_id", F.concat(F.lit("n"), F.col("vec_id").cast("string")))
    found = {r["vec_id"]: r["component_id"] for r in rows(near_vectors.near_vectors(names))}
    assert found == {"n-5": "n-5", "n3": "n-5", "n12": "n-7", "n-7": "n-7", "n100": "n100"}


def test_the_query_on_vectors_equals_brute_force(spark, sf_dir):
    data = [(r["vec_id"], r["embedding"], r["label"]) for r in rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))]
    links, root = brute_links(data)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(near_vectors.op4_near_vectors(spark, sf_dir))}
    assert all(n <= links[k] for k, (i, _, _) in enumerate(data) for n in [found[i][0]])
    assert sum(n for n, _ in found.values()) >= near_vectors.RECALL * sum(links.values())
    same = sum(found[i][1] == root(i) for i, _, _ in data)
    assert same >= near_vectors.RECALL * len(data)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (200, 200), (None, 3)]
    found = {r["node"]: r["component"] for r in rows(connected_components(spark.createDataFrame(chain, "a long, b long")))}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
