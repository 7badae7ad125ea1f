"""Likeness joins and trims against brute force, and on traps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import frames, similarity

NAN, INF = float("nan"), float("inf")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(spark, rows, k, v):
    return spark.createDataFrame([(i, x if x is None else [None if y is None else float(y) for y in x]) for i, x in rows], f"{k} long, {v} array<double>")


def matched(asked, cache, **more):
    return {r["item"]: r["key"] for r in similarity.best_match(asked, cache, "item", "q", "key", "v", **more).collect()}


def test_best_match_of_the_whole_cache(spark, monkeypatch):
    rng = np.random.default_rng(3)
    cache = unit(rng.normal(size=(700, 12)))
    cache[300:320] = cache[5]
    asked = unit(np.concatenate([cache[:150] + rng.normal(scale=0.05, size=(150, 12)), rng.normal(size=(50, 12))]))
    asked[40:50] = asked[3]
    near = np.round(asked @ cache.T, 12)
    want = {i: int(near[i].argmax()) for i in range(len(asked)) if near[i].max() >= 0.93}
    left, right = vectors(spark, enumerate(asked), "item", "q"), vectors(spark, enumerate(cache), "key", "v")
    assert matched(left, right) == want
    monkeypatch.setattr(similarity, "GROUP_ROWS", 60)
    monkeypatch.setattr(similarity, "REGION", 50)
    assert matched(left, right) == want
    nothing = similarity.best_match(left, right.where("key < 0"), "item", "q", "key", "v")
    assert nothing.collect() == [] and nothing.columns == ["item", "key", "similarity"]
    assert matched(left.where("item < 0"), right) == {}


def test_bad_vectors_hide_nothing(spark):
    good = [(10, [1.0, 0.0]), (12, [0.6, 0.8])]
    bad = [(11, [NAN, 1.0]), (13, [None, 1.0]), (14, None), (15, []), (16, [0.0, 0.0]), (17, [INF, 0.0]), (18, [1.0, 0.0, 0.0]), (19, [1.0])]
    asked = vectors(spark, [(1, [1.0, 0.0]), (2, [NAN, 1.0]), (3, None), (4, [0.6, 0.8]), (5, [0.0, 1.0]), (6, [1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 0.0]), (1, [0.6, 0.8])], "item", "q")
    found = similarity.best_match(asked, vectors(spark, good + bad, "key", "v"), "item", "q", "key", "v").collect()
    assert sorted((r["item"], r["key"]) for r in found) == [(1, 10), (1, 12), (4, 12), (6, 18), (7, 10)]


def test_tables_compare_few_pairs(spark):
    rng = np.random.default_rng(8)
    cache = unit(rng.normal(size=(6000, 64)))
    asked = unit(cache[:400] + rng.normal(scale=0.04, size=(400, 64)))
    near = asked @ cache.T
    assert ((near.max(1) >= 0.93) & (near.max(1) < 0.97)).sum() > 300
    seen = {}
    found = matched(vectors(spark, enumerate(asked), "item", "q"), vectors(spark, enumerate(cache), "key", "v"), measured=seen)
    want = {i: int(near[i].argmax()) for i in range(400) if near[i].max() >= 0.93}
    assert seen["recall"] >= 0.9 and seen["tables"] in (8, 16) and seen["pairs"] == 400 * 6000
    assert seen["compared"] < 0.05 * seen["pairs"]
    assert len(set(found.items()) & set(want.items())) >= 0.97 * len(want) and set(found.items()) <= set(want.items())


def test_where_tables_miss_all_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(8)
    cache = unit(rng.normal(size=(300, 16)))
    asked = unit(cache[:100] + rng.normal(scale=0.08, size=(100, 16)))
    near = np.round(asked @ cache.T, 12)
    want = {i: int(near[i].argmax()) for i in range(100) if near[i].max() >= 0.93}
    monkeypatch.setattr(similarity, "RECALL", 1.1)
    monkeypatch.setattr(similarity, "GROUP_ROWS", 70)
    seen = {}
    assert matched(vectors(spark, enumerate(asked), "item", "q"), vectors(spark, enumerate(cache), "key", "v"), measured=seen) == want
    assert seen["tables"] == 0 and seen["compared"] == seen["pairs"]


def test_hashes_within_five_bits(spark):
    random.seed(6)
    base = [random.getrandbits(64) for _ in range(40)]
    flip = lambda h, n: h ^ sum(1 << b for b in random.sample(range(64), n))
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    cache = [(i, h) for i, h in enumerate(base)] + [(100 + i, base[i]) for i in range(5)]
    items = [(i * 10 + n, flip(h, n)) for i, h in enumerate(base) for n in range(8)] + [(900, base[0]), (901, base[0])]
    make = lambda rows, k, h: spark.createDataFrame([(i, signed(x)) for i, x in rows] + [(9999, None)], f"{k} long, {h} long")
    pairs = similarity.hamming_join(make(items, "item", "q"), make(cache, "cached", "c"), "q", "c")
    want = sorted((i, j, (a ^ b).bit_count()) for i, a in items for j, b in cache if (a ^ b).bit_count() <= 5)
    assert sorted((r["item"], r["cached"], r["distance"]) for r in pairs.collect()) == want
    first = similarity.first_within(make(items, "item", "q"), make(cache, "cached", "c"), "item", "q", "cached", "c")
    best = {}
    for i, j, d in want:
        best.setdefault(i, (j, d))
    assert {r["item"]: (r["cached"], r["distance"]) for r in first.collect()} == best


@pytest.mark.parametrize("ranked", [20, 100_000])
def test_trim_drops_what_has_no_order_first(spark, ranked):
    rows = [(None if k % 10 == 0 else float("nan") if k % 10 == 5 and k < 100 else float(k), k) for k in range(1000)]
    df = spark.createDataFrame(rows, "k double, v long")
    for share, most in ((0.01, 100), (0.11, 100), (0.2, 10), (0.5, 10), (1.0, 10), (0.5, 1000)):
        left = similarity.trim_oldest(df, share, most, "k", buckets=7, ranked=ranked).collect()
        gone = max(1, int(1000 * share)) if most < 1000 else 0
        assert len(left) == 1000 - gone and len({r["v"] for r in left}) == len(left)
        known = sorted(k for k, _ in rows if k is not None and k == k)
        unknown = 1000 - len(known)
        kept = sorted(r["k"] for r in left if r["k"] is not None and r["k"] == r["k"])
        assert kept == (known if gone <= unknown else known[gone - unknown :])


@pytest.mark.parametrize("ranked", [20, 100_000])
def test_trim_of_equal_orders(spark, ranked):
    trim = lambda rows, share: similarity.trim_oldest(spark.createDataFrame(rows, "k long, v long"), share, 10, "k", buckets=7, ranked=ranked).collect()
    left = trim([(5, v) for v in range(300)] + [(9, 1000)], 0.4)
    assert len(left) == 181 and (9, 1000) in map(tuple, left) and len(set(map(tuple, left))) == 181
    assert set(map(tuple, left)) == set(map(tuple, trim([(9, 1000)] + [(5, v) for v in reversed(range(300))], 0.4)))
    copies = trim([(5, 1)] * 200 + [(6, 2)], 0.25)
    assert sorted(map(tuple, copies)) == [(5, 1)] * 150 + [(6, 2)]


def test_a_code_in_one_frame_reaches_the_decision(spark):
    from siftwork.plans import moderation

    risks = ", ".join(f"0.0D as {k}" for k in frames.RISKS)
    shots = spark.sql(f"select id div 4 as video, id % 4 as frame, {risks}, if(id = 2, 0.95D, 0.0D) as qr_code_score, if(id = 6, null, 0.1D) as promotion_score, cast(id as int) as marketing_keyword_count from range(8)")
    top = frames.summarise(shots).orderBy("video").collect()
    assert [(r["qr_code_score"], r["promotion_score"], r["marketing_keyword_count"], r["n_frames"]) for r in top] == [(0.95, 0.1, 3.0, 4), (0.0, 0.1, 7.0, 4)]
    said = spark.sql("select 1L as video, 0.2D as hate_speech_score")
    calm = {r["video"]: r for r in moderation.moderate_videos(shots.withColumn("marketing_keyword_count", F.lit(0)), said).collect()}
    assert calm[0]["qr_code_score"] == 0.95 and calm[1]["hate_speech_score"] == 0.2
    assert calm[0]["decision"] == "REJECTED" and calm[0]["code"] != calm[1]["code"], (calm[0]["rule"], calm[1]["rule"], calm[1]["reason"])
