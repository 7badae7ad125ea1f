"""What the join on shingles writes: no more for a passage that documents share, and nothing that outlives its action."""

from __future__ import annotations

import random
import time

import numpy as np

from siftwork.llm import jaccard
from siftwork.llm.shingles import shingle_sets


def test_gaps_round_trip():
    rng = np.random.default_rng(1)
    for width, top in ((3, 40), (4, 48)):
        runs = [np.sort(rng.integers(0, 1 << top, n, np.uint64)) for n in (1, 7, 3000)] + [np.array([0, 0, (1 << 8 * width) - 1, 1 << 8 * width], np.uint64)]
        starts = np.cumsum([0, *(len(r) for r in runs[:-1])])
        raw, cuts = jaccard._as_gaps(np.concatenate(runs), starts, width)
        blobs = [raw[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert len(blobs) == len(runs)
        assert (jaccard._from_gaps(blobs, width) == np.concatenate(runs)).all()
        assert all((jaccard._from_gaps([b], width) == r).all() for b, r in zip(blobs, runs, strict=True))


def test_a_shared_passage_makes_no_group(spark, monkeypatch):
    """Texts that have one passage in common, whose hash is the smallest of all, once met one another all."""
    rng = random.Random(5)
    passages = [[f"p{rng.randrange(10**9)}" for _ in range(5)] for _ in range(20_000)]
    hashes, _ = shingle_sets([" ".join(p).encode() for p in passages], 5)
    passage = passages[int(hashes.argmin())]
    texts = []
    for i in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        texts.append([*words[:30], *passage, *words[30:]])
        if i % 100 == 0:
            texts.append([*texts[-1][:-1], "edited"])
    monkeypatch.setattr(jaccard, "GROUP_CHUNK", 8)
    sent = []

    def counted(df, checkpointed=jaccard.checkpointed):
        out = checkpointed(df)
        if "place" in out.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "checkpointed", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in jaccard.jaccard_components(docs).collect()}
    assert len(found) == 404 and sum(r["n_links"] for r in found.values()) == 8
    assert sent and max(sent) <= len(texts)


def test_long_sets_link(spark):
    """Sizes from 65,535 travel as one number."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**9)}" for _ in range(90_000)]
    texts = {1: words[:70_000], 2: words, 3: words[:67_000], 4: words[:60_000], 5: words[:40_000]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    # 70,000 of 90,000, 67,000 of 70,000, 60,000 of 70,000 and of 67,000
    assert found == {1: (69_996, 3, 1), 2: (89_996, 1, 1), 3: (66_996, 2, 1), 4: (59_996, 2, 1), 5: (39_996, 0, 5)}


def test_shuffles_go_with_their_action(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in blocks.getAllBlocks().mkString(" ").split() if x.startswith("shuffle")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = spark.conf.get(key, None), shuffles()
    docs = spark.createDataFrame([(i, f"{i % 50} b c d e f {i % 9} h") for i in range(300)], "doc_id long, text string")
    kept = jaccard.one_of_each(docs)
    for _ in range(20):
        if not (left := shuffles() - was):
            break
        time.sleep(0.5)
    assert not left and spark.conf.get(key, None) == before
    assert kept.count() <= 300
