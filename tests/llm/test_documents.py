"""Operators on documents against brute force, and on traps."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from oracle import assert_same, connect
from pyspark.sql import functions as F

from siftwork.llm import attention, bpe, jaccard, language, licences, lm_scoring, mixing, registry, sharding, token_counts
from siftwork.llm.attention import BEFORE, CLASSES, FEATURES, GROUPS, PARTS, SCORED, Attention, describe_subwords, following, windows

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_sql_oracles(spark, sf_dir):
    duck = connect(sf_dir)
    for name, sql in registry.ORACLES.items():
        assert_same(registry.QUERIES[name](spark, sf_dir), sql, duck)


def test_bpe_round_trip(docs, reference):
    found = rows(bpe.encode_texts(docs, VOCABULARY, public_tokenizers.PATTERN))
    assert len(found) == docs.count()
    texts = defaultdict(list)
    for r in rows(docs.select("doc_id", "text")):
        texts[r["doc_id"]].append(r["text"] or "")
    for r in found:
        text = texts[r["doc_id"]][0]
        assert list(r["ids"]) == reference.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode_texts(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_bpe_trees_agree():
    vocabulary = bpe.Vocabulary(VOCABULARY)
    rng = np.random.default_rng(0)
    pieces = [bytes(rng.choice(list(b"abcdet rs"), n)) for n in rng.integers(1, bpe.SHORT, 300)]
    pieces = [p for p in pieces if p not in vocabulary.ranks]
    by_length = defaultdict(list)
    for p in pieces:
        by_length[(len(p) - 1).bit_length()].append(p)
    for group in by_length.values():
        ids, counts = vocabulary.encode_short(group)
        assert ids.tolist() == [t for p in group for t in vocabulary.encode_long(p)]
        assert counts.sum() == len(ids)


def test_bpe_query(spark, sf_dir, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    for r in rows(bpe.op3_bpe(spark, sf_dir)):
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_token_histogram(docs, reference):
    lengths = token_counts.encoded_lengths(docs, VOCABULARY, public_tokenizers.PATTERN)
    hist = token_counts.length_histogram(lengths).cache()
    true = [len(reference.encode_ordinary(r["text"] or "")) for r in rows(docs.select("text"))]
    for r in rows(hist):
        n = r["n_tokens"]
        assert r["docs"] == true.count(n) and r["tokens"] == n * r["docs"]
        assert r["docs_ge"] == sum(x >= n for x in true) and r["tokens_ge"] == sum(x for x in true if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in true)
        assert r["rank_to"] == sum(x <= n for x in true)
    for limit in (0, 7, 100, 10**9):
        got = token_counts.truncated_total(hist, limit).first()
        assert (got["kept_tokens"], got["cut_docs"]) == (sum(min(x, limit) for x in true), sum(x > limit for x in true))
    for share in (0, 0.25, 0.5, 0.99, 1):
        at = max(1, math.ceil(share * len(true)))
        assert token_counts.quantile(hist, share).first()["n_tokens"] == sorted(true)[at - 1]
    assert token_counts.length_histogram(lengths.limit(0)).count() == 0
    assert token_counts.truncated_total(hist.limit(0), 5).first()["docs"] == 0
    with pytest.raises(ValueError):
        token_counts.truncated_total(hist, -1)


def check_shards(df, found, n):
    sizes = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows(df))
    assert sizes == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in found)
    slots = defaultdict(list)
    for r in found:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding(docs, spark, sf_dir):
    check_shards(docs, rows(sharding.shard_by_bytes(docs, 4)), 4)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = rows(sharding.op6_sharding(spark, sf_dir))
    check_shards(df, found, 16)
    total, per = sum(r["size"] for r in found), Counter()
    for r in found:
        per[r["shard"]] += r["size"]
    slack = max(r["size"] for r in found) + 0.01 * total / 16
    assert all(abs(per[s] - total / 16) <= slack for s in range(16))
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_a_heavy_group_is_cut_and_a_light_one_stays_whole(spark):
    texts = [(i, "the same text over and over") for i in range(300)] + [(1000 + i, f"text {i % 200}") for i in range(600)]
    found = rows(sharding.shard_by_bytes(spark.createDataFrame(texts, "doc_id long, text string"), 4, whole_share=0.02))
    per = Counter()
    for r in found:
        per[r["shard"]] += r["size"]
    assert max(per.values()) - min(per.values()) < 0.05 * sum(per.values())
    by_text = defaultdict(set)
    for r in found:
        if r["doc_id"] >= 1000:
            by_text[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())


@pytest.mark.parametrize("piece", [2048, 7])
@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 3.0, "c": 1.0, "d": 1.0}, {"a": 0.0}, {"a": 0.7071, "b": 0.0, "c": 0.0003}])
def test_mixing_stays_within_a_block_of_the_weights(spark, monkeypatch, weights, piece):
    monkeypatch.setattr(mixing, "PIECE", piece)
    counts = {"a": 400, "b": 90, "c": 33, "d": 1, None: 20}
    data = [(i, s) for s, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(data, "doc_id long, source string")
    found = rows(mixing.mix_sources(df, weights, block_rows=4))
    assert Counter((r["doc_id"], r["source"]) for r in found) == Counter(data)
    blocks = {r["slot"]: r for r in found}
    assert sorted(blocks) == list(range(len(blocks)))
    assert all(b["release"] <= b["slot"] < b["deadline"] for b in blocks.values())
    # against the weights themselves, while all weighted sources last; the others come after them
    weight = {s: n**0.5 for s, n in counts.items()} if weights is None else {s: w for s, w in weights.items() if w and s in counts}
    left = {s: -(-counts[s] // 4) for s in weight}
    done, at = Counter(), 0
    while weight and all(done[s] < left[s] for s in left):
        done[blocks[at]["source"]] += 1
        at += 1
        if all(done[s] < left[s] for s in left):
            assert set(done) <= set(weight)
            assert all(abs(done[s] - at * weight[s] / sum(weight.values())) < 1 + 1e-9 for s in left)
    last_weighted = max((b["slot"] for b in blocks.values() if b["source"] in weight), default=-1)
    assert last_weighted + 1 == sum(left.values())
    assert sorted(r["seq"] for r in found if r["slot"] == 0) == list(range(sum(r["slot"] == 0 for r in found)))


def earliest_deadline_first(n, u):
    """(source, block, release, deadline, slot) of a plain fold over all slots."""
    fluid = lambda s, i: sum(min(n[j] * u[s], i * u[j]) for j in range(len(n)))
    head = lambda s, i: (fluid(s, i) // u[s], -(-fluid(s, i + 1) // u[s]))
    at, out = [0] * len(n), []
    for t in range(sum(n)):
        heads = [(*head(s, at[s]), s) for s in range(len(n)) if at[s] < n[s]]
        release, deadline, s = min((h for h in heads if h[0] <= t), key=lambda h: h[1:])
        out.append((s, at[s], release, deadline, t))
        at[s] += 1
    return out


@pytest.mark.parametrize("piece, chunk, borders", [(1, 2, 1 << 21), (3, 256, 1 << 21), (8, 1, 1 << 21), (1, 256, 40)])
def test_mixing_in_pieces_equals_one_fold_over_all_slots(spark, monkeypatch, piece, chunk, borders):
    for name, value in {"PIECE": piece, "CHUNK": chunk, "BORDERS": borders}.items():
        monkeypatch.setattr(mixing, name, value)
    # rare sources beside frequent ones, equal weights, sources that run out early; one plan in each tier
    rng = random.Random(piece)
    plans = [([3, 9, 40, 1, 2, 1, 1], [5, 1, 997, 2, 2, 1, 1]), ([rng.choice([1, 2, 9, 30]) for _ in range(9)], [rng.choice([1, 2, 5, 311, 1000]) for _ in range(9)])]
    data = [(f"s{s}", 0, n[s], tier, u[s]) for tier, (n, u) in enumerate(plans) for s in range(len(n))]
    found = mixing.schedule(spark.createDataFrame(data, "source_key string, n_rows long, n_blocks long, tier int, units long"))
    first = earliest_deadline_first(*plans[0])
    want = first + [(s, i, r + len(first), d + len(first), t + len(first)) for s, i, r, d, t in earliest_deadline_first(*plans[1])]
    assert sorted((r["slot"], r["of_source"], r["of_block"], r["release"], r["deadline"]) for r in found.collect()) == [
        (t, f"s{s}", i, r, d) for s, i, r, d, t in want
    ]


def test_mixing_of_many_sources_keeps_their_windows(spark):
    data = [(i, f"s{i % 3000 if i % 3 else 0}") for i in range(9000)]
    found = rows(mixing.mix_sources(spark.createDataFrame(data, "doc_id long, source string"), block_rows=100))
    assert len(found) == len(data) and all(r["release"] <= r["slot"] < r["deadline"] for r in found)


def test_mixing_traps(docs):
    assert mixing.mix_sources(docs).count() == docs.count()
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    laid = mixing.mixed_documents(docs)
    assert laid.columns == docs.columns and laid.count() == docs.count()
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"a": -1.0})
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"a": float("nan")})


def test_licences(docs, spark):
    catalogue = spark.createDataFrame(licences.CATALOGUE, "licence string, text string")
    mit = dict(licences.CATALOGUE[:1])["MIT"]
    texts = [
        (1, "The MIT holders\n" + mit),
        (2, "Copyright (c) 2020 Somebody\nAll rights reserved.\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE")),
        (3, "  # " + mit.replace("\n", "\n\n# ").replace('"', "'")),
        (4, mit + " and more"),
        (5, None),
        (6, "... !!"),
        (7, "© 1999 Me\nReleased under the MIT Licence"),
    ]
    found = {r["doc_id"]: r["licence"] for r in rows(licences.scan_licences(spark.createDataFrame(texts, "doc_id long, text string"), catalogue))}
    assert found == {1: None, 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: "MIT"}
    extra = spark.createDataFrame([("Own", next(r["digest"] for r in rows(licences.scan_licences(spark.createDataFrame([(1, "our own terms")], "doc_id long, text string"), catalogue)))), ("None", None)], "licence string, digest string")
    own = licences.scan_licences(spark.createDataFrame([(1, "OUR own, terms!")], "doc_id long, text string"), catalogue, extra)
    assert rows(own)[0]["licence"] == "Own"
    assert licences.scan_licences(docs, catalogue).count() == docs.count()
    assert licences.scan_licences(docs.limit(0), catalogue).count() == 0


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_whole_licences_are_known_by_digest(spark, tmp_path):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {}
    for name, licence in files.items():
        with open(f"/usr/share/common-licenses/{name}") as f:
            texts[licence] = f.read()
    data = [(licence, x) for licence, t in texts.items() for x in (t, t.upper().replace("\n", "\r\n  "), "Copyright (c) 2021 Some Body\n" + t)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(data)] + [(99, texts["MPL-2.0"] + " more")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["licence"] for r in rows(licences.op8_licences(spark, str(tmp_path)))}
    assert found == {i: licence for i, (licence, _) in enumerate(data)} | {99: None}
    assert_same(licences.op8_licences(spark, str(tmp_path)), licences.OP8_SQL, connect_folder(tmp_path))


def connect_folder(path):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    return c


def brute_components(texts, percent=75):
    """Union-find over all pairs that share a shingle; null ids and empty sets stay alone."""
    sets = {}
    for i, t in texts:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, holders = Counter(), defaultdict(list)
    for i in sorted(i for i in sets if i is not None):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for s in sets[i]:
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), links[i]) for i, s in sets.items()}


def test_jaccard_traps(docs):
    want = brute_components([(r["doc_id"], r["text"]) for r in rows(docs.select("doc_id", "text"))])
    found = rows(jaccard.jaccard_components(docs))
    assert len(found) == docs.count()
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]][:2] for r in found)
    # the row that stands twice links with itself and counts for the others
    assert {r["doc_id"]: r["n_links"] for r in found if r["doc_id"] in (1, 2, 3, 4, 10)} == {1: 2, 2: 2, 3: 0, 4: 0, 10: 1}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in rows(kept)) == Counter(i for i, (_, c, _) in want.items() if i == c)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_a_repeated_id_with_other_words_is_a_document_of_its_own(spark):
    first, second = "one two three four five six seven eight nine ten", "red orange yellow green blue indigo violet black white grey"
    texts = [(1, first), (1, second), (1, second), (1, second.upper()), (2, second), (3, first), ("x", None)]
    for kind, data in (("long", texts[:-1]), ("string", [(f"d{i}", t) for i, t in texts])):
        df = spark.createDataFrame(data, f"doc_id {kind}, text string")
        kept = rows(jaccard.one_of_each(df))
        assert sorted(r["text"].lower() for r in kept if r["text"]) == sorted([first, second])
        assert len(kept) == len({t.lower() for _, t in data if t}) + sum(t is None for _, t in data)


def test_jaccard_near_the_threshold(spark, monkeypatch):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(40)]
    texts, base = [], []
    for i in range(400):
        if i % 8 == 0:
            base = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(3, 120)))] + passage * int(rng.integers(0, 2))
        edited = [w if rng.random() > 0.03 else f"e{rng.integers(0, 9999)}" for w in base]
        texts.append((i, " ".join(edited)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    want = brute_components(texts)
    for chunk, common in ((1024, 32), (3, 4)):
        monkeypatch.setattr(jaccard, "GROUP_CHUNK", chunk)
        monkeypatch.setattr(jaccard, "CHUNK_QUERIES", 2 * chunk)
        monkeypatch.setattr(jaccard, "COMMON", common)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in rows(jaccard.jaccard_components(df))} == want
    monkeypatch.setattr(jaccard, "CHUNK_TOKENS", 500)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in rows(jaccard.jaccard_components(df))} == want


def test_jaccard_query(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))]
    want = brute_components(texts)
    assert all((r["n_shingles"], r["component_id"], r["n_links"]) == want[r["doc_id"]] for r in rows(jaccard.op9_jaccard(spark, sf_dir)))


def test_language(docs, spark, sf_dir):
    found = rows(language.identify_languages(docs))
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (4, 5, 6, 7))
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    none = language.identify_languages(docs.limit(0))
    assert none.count() == 0
    unlabelled = language.identify_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in rows(unlabelled)} == {"und"}
    true = {r["doc_id"]: r["lang"] for r in rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    held = [r for r in rows(language.op1_language(spark, sf_dir)) if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_context_trees_are_distributions_and_exact():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 8, (4000, 4)) + 97, axis=0)
    packed = (grams << np.array([24, 16, 8, 0])).sum(1)
    of = rng.integers(0, 2, len(packed))
    trees = language.ContextTrees(["x", "y"], packed, rng.integers(1, 9, len(packed)), of)
    per_byte = np.ones(trees.width)
    per_byte[0] = 256 - (trees.width - 1)
    for bits in trees.bits:
        sums = (np.exp2(-bits.reshape(-1, trees.width).astype(float)) * per_byte).sum(1)
        assert np.allclose(sums, 1, atol=1e-5)
    text = "abcabdzzheg"
    raw = [0, 0, 0, *text.encode()]
    want = np.zeros(2)
    for i in range(3, len(raw)):
        node = 0
        for k in (1, 2, 3):
            at = 0
            for q, b in enumerate(raw[i - k : i]):
                at = trees.child[q][at, trees.symbol[b]]
                if at >= trees.sizes[q + 1]:
                    break
            else:
                node = at + trees.starts[k]
        want += [b[node * trees.width + trees.symbol[raw[i]]] for b in trees.bits]
    assert np.allclose(trees.code_lengths([text, "", "a"])[0], want, rtol=1e-5)


def plain_bits(texts, text):
    """Bits of a text under a byte model of one language, from its definition."""
    counts = defaultdict(Counter)
    for t in texts:
        raw = bytes(language.ORDER) + t.encode()
        for i in range(language.ORDER, len(raw)):
            for k in range(language.ORDER + 1):
                counts[raw[i - k : i]][raw[i]] += 1
    return counts, bytes(language.ORDER) + text.encode()


def plain_code_length(texts, text, alphabet):
    counts, raw = plain_bits(texts, text)

    def row(context):
        own = counts[context] if context in counts else Counter()
        n, q = sum(own.values()), len(own)
        if context and n < language.LEAST_SEEN:
            return row(context[1:])
        shorter = row(context[1:]) if context else {b: 1 / 256 for b in range(256)}
        if not n:
            return shorter
        left = sum(p for b, p in shorter.items() if b not in own)
        return {b: own[b] / (n + q if left > 0 else n) if b in own else p / left * q / (n + q) for b, p in shorter.items()}

    # bytes that no text has are one symbol in a context
    fold = lambda c: bytes(b if b in alphabet else 0 for b in c)
    return -sum(math.log2(row(fold(raw[i - language.ORDER : i]))[raw[i]]) for i in range(language.ORDER, len(raw)))


def test_language_scores_equal_plain_partial_matching(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:24]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0][:6]
    lines = {"aa": "the cat sat on the mat and the rat ran at that", "bb": "el gato se sento en la mesa y la rata se fue a casa"}
    texts = {lang: [" ".join(np.random.default_rng(k).permutation(line.split())) for k in range(12)] for lang, line in lines.items()}
    data = [(i, t, lang) for i, (lang, t) in zip(ids, [(lang, t) for lang in texts for t in texts[lang]])]
    probes = ["the rat", "la mesa", "qu\u00e9 the gato", "x", "that that", "zz top la"]
    data += [(i, t, None) for i, t in zip(held, probes)]
    found = {r["doc_id"]: r for r in rows(language.identify_languages(spark.createDataFrame(data, "doc_id long, text string, lang string")))}
    alphabet = set("".join(t for ts in texts.values() for t in ts).encode())
    for i, t in zip(held, probes):
        bits = {lang: plain_code_length(ts, t, alphabet) for lang, ts in texts.items()}
        best = min(bits, key=lambda x: (bits[x], x))
        assert found[i]["lang_pred"] == best
        assert found[i]["score"] == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()), rel=1e-3)


def test_language_model(docs, spark, sf_dir):
    for df in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        found = rows(lm_scoring.score_texts(df, VOCABULARY, public_tokenizers.PATTERN))
        texts = rows(df.select("doc_id", "text"))
        assert len(found) == len(texts)
        training = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
        counts = Counter()
        for r in texts:
            if training(r["doc_id"]):
                counts.update([*words(r["text"]), None])
        n, v = sum(counts.values()), len(counts)
        text_of = {r["doc_id"]: r["text"] for r in texts}
        for r in found:
            tokens = [*words(text_of[r["doc_id"]]), None]
            base = sum(math.log10((counts.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
            assert r["held_out"] is not training(r["doc_id"])
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts.get(t, 0) > 0 for t in tokens), n)
            assert r["base_score"] == pytest.approx(base, rel=1e-9)
            assert r["score"] < 0
    assert lm_scoring.score_texts(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_language_model_scores_do_not_depend_on_partitions_and_gain(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TRAINER_TOKENS", 150_000)
    larger = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    df = spark.read.parquet(f"{larger if os.path.isdir(larger) else sf_dir}/documents.parquet").select("doc_id", "text")
    one, two = (
        {r["doc_id"]: r for r in rows(lm_scoring.score_texts(x, VOCABULARY, public_tokenizers.PATTERN))} for x in (df.coalesce(1), df.repartition(9, "text"))
    )
    for i, r in one.items():
        assert two[i]["score"] == pytest.approx(r["score"], rel=1e-5)
        assert two[i]["base_score"] == pytest.approx(r["base_score"], rel=1e-9)
    held = [r for r in one.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_every_training_text_moves_the_weights(spark):
    texts = [(i, f"{a} was {b} when {a} met {b}") for i, (a, b) in enumerate([("winter", "lonely"), ("sommer", "einsam"), ("verano", "solitario")])]
    train = spark.createDataFrame(texts, "id long, text string")
    learnt = lm_scoring.tokenised(train, VOCABULARY, public_tokenizers.PATTERN)
    parts = learnt.where("kind = 0").select("at", "n", "ids")
    words_ = lm_scoring.words_of(VOCABULARY, public_tokenizers.PATTERN)
    kind = lm_scoring._id_type(words_)
    subwords = lm_scoring.learnt_subwords(learnt, words_.end, kind)
    *_, ids, _ = words_.split([t for _, t in texts])
    # a class and a part were learnt for each of them: ids that the texts lack share the last ones
    assert not ((subwords.of[ids] == CLASSES - 1) & (subwords.part[ids] == PARTS - 1)).any()
    model = Attention(subwords)
    before = [w.copy() for w in model.weights()]
    for r in parts.collect():
        after = lm_scoring._trainers(parts.where(F.col("at") == r["at"]), 1, model, kind, 0.01, 1, 64, 1000)
        assert any((a != b).any() for a, b in zip(before, after, strict=True))


def _subwords(n, rng):
    counts = rng.integers(1, 50, n)
    out = describe_subwords(rng.normal(size=(n, FEATURES)), counts)
    # what follows is a part that has ids
    pairs = np.zeros((out.rows, CLASSES * PARTS))
    there = np.unique(out.of.astype(int) * PARTS + out.part)
    pairs[:, there] = rng.integers(10, 90, (out.rows, len(there)))
    following(out, pairs, rng.integers(0, 3, (CLASSES * GROUPS, n)).astype(float))
    return out


def test_windows_score_each_token_once():
    lengths = np.array([1, 2, 17, 40, 33])
    starts, sizes, first, of = windows(lengths)
    scored = np.concatenate([s + 1 + np.arange(n) for s, n in zip(starts, sizes)])
    assert sorted(scored) == sorted(set(range(lengths.sum())) - set(np.cumsum(lengths) - lengths))
    assert (np.isin(starts, np.cumsum(lengths) - lengths) == first).all() and len(of) == len(starts)


def test_scores_equal_a_plain_token_by_token_attention():
    rng = np.random.default_rng(2)
    w = _subwords(300, rng)
    model = Attention(w)
    lengths = np.array([1, 2, 17, 60, 33])
    ids = rng.integers(0, 300, lengths.sum())
    found = model.score(ids, lengths, at_once=3)
    k, v = np.split(w.points.astype(float) @ model.kv, 2, axis=1)
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for s, (lo, n) in enumerate(zip(np.cumsum(lengths) - lengths, lengths)):
        total, own = 0.0, ids[lo : lo + n]
        for t in range(1, n):
            last = w.row[own[t - 1]]
            least = max(0, (t - 1) // SCORED * SCORED - BEFORE)
            rows_seen = w.row[own[least:t]]
            near = model.near[(t - 1) - np.arange(least, t)]
            a = softmax(k[rows_seen] @ (w.points[last].astype(float) @ model.q) + near)
            u = a @ v[rows_seen]
            c, p = w.of[own[t]], w.part[own[t]]
            total += np.log(softmax(w.first[last] + u @ model.first)[c])
            total += np.log(softmax(w.second[last * CLASSES + c] + u @ model.second[c])[p])
            total += w.emit[w.group[own[t - 1]], own[t]]
        assert found[s] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_all_ids_together_have_probability_one():
    rng = np.random.default_rng(3)
    w = _subwords(200, rng)
    model = Attention(w)
    start = rng.integers(0, 200, 30)
    before = model.score(start, np.array([30]))[0]
    each = [model.score(np.append(start, i), np.array([31]))[0] for i in range(200)]
    # parts that no id has keep a little
    assert 0.8 < np.exp(np.array(each) - before).sum() < 1 + 1e-4


def test_attention_learns():
    rng = np.random.default_rng(4)
    w = _subwords(40, rng)
    ids = np.tile(rng.integers(0, 40, 25), 160)
    model = Attention(w)
    first = model.train(ids, np.array([4000]), rate=0.0)
    assert model.train(ids, np.array([4000]), passes=60) < 0.6 * first


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    model = Attention(_subwords(60, rng))
    lengths = np.array([30, 12])
    ids = rng.integers(0, 60, 42)
    starts, sizes, first, _ = windows(lengths)
    (_, seen, of, part), = model._batches(ids, starts, 99)
    valid = (np.arange(SCORED) < sizes[:, None]).astype(np.float32)
    slopes = []
    model._update = lambda found, rate: slopes.append(found)
    loss = lambda: model.step(seen, first, of, part, valid, 0)
    loss()
    for name, slope in zip(model.NAMES, slopes[0], strict=True):
        weight = getattr(model, name)
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        old, step = weight[at], 1e-2
        weight[at] = old + step
        up = loss()
        weight[at] = old - step
        down = loss()
        weight[at] = old
        assert (up - down) / (2 * step) == pytest.approx(slope[at], rel=0.05, abs=1e-4)


def test_pairs_are_counted_in_place_and_few_at_a_time(spark):
    most, size = lm_scoring.COUNTED_AT_ONCE, 1000
    each = [np.random.default_rng(i).integers(0, size, 30_000).astype(np.uint16) for i in range(20)]
    texts = spark.createDataFrame([(i.tobytes(),) for i in each], "ids binary").coalesce(1)

    def keys_of(ids, lengths):
        assert len(ids) < most + 30_000 and lengths.sum() == len(ids)
        return ids.astype(np.int64)

    found = lm_scoring._dense(lm_scoring._counted(texts, keys_of, size, np.uint16), size)
    assert (found == np.bincount(np.concatenate(each), minlength=size)).all()


def test_only_words_not_seen_before_are_cut_out_and_encoded(monkeypatch):
    words_, learnt = lm_scoring.Words(VOCABULARY, public_tokenizers.PATTERN), []
    learn = lm_scoring.Words._learn
    monkeypatch.setattr(lm_scoring.Words, "_learn", lambda self, words, *rest: learnt.append(sorted(words)) or learn(self, words, *rest))
    one = words_.split(["The cat\tsat", "", " the CAT  \u00e9t\u00e9"])
    two = words_.split(["the dog sat", "cat"])
    assert learnt == [sorted([b"the", b"cat", b"sat", "\u00e9t\u00e9".encode()]), [b"dog"]]
    for (distinct, place, counts, ids, lengths), texts in ((one, ["the cat sat", "", "the cat \u00e9t\u00e9"]), (two, ["the dog sat", "cat"])):
        assert counts.tolist() == [len(t.split()) for t in texts] and (np.diff(distinct.astype(object)) > 0).all()
        plain = [[words_.end, *(words_.codec.encode_ordinary(" " + t) if t else []), words_.end] for t in texts]
        assert ids.tolist() == sum(plain, []) and lengths.tolist() == [len(x) for x in plain]
        same = [w for t in texts for w in t.split()]
        assert all((place[i] == place[j]) == (same[i] == same[j]) for i in range(len(same)) for j in range(len(same)))


def test_products_are_searched_for_large_values_only_where_they_may_have_some(monkeypatch):
    rng = np.random.default_rng(6)
    w = _subwords(200, rng)
    ids, lengths, searched = rng.integers(0, 200, 90), np.array([90]), []
    monkeypatch.setattr(attention, "_bounded", lambda x, plain=attention._bounded: searched.append(x.shape) or plain(x))
    model = Attention(w)
    model.score(ids, lengths)
    assert len(searched) == 1  # the attention's; no class's
    for heads in (model.first, model.second):
        heads *= 1e5
    searched.clear()
    assert np.isfinite(model.score(ids, lengths)).all()
    assert len(searched) > 2
