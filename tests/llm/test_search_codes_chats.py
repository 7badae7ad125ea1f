"""Lexical search, vector codes and chats against brute force, and on traps."""

import hashlib
import math
import random
import re

from collections import Counter

import numpy as np
import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from siftwork.llm import chat, lexical, vector_codes

NAN, INF = float("nan"), float("inf")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as t

    return t.path("byte_bpe_multi_50k.tiktoken"), t.PATTERN


@pytest.mark.parametrize("name", ["op11_lexical", "op12_vector_codes", "op13_chat"])
def test_query_matches_its_sql(name, spark, sf_dir):
    from siftwork.llm.registry import ORACLES, QUERIES

    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], connect(sf_dir))


def brute_search(items, docs, k):
    """items: {id: [texts]}, docs: [(id, text)]."""
    cut = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, Counter(cut(t))) for i, t in docs if i is not None]
    held = [(i, c) for i, c in held if c]
    n, words = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, texts in items.items():
        asked = Counter(t for text in texts for t in cut(text))
        scored = []
        for doc_id, c in held:
            m = 100 - 25 + (25 * c.total() * n) // words
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scored.append((-score, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def ranked(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("vocabulary,block,window", [(2**17, 2**17, 8192), (3, 4, 8)])
def test_lexical_search(spark, docs, monkeypatch, vocabulary, block, window):
    monkeypatch.setattr(lexical, "VOCABULARY", vocabulary)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "WINDOW", window)
    texts = ["The quick FOX, the fox", "mot", None, "", "ÉLAN élan été", "nowhere-to-be-found", "snow ☃", "number 7 of many lines", "aaaa " + "a" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "fox"), (7, "lines")]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumn("score", F.lit(1)).withColumn("doc_id", F.lit(2))
    want = brute_search({i: [t for j, t in rows if j == i] for i in range(len(texts))}, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 20)
    assert ranked(lexical.search(items, docs)) == want
    assert {r[0] for r in want} == {0, 1, 4, 6, 7, 8}


def test_lexical_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert lexical.search(items, docs.limit(0)).collect() == []
    found = lexical.search(items.limit(0), docs)
    assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(items.withColumn("text", F.lit("zzz")), docs).collect() == []


def test_windows_and_heap_over_segments():
    random.seed(3)
    words = [f"w{i}" for i in range(30)]
    texts = [(random.randrange(10**6), " ".join(random.choices(words, k=random.randrange(1, 40)))) for _ in range(700)]
    queries = [[(w.encode(), 1 + i % 2) for i, w in enumerate(random.sample(words, 5))] for _ in range(10)]
    segments = [lexical.Segment(), lexical.Segment()]
    for i, (d, t) in enumerate(texts):
        segments[i % 2].add([d], [t], None)
    docs, total = len(texts), sum(len(t.split()) for _, t in texts)
    df = Counter(w.encode() for _, t in texts for w in set(t.split()))
    weights = {t: lexical.weight_of(docs, n) for t, n in df.items()}
    harvest = lexical.Harvest(len(queries), 7)
    kept = lexical.WINDOW
    lexical.WINDOW = 64
    try:
        for s in segments:
            lexical.score_segment(s.batch().to_pylist()[0], queries, weights, docs, total, harvest)
    finally:
        lexical.WINDOW = kept
    for q, terms in enumerate(queries):
        want = brute_search({0: [" ".join(w.decode() for w, n in terms for _ in range(n))]}, texts, 7)
        assert sorted(((-s, -d) for s, d in harvest.heaps[q])) == sorted((-s, d) for _, _, d, s in want)


def test_impacts_beyond_64_bits():
    assert lexical.impacts(np.array([3]), np.array([10**10]), 2, 10**9, 10**12).tolist() == [2 * ((3 * 10**9) // (3000 + 12 * (75 + 25 * 10**19 // 10**12)))]


def plain_codes(data, parts=8, entries=16, rounds=6):
    """[(id, vector, label)] of good vectors of one length -> sorted rows."""
    data = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(4096 * x) for x in v] for _, v, _ in data]
    dim = len(ints[0])
    cut = [[v[p * dim // parts : (p + 1) * dim // parts] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        near = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, n in zip(cut, near, strict=True) if n[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = nearest()
    errors = [sum(far(c[p], books[p][n[p]]) for p in range(parts)) for c, n in zip(cut, near, strict=True)]
    sums = Counter()
    for (_, _, label), e in zip(data, errors, strict=True):
        sums[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{x:02x}" for x in n), e, sums[label], digest) for (i, _, label), n, e in zip(data, near, errors, strict=True)], key=repr)


def coded(df):
    return sorted([(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()], key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, code int, dim int, near string"


def test_vector_codes(spark):
    random.seed(11)
    good = [(i, [float(np.float32(random.gauss(0, 1) + (i % 5))) for _ in range(16)], i % 3 if i % 7 else None) for i in range(300)]
    good += good[:3] + [(None, good[9][1], 1)] + [(1000 + i, good[0][1], 2) for i in range(50)] + [(2000 + i, [float(i % 2)] * 16, 2) for i in range(40)]
    bad = [(5000, None, 1), (5001, [], 1), (5002, [1.0] * 15 + [NAN], 1), (5003, [INF] + [1.0] * 15, 1), (5004, [None] + [1.0] * 15, 1), (5005, [1e20] * 16, 1)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in good + bad], SCHEMA).repartition(3)
    costs = []
    found = vector_codes.encode_vectors(df, costs=costs)
    assert coded(found) == plain_codes(good)
    assert len(costs) == 7 and costs[-1] < 0.6 * costs[0]


def test_vector_codes_of_other_lengths(spark):
    random.seed(5)
    three = [(i, [random.random() for _ in range(3)], 1) for i in range(9)]
    ten = [(100 + i, [random.random() * 4 for _ in range(10)], 1) for i in range(40)]
    three, ten = ([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows] for rows in (three, ten))
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in three + ten], SCHEMA)
    found = coded(vector_codes.encode_vectors(df))
    a, b = plain_codes(three), plain_codes(ten)
    together = a[0][3] + b[0][3]
    assert found == sorted([(i, c, e, together, d) for i, c, e, _, d in a + b], key=repr)
    none = vector_codes.encode_vectors(df.limit(0))
    assert none.collect() == [] and none.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_yinyang_equals_full_scans_with_ties():
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (500, 2))
    entries = rng.integers(-3, 4, (16, 2))
    entries[3] = entries[12]
    group = vector_codes.grouped(entries)
    near, upper, lower = np.zeros(500, np.uint8), np.full(500, np.inf, np.float32), np.full((500, group.max() + 1), -np.inf, np.float32)
    drift = np.zeros(16)
    for _ in range(8):
        vector_codes.assign(x, entries, group, drift, near, upper, lower)
        assert (near == ((x[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()
        before, entries = entries, entries + rng.integers(-1, 2, (16, 2))
        drift = np.nextafter(np.sqrt(((entries - before) ** 2).sum(1).astype(float)), np.inf)


TEXTS = ["hi", "", "\\", "\\\\", "### ", "</turn>", " </turn>\n", "\\### Assistant: </turn> ok", "a\\</turn>", "### user: x </turn>\n### ", "é☃\U0001f600 \n", "<", "</turn", "####  #", "a" * 70_000]


def test_turns_are_read_as_written():
    for role in ["user", "", "a: b", "### ", "\\:", "x\n</turn>"]:
        for text in TEXTS:
            assert chat.parse_turn("".join(chat.turn_pieces(role, text))) == (role, text)
    for a in TEXTS[1:13]:
        for b in TEXTS[1:13]:
            assert chat.parse_turn("".join(chat.turn_pieces(a, b + a))) == (a, b + a)
    with pytest.raises(ValueError):
        chat.parse_turn("### user: a </turn>\n### user: b </turn>\n")


@pytest.fixture(scope="module")
def turns(spark):
    random.seed(2)
    rows = []
    for c in range(60):
        first = ["Be kind.", "Be brief.", TEXTS[c % len(TEXTS)]][c % 3]
        rows += [(c, 0, "system", first), (c, 1, "user", TEXTS[c % 4]), (c, 2, "assistant", TEXTS[c % 6])]
        rows += [(c, 3 + n, random.choice(["user", "assistant"]), random.choice(TEXTS[:-1])) for n in range(random.randrange(4))]
    rows += [(100 + c, t, "assistant" if t % 2 else "user", f"copy {t}") for c in range(40) for t in range(4)]
    rows += [(200, 0, None, None), (200, 1, "assistant", None), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (201, None, "assistant", "early"), (201, 0, "user", "late")]
    rows += [(202, 0, "user", "twice"), (202, 0, "user", "twice"), (203, 0, "user", "copy 0")]
    schema = "conv_id long, turn long, role string, text string, pack long, place int, idx int, shared int, start int, ids int, key string, digest string"
    return spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1, "k", "d") for r in rows], schema).repartition(5), rows


def plain_chats(rows):
    out = []
    for conv in {r[0] for r in rows}:
        said = sorted((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv)
        learnt = "".join(x for _, r, x in said if r == "assistant")
        formatted = sum(len("".join(chat.turn_pieces(r, x))) for _, r, x in said)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in said)
        out.append((conv, len(said), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), formatted))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pack_bytes,walked", [(2**20, True), (400, False)])
def test_chats_read_back(spark, turns, tokenizer, pack_bytes, walked):
    df, rows = turns
    formatted = chat.format_chats(df, *tokenizer, pack_bytes=pack_bytes)
    found = chat.read_back(formatted, *tokenizer, walked=walked)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_chats(rows)


def test_chat_tree(turns, tokenizer):
    """Every distinct prefix once in a pack; positions and intervals give each conversation its own ids in order."""
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    df, rows = turns
    found = [r.asDict() for r in chat.format_chats(df, *tokenizer, pack_bytes=5000).collect()]
    codec = tiktoken.Encoding("x", pat_str=tokenizer[1], mergeable_ranks=load_tiktoken_bpe(tokenizer[0]), special_tokens={})
    encode = lambda pieces: [i for p in pieces for i in codec.encode_ordinary(p)]
    emitted, distinct = 0, set()
    for pack in {r["pack"] for r in found}:
        own = sorted((r for r in found if r["pack"] == pack), key=lambda r: (r["place"], r["idx"]))
        stream, loss, position = [], [], []
        for r in own:
            assert r["start"] == len(stream)
            stream += r["ids"]
            position += range(r["position"], r["position"] + len(r["ids"]))
            loss += [r["loss_from"] <= i < r["loss_to"] for i in range(len(r["ids"]))]
        prefixes = set()
        for end in (r for r in own if r["idx"] == chat.END):
            said = sorted((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == end["conv"])
            seen = [i for span in end["attends"] for i in range(span["start"], span["end"])]
            assert [stream[i] for i in seen] == encode([p for _, r, x in said for p in chat.turn_pieces(r, x)])
            assert [position[i] for i in seen] == list(range(len(seen)))
            learnt = codec.decode([stream[i] for i in seen if loss[i]])
            assert learnt == "".join(chat.escaped(x) for _, r, x in said if r == "assistant")
            assert end["depth"] == len(said)
            prefixes |= {tuple(x[1:] for x in said[: n + 1]) for n in range(len(said))}
        turns_here = [r for r in own if r["idx"] != chat.END]
        assert len(turns_here) == len(prefixes)
        for r in turns_here:
            assert sum(s["end"] - s["start"] for s in r["attends"]) == r["position"]
        emitted += len(turns_here)
        distinct |= prefixes
    assert len(distinct) <= emitted < len(rows)


def test_chats_of_nothing(spark, turns, tokenizer):
    assert chat.read_back(chat.format_chats(turns[0].limit(0), *tokenizer), *tokenizer).collect() == []
