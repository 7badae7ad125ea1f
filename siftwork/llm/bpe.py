"""Operator 3: byte-level BPE encoding and decoding by segment trees over byte positions."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.common import small_batches, table

#: A rank that no pair has.
NONE = np.int32(2**31 - 1)
#: Distinct matches that a worker remembers before it starts anew, and bytes of text it flattens at once.
REMEMBERED = 400_000
CHUNK_BYTES = 4_000_000
#: Matches up to so many bytes are merged many at a time.
SHORT = 64


class Vocabulary:
    """Ranks of a byte-level vocabulary: id of each byte string, and the merge of each pair of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.by_id = [b""] * size
        for token, rank in self.ranks.items():
            self.by_id[rank] = token
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {
            (self.ranks[t[:i]], self.ranks[t[i:]]): r
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        }
        self.merge = pairs
        self._hash(np.array([(a << 32) | b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int32))
        lengths = np.array([len(t) for t in self.by_id], np.int64)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(self.by_id), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing over 2^20 slots; more would be needed for a vocabulary of over 700,000 pairs."""
        if len(keys) > 700_000:
            raise ValueError("too many pairs for the merge table")
        self.keys, self.values = np.full(1 << 20, -1, np.int64), np.full(1 << 20, NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            spots, first = np.unique(at[left], return_index=True)
            free = self.keys[spots] == -1
            chosen = left[first[free]]
            self.keys[spots[free]], self.values[spots[free]] = keys[chosen], values[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
            at[left] = (at[left] + 1) & 0xFFFFF

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NONE`` where the pair does not merge."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        out, open_ = np.full(len(keys), NONE, np.int32), np.arange(len(keys))
        while len(open_):
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
            at[open_] = (at[open_] + 1) & 0xFFFFF
        return out

    def encode_long(self, piece: bytes) -> list[int]:
        """One match by a segment tree whose leaf i holds the rank of the pair that starts at byte i."""
        n, none, merge = len(piece), int(NONE), self.merge
        token, after, prior = [int(self.byte_id[b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << (n - 1).bit_length()
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = merge.get((token[i], token[i + 1]), none)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, rank: int) -> None:
            i += size
            tree[i] = rank
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        while (rank := tree[1]) != none:
            at = 1
            while at < size:
                at = 2 * at if tree[2 * at] <= tree[2 * at + 1] else 2 * at + 1
            at -= size
            gone = after[at]
            token[at], after[at] = rank, after[gone]
            if after[at] < n:
                prior[after[at]] = at
            put(gone, none)
            put(at, merge.get((rank, token[after[at]]), none) if after[at] < n else none)
            if prior[at] >= 0:
                put(prior[at], merge.get((token[prior[at]], rank), none))
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def encode_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many matches of at most ``SHORT`` bytes: the same tree for each, all merged in step."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        size = 1 << int(lengths.max() - 1).bit_length() if n else 1
        size = max(size, 2)
        rows = np.arange(n)
        live = np.arange(size)[None, :] < lengths[:, None]
        token = np.full((n, size + 1), -1, np.int32)
        token[:, :size][live] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, size + 1), (n, 1))
        prior = np.tile(np.arange(-1, size), (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int32)
        has = live[:, 1:]
        tree[:, size : 2 * size - 1][has] = self.pair_ranks(token[:, : size - 1][has], token[:, 1:size][has])
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        alive = live.copy()

        def put(r: np.ndarray, at: np.ndarray, rank: np.ndarray | np.int32) -> None:
            at = at + size
            tree[r, at] = rank
            for _ in range(size.bit_length() - 1):
                at = at >> 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

        r = rows[tree[:, 1] != NONE]
        while len(r):
            rank = tree[r, 1]
            at = np.ones(len(r), np.int64)
            for _ in range(size.bit_length() - 1):
                at = 2 * at + (tree[r, 2 * at] > tree[r, 2 * at + 1])
            at -= size
            gone = after[r, at]
            then = after[r, gone]
            token[r, at], after[r, at] = rank, then
            prior[r, then] = at
            alive[r, gone] = False
            put(r, gone, NONE)
            # past the end stands a token -1, which merges with nothing
            inside = then < lengths[r]
            put(r, at, np.where(inside, self.pair_ranks(rank, token[r, np.minimum(then, size)]), NONE))
            back = prior[r, at]
            before = back >= 0
            put(r[before], back[before], self.pair_ranks(token[r[before], back[before]], rank[before]))
            r = r[tree[r, 1] != NONE]
        return token[:, :size][alive], alive.sum(1)

    def encode_matches(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the matches, end to end, and how many each has."""
        return self.encode_pieces([m.encode("utf-8", "surrogatepass") for m in matches])

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.ones(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        for i in np.flatnonzero((whole < 0) & (sizes > SHORT)).tolist():
            ids = np.array(self.encode_long(pieces[i]), np.int32)
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        depth = np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        for d in range(1, SHORT.bit_length()):
            members = np.flatnonzero((whole < 0) & (sizes <= SHORT) & (depth == d))
            for lo in range(0, len(members), 20_000):
                part = members[lo : lo + 20_000]
                ids, counts[part] = self.encode_short([pieces[i] for i in part.tolist()])
                parts.append((part, ids))
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for members, ids in parts:
            n = counts[members]
            ends = np.cumsum(n)
            flat[np.arange(len(ids)) + np.repeat(starts[members] - (ends - n), n)] = ids
        return flat, counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return ragged(self.flat, self.starts[ids], self.lengths[ids]).tobytes()


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[start : start + length], end to end."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Matches(dict):
    """Numbers the distinct matches of a worker and holds their ids in one flat array."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.fresh: list[str] = []
        self.flat = np.empty(0, np.int32)
        self.starts = self.counts = np.empty(0, np.int64)

    def __missing__(self, match: str) -> int:
        self[match] = n = len(self)
        self.fresh.append(match)
        return n

    def settle(self) -> None:
        if not self.fresh:
            return
        ids, counts = self.vocabulary.encode_matches(self.fresh)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, ids])
        self.fresh = []


class Encoder:
    """Encodes texts match by match; a match is merged once and then looked up."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.pattern = Vocabulary(path), regex.compile(pattern)
        self.matches = Matches(self.vocabulary)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has."""
        if len(self.matches) > REMEMBERED:
            self.matches = Matches(self.vocabulary)
        known, find = self.matches, self.pattern.findall
        numbers = []
        for t in texts:
            found = find(t)
            numbers.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
        known.settle()
        flat = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        counts = known.counts[flat]
        ids = ragged(known.flat, known.starts[flat], counts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.cumsum([0, *map(len, numbers)])
        return ids, np.diff(ends[at])


    def lengths(self, texts: list[str]) -> list[int]:
        """How many ids each text has."""
        out = []
        for lo, hi in in_chunks(texts):
            if len(self.matches) > REMEMBERED:
                self.matches = Matches(self.vocabulary)
            known, find = self.matches, self.pattern.findall
            numbers = [np.fromiter(map(known.__getitem__, m := find(t)), np.int64, len(m)) for t in texts[lo:hi]]
            known.settle()
            out += [int(known.counts[x].sum()) for x in numbers]
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary; it lives as long as the worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def in_chunks(texts: list[str], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``most`` characters; a longer text stands alone."""
    lo = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, and the bytes that they decode to.

    Each match of ``pattern`` is encoded by itself. A match that is itself in the vocabulary is one id.
    Otherwise a segment tree over its byte positions holds the rank of the pair that starts at each live
    position; the leftmost minimum is merged and the leaves of its live neighbours are updated, until no
    pair merges. Matches recur, so a worker merges each distinct match once (a bounded number of them)
    and looks up the rest; short matches are merged many at a time, with the same tree for each.

    Returns one row per input row: id, ``ids`` (array of int), ``decoded`` (binary). A null text counts
    as empty and gives no ids and no bytes. Rows are independent: repeated ids stay repeated, an empty
    table gives an empty result, and other columns are ignored. No special tokens are recognised.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in in_chunks(texts):
                ids, counts = codec.encode(texts[lo:hi])
                ends = np.concatenate([[0], np.cumsum(counts)])
                sizes = codec.vocabulary.lengths[ids]
                at = np.concatenate([[0], np.cumsum(sizes)])[ends]
                offsets = pa.py_buffer(at.astype(np.int32))
                decoded = pa.Array.from_buffers(
                    pa.binary(), hi - lo, [None, offsets, pa.py_buffer(codec.vocabulary.decode(ids))]
                )
                listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), listed, decoded], ["id", "ids", "decoded"]
                )

    out = source.mapInArrow(encode, f"id {id_type}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    encoded = encode_texts(
        table(spark, sf_dir, "documents"),
        tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        tokenizers.PATTERN,
    )
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
