"""Operator 9: exact Jaccard join on word shingles through a token-group matrix."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.bpe import in_chunks, ragged
from siftwork.llm.common import checkpointed, removed, shuffles_dropped, small_batches, sortable, table, unsorted, written
from siftwork.llm.components import connected_components
from siftwork.llm.shingles import mix, set_digests, shingle_sets

SHINGLE_WORDS = 5
#: A token in so many documents or more is common: it stands last in the order of tokens.
COMMON = 32
#: Bits of the maps that every task gets: tokens of two documents or more (16 to 64 MB), common tokens (2 MB), opened documents.
MAP_BITS = 27
MOST_MAP_BITS = 29
COMMON_BITS = 24
OPEN_BITS = 26
#: Documents to which the smallest map of repeated tokens is dealt, about: with more it doubles, so it does not fill up.
MAP_DOCS = 1 << 18
#: Bits of a token's hash that are counted, and those that the index holds.
COUNT_BITS = 40
INDEX_BITS = 48
#: Index tokens that a task holds before it sends them on.
INDEX_HELD = 600_000
#: Documents whose tokens are counted in one bucket, about.
BUCKET_DOCS = 1024
#: Sets of one group that one task opens.
GROUP_CHUNK = 1024
#: Tokens of the sets that one task opens, about (12 MB).
CHUNK_TOKENS = 2_000_000
#: Queries that meet a chunk in one place, about, and their tokens.
CHUNK_QUERIES = 2048
CHUNK_CHARS = 600_000
#: One more index token for so many tokens of a set; linked sets share as many of them.
EVIDENCE = 10


class BitMap:
    """Bits of a fixed number, a power of 2; it travels compressed, as most are alike."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw

    def __getstate__(self) -> bytes:
        return zlib.compress(self.raw.tobytes(), 1)

    def __setstate__(self, packed: bytes) -> None:
        self.raw = np.frombuffer(zlib.decompress(packed), np.uint8)

    def has(self, at: np.ndarray) -> np.ndarray:
        return (self.raw[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def has_hash(self, hashes: np.ndarray) -> np.ndarray:
        """The bit that the highest bits of each 64-bit hash say."""
        return self.has(hashes >> np.uint64(65 - (8 * len(self.raw)).bit_length()))


def _token_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = batch.column("text").to_pylist()
    for lo, hi in in_chunks(texts, CHUNK_CHARS):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
        yield lo, hi, *shingle_sets(raw, words)


def _widened(raw: bytes, width: int) -> np.ndarray:
    """Little-endian integers of ``width`` bytes."""
    eight = np.zeros((len(raw) // width, 8), np.uint8)
    eight[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return eight.view("<u8").ravel()


def _bytes_of(values: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` little-endian bytes for each integer."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _as_gaps(values: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ascending integers as gaps of ``width`` bytes, end to end, and the bounds of the runs in these.

    A run's first gap is from 0. A gap of all ones stands for itself and is no value's end: larger gaps take several.
    """
    most = np.uint64((1 << 8 * width) - 1)
    gaps = np.diff(values, prepend=values[:1])
    gaps[starts] = values[starts]
    more = (gaps // most).astype(np.int64)
    ends = np.cumsum(more + 1)
    out = np.full(ends[-1], most, np.uint64)
    out[ends - 1] = gaps % most
    return _bytes_of(out, width), np.append((ends - more - 1)[starts], ends[-1])


def _from_gaps(runs: list[bytes], width: int) -> np.ndarray:
    """The values of runs that ``_as_gaps`` made, run by run."""
    gaps = _widened(b"".join(runs), width)
    lengths = np.array([len(r) // width for r in runs], np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gaps)])
    values = sums[1:] - np.repeat(sums[np.cumsum(lengths) - lengths], lengths)
    return values[gaps != np.uint64((1 << 8 * width) - 1)]


def _bucket_bits(n_docs: int) -> int:
    """Bits of a token's hash that say its bucket, so that a bucket gets a bounded number of documents' tokens."""
    return int(np.clip(np.ceil(np.log2(max(1, n_docs / BUCKET_DOCS))), 8, COMMON_BITS - 3))


def _map_bits(n_docs: int) -> int:
    return int(np.clip(MAP_BITS + np.ceil(np.log2(max(1, n_docs / MAP_DOCS))), MAP_BITS, MOST_MAP_BITS))


def token_maps(texts: DataFrame, words: int, n_docs: int) -> tuple[BitMap, BitMap]:
    """Two bit maps over all token hashes: in two documents or more, and common.

    Every token is counted over all documents, by 40 bits of its hash, in buckets of a
    bounded number of documents. The maps have a bounded size; where tokens share a bit the bit is set if
    it is for either. Both maps only order and thin the index: any maps give the same links.
    """
    bits, map_bits = _bucket_bits(n_docs), _map_bits(n_docs)
    low = np.uint64(COUNT_BITS - bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            # a document's tokens are distinct, so equal ones here are from different documents; beyond COMMON
            # of them more say nothing new
            prints = np.sort(np.concatenate(held))
            held.clear()
            if len(prints) > COMMON:
                prints = prints[np.append(np.full(COMMON, True), prints[COMMON:] != prints[:-COMMON])]
            # the bucket says the highest bits
            bucket = prints >> low
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            three, cuts = _as_gaps(prints & ((np.uint64(1) << low) - np.uint64(1)), starts, 3)
            blobs = [three[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "prints"])

        n = 0
        for batch in batches:
            for _, _, flat, _ in _token_sets(batch, words):
                held.append(flat >> np.uint64(64 - COUNT_BITS))
                n += len(held[-1])
                if n > 800_000:
                    yield packed()
                    n = 0
        if n:
            yield packed()
        pa.default_memory_pool().release_unused()

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = _from_gaps([x for b in batches for x in b.column("prints").to_pylist()], 3)
        prints.sort()
        first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
        df = np.diff(np.append(first, len(prints)))
        maps = []
        for least, size in ((2, map_bits), (COMMON, COMMON_BITS)):
            on = np.zeros(1 << (size - bits), bool)
            on[prints[first[df >= least]] >> np.uint64(COUNT_BITS - size)] = True
            maps.append(pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *maps], ["bucket", "repeated", "common"])

    counted = (
        texts.select("text")
        .mapInArrow(emit, "bucket int, prints binary")
        .groupBy("bucket")
        .applyInArrow(count, "bucket int, repeated binary, common binary")
    )
    whole = {"repeated": np.zeros(1 << (map_bits - 3), np.uint8), "common": np.zeros(1 << (COMMON_BITS - 3), np.uint8)}
    found = counted.toArrow()  # two maps of a bounded size, cut into slices
    for name, bitmap in whole.items():
        for b, part in zip(found.column("bucket").to_pylist(), found.column(name).to_pylist(), strict=True):
            bitmap[b * len(part) : (b + 1) * len(part)] = np.frombuffer(part, np.uint8)
    return BitMap(whole["repeated"]), BitMap(whole["common"])


def _ordered(flat: np.ndarray, counts: np.ndarray, common: BitMap) -> np.ndarray:
    """Each token's rank in its own document: common tokens last, then by hash."""
    last = common.has_hash(flat)
    ends = np.cumsum(counts)
    starts = ends - counts
    n_last = np.concatenate([[0], np.cumsum(last)])
    before_last = n_last[:-1] - np.repeat(n_last[starts], counts)
    usual = np.repeat(counts - (n_last[ends] - n_last[starts]), counts)
    place = np.arange(len(flat)) - np.repeat(starts, counts)
    return np.where(last, usual + before_last, place - before_last)


def _groups(flat: np.ndarray, counts: np.ndarray, repeated: BitMap, common: BitMap) -> np.ndarray:
    """The group of each set that is not empty: its smallest token of a kind that similar sets often have in common.

    Of a set of mostly common tokens it is the smallest common one, so large clusters of near copies stay together. Other
    sets are not grouped by a common token: a passage that documents share would gather them all, however little else they
    share, and a group costs the square of its sets. If most of their other tokens are repeated it is the smallest
    repeated one, so an edit to one of some near copies does not make a group of its own.
    """
    starts = (np.cumsum(counts) - counts)[counts > 0]
    if not len(starts):
        return flat[:0]
    usual, own = ~common.has_hash(flat), repeated.has_hash(flat)

    def smallest(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum.reduceat(np.where(kind, flat, np.uint64(2**64 - 1)), starts), np.add.reduceat(kind.astype(np.int64), starts)

    n = counts[counts > 0]
    (first_common, _), (first_usual, n_usual), (first_own, n_own) = smallest(~usual), smallest(usual), smallest(usual & own)
    return np.where(10 * n_usual <= 4 * n, first_common, np.where(10 * n_own >= 6 * n_usual, first_own, first_usual))


def signatures(texts: DataFrame, words: int, maps) -> DataFrame:
    """Per row: id, hash of the text, set size, set digest and group (40 bits of a hash; sets whose groups share them form one)."""
    id_type = texts.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, common = maps.value
        for batch in batches:
            for lo, hi, flat, counts in _token_sets(batch, words):
                group = np.zeros(hi - lo, np.int64)
                group[counts > 0] = (mix(_groups(flat, counts, repeated, common)) >> np.uint64(24)).view(np.int64)
                digest = pa.array([d.tobytes() for d in set_digests(flat, counts)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(counts), digest, pa.array(group)],
                    ["id", "text_hash", "n", "digest", "grp"],
                )
        pa.default_memory_pool().release_unused()

    return texts.mapInArrow(sign, f"id {id_type}, text_hash long, n long, digest binary, grp long")


def group_index(texts: DataFrame, words: int, percent: int, maps, classes, n_docs: int) -> DataFrame:
    """(grp, token, least, most): the index tokens that two groups or more have, and bounds of the sizes of a group's sets with one.

    The index tokens of a set of n are its first n - ceil(percent n / 100) + e in one order of all tokens,
    with e = 1 + n // EVIDENCE. Of the tokens that two linked sets share, fewer than percent n / 100 - e + 1
    stand behind these, so the first e shared tokens are index tokens of the set; linked sets share the
    smaller e of the two. Tokens that the map knows to be in one document alone are left out, as they
    join nothing, and so are rows that are not in the map of ``classes``, whose sets another row has.

    A token travels as 48 bits of its hash in buckets, 11 bytes with its group and its set's size; sizes from
    65,535 count as any size from there.
    """
    bits = _bucket_bits(n_docs)
    low = np.uint64(INDEX_BITS - bits)
    marked = texts.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(1 << OPEN_BITS))).select("at", "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, common = maps.value
        reps = classes.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            token, grp, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(token, kind="stable")
            token, grp, n = token[order], grp[order], n[order]
            bucket = token >> low
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            four, cuts = _as_gaps(token & ((np.uint64(1) << low) - np.uint64(1)), starts, 4)
            own, sizes, ends = _bytes_of(grp, 5), n.astype("<u2"), np.append(starts[1:], len(token))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[starts].astype(np.int32)),
                    pa.array([four[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([own[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    pa.array([sizes[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                ],
                ["bucket", "tokens", "groups", "sizes"],
            )

        size = 0
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False).astype(np.uint64)
            batch = batch.filter(pa.array(reps.has(at)))
            for lo, hi, flat, counts in _token_sets(batch, words):
                rank = _ordered(flat, counts, common)
                most = counts - -(-counts * percent // 100) + 1 + counts // EVIDENCE
                # what one document alone has joins nothing
                chosen = (rank < np.repeat(most, counts)) & repeated.has_hash(flat)
                group = np.zeros(hi - lo, np.uint64)
                group[counts > 0] = mix(_groups(flat, counts, repeated, common)) >> np.uint64(24)
                held.append(
                    (flat[chosen] >> np.uint64(64 - INDEX_BITS), np.repeat(group, counts)[chosen], np.repeat(np.minimum(counts, 65535), counts)[chosen])
                )
                size += len(held[-1][0])
                if size > INDEX_HELD:
                    yield packed()
                    size = 0
        if size:
            yield packed()
        pa.default_memory_pool().release_unused()

    def shared(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[bytes]] = [[], [], []]
        for batch in batches:
            for column, name in zip(columns, ("tokens", "groups", "sizes"), strict=True):
                column += batch.column(name).to_pylist()
        token, grp = _from_gaps(columns[0], 4), _widened(b"".join(columns[1]), 5)
        n = np.frombuffer(b"".join(columns[2]), "<u2").astype(np.int64)
        order = np.lexsort((grp, token))
        token, grp, n = token[order], grp[order], n[order]
        fresh = np.append(True, token[1:] != token[:-1])
        first = np.flatnonzero(fresh | np.append(True, grp[1:] != grp[:-1]))
        least, most = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
        most[most == 65535] = np.iinfo(np.int32).max
        token, grp, fresh = token[first], grp[first], fresh[first]
        several = ~(fresh & np.append(fresh[1:], True))
        token |= np.uint64(key[0].as_py()) << low
        yield pa.RecordBatch.from_arrays(
            [pa.array(grp[several].view(np.int64)), pa.array(token[several].view(np.int64)), pa.array(least[several]), pa.array(most[several])],
            ["grp", "token", "least", "most"],
        )

    return (
        marked.mapInArrow(emit, "bucket int, tokens binary, groups binary, sizes binary")
        .groupBy("bucket")
        .applyInArrow(shared, "grp long, token long, least long, most long")
    )


def id_map(ids: DataFrame) -> BitMap:
    """A map of a fixed size with the bit of every id of the one column set."""
    bits = (
        ids.select(F.pmod(F.xxhash64(F.col(ids.columns[0]).alias("id")), F.lit(1 << OPEN_BITS)).alias("at"))
        .groupBy(F.expr("at div 32").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << (OPEN_BITS - 5), np.uint32)
    bitmap[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().astype(np.uint32)
    return BitMap(bitmap.view(np.uint8))


def opened_sets(texts: DataFrame, words: int, opened) -> DataFrame:
    """(id, digest, tokens) of the rows whose id is in the map of opened documents.

    A token travels as 48 bits of its hash. In a set two tokens then rarely fall together; where they do,
    the set would seem smaller than it is, so both are kept and a shared one counts once.
    """
    id_type = texts.schema["id"].dataType.simpleString()
    marked = texts.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(1 << OPEN_BITS)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = opened.value
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False).astype(np.uint64)
            batch = batch.filter(pa.array(bitmap.has(at)))
            for lo, hi, flat, counts in _token_sets(batch, words):
                offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(counts) * 6]).astype(np.int32))
                six = _bytes_of(flat >> np.uint64(16), 6).tobytes()
                tokens = pa.Array.from_buffers(pa.binary(), hi - lo, [None, offsets, pa.py_buffer(six)])
                digest = pa.array([d.tobytes() for d in set_digests(flat, counts)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), digest, tokens], ["id", "digest", "tokens"]
                )

    return marked.mapInArrow(sets, f"id {id_type}, digest binary, tokens binary")


class Group:
    """Column of the token-group matrix: the union of some sets' tokens, and who has each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        self.union, self.starts = tokens[first], first
        self.lengths = np.diff(np.append(first, len(tokens)))

    def linked(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Members whose Jaccard similarity with the query reaches the threshold."""
        at = np.searchsorted(self.union, query)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == query]
        # the overlap with any member is at most the overlap with the union
        if 100 * len(at) < percent * len(query):
            return np.empty(0, np.int64)
        both = np.bincount(ragged(self.owner, self.starts[at], self.lengths[at]), minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (self.sizes + len(query) - both))


def _open_group(batches: Iterator[pa.RecordBatch], percent: int, first: bool) -> tuple[list[tuple[bytes, bytes]], dict[bytes, int]]:
    """Links that connect what is linked, and the links of each set, with the weights of the sets at their other ends.

    Members are counted with one another in the first place of their chunk alone, and queries with members where they
    meet: so every linked pair of sets is counted once.
    """
    members: dict[bytes, np.ndarray] = {}
    queries: dict[bytes, np.ndarray] = {}
    weight: dict[bytes, int] = {}
    for batch in batches:
        for d, t, m, w in zip(*(batch.column(c).to_pylist() for c in ("digest", "tokens", "member", "weight")), strict=True):
            (members if m else queries)[d] = _widened(t, 6)
            weight[d] = w
    if not members:
        return [], {}
    names = sorted(members)
    group = Group([members[d] for d in names])
    weights = np.array([weight[d] for d in names], np.int64)
    part, links, counts = np.arange(len(names)), [], np.zeros(len(names), np.int64)
    asked: dict[bytes, int] = {}
    for i, d in enumerate(names if first else []):
        near = group.linked(members[d], percent)
        counts[i] += weights[near].sum() - weights[i]
        for j in near[np.unique(part[near], return_index=True)[1]].tolist():
            if part[i] != part[j]:
                lo, hi = sorted((part[i], part[j]))
                part[part == hi] = lo
                links.append((d, names[j]))
    for d, tokens in queries.items():
        near = group.linked(tokens, percent)
        if len(near):
            asked[d] = int(weights[near].sum())
            counts[near] += weight[d]
        # one link for each part of the group is enough
        for j in near[np.unique(part[near], return_index=True)[1]].tolist():
            links.append((d, names[j]))
    return links, asked | {names[i]: asked.get(names[i], 0) + int(counts[i]) for i in np.flatnonzero(counts)}


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = 75
) -> DataFrame:
    """Connect the documents whose shingle sets have 100 |A n B| >= percent |A u B|; no link is missed.

    Documents with the same smallest token of a kind (see ``_groups``) form a group of a token-group matrix. The index holds, for
    each group, the union of its members' index tokens; two groups that share too few cannot hold a link. Of
    two groups that can, the smaller one's documents go as queries to the larger one. There a task stores
    the union of the members' tokens and bounds a query's overlap with every member by its overlap
    with the union; only if that reaches the threshold does it open the group and count exactly. A
    large group is cut into chunks, so no task holds more than about ``GROUP_CHUNK`` sets (or ``CHUNK_TOKENS`` tokens) and
    ``CHUNK_QUERIES`` queries; equal sets count as one with a weight. Every linked pair of sets is found and counted
    once; of the pairs themselves those that join two parts of a chunk are kept.

    What every task receives has a fixed size (``token_maps`` and the map of opened documents); what is
    joined is ids and groups, and token sets of documents in groups that can hold a link.

    Returns one row per input row: id, ``n_shingles``, ``n_links`` (other rows linked directly), ``component_id``
    (the smallest id that links reach, its own included). A text that is null or has no words has no shingles and links
    with nothing; fewer words than a shingle form one. Rows with a null id link with nothing. Repeated rows stay
    repeated and link with one another; rows that repeat an id with another text are documents of their own. An
    empty table gives an empty result; other columns are ignored.
    """
    with shuffles_dropped(docs.sparkSession):
        return _linked(docs, id_col, text_col, words, percent).select(id_col, "n_shingles", "n_links", "component_id")


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """As ``jaccard_components``, with ``set_digest``, ``text_hash`` and whether the row's set is the first of its component."""
    spark, id_kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    small_batches(spark)
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), body.alias("text"), F.xxhash64(body).alias("text_hash"))
    context = spark.sparkContext
    n_docs = texts.count()
    maps = context.broadcast(token_maps(texts, words, n_docs))
    signed = checkpointed(signatures(texts, words, maps))
    classes = checkpointed(
        signed.where("n > 0 and id is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("grp").alias("grp"))
    )
    groups = classes.groupBy("grp").agg(
        F.count("*").alias("size"), F.sum("n").alias("mass"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    reps = context.broadcast(id_map(classes.select("rep")))
    index = written(group_index(texts, words, percent, maps, reps, n_docs))
    pairs = (
        index.alias("x")
        .join(
            index.alias("y"),
            (F.col("x.token") == F.col("y.token"))
            & (F.col("x.grp") < F.col("y.grp"))
            & (F.col("x.most") * 100 >= F.col("y.least") * percent)
            & (F.col("y.most") * 100 >= F.col("x.least") * percent),
        )
        .groupBy(F.col("x.grp").alias("g"), F.col("y.grp").alias("h"))
        .agg(F.count("*").alias("shared"))
    )
    # enough shared index tokens, one size filter, then the larger group opens
    enough = F.col("shared") > F.expr(f"least(gs.least, hs.least) div {EVIDENCE}")
    fits = (
        enough
        & (F.col("gs.most") * 100 >= F.col("hs.least") * percent)
        & (F.col("hs.most") * 100 >= F.col("gs.least") * percent)
    )
    opens = F.struct(F.col("gs.size"), F.col("g")) > F.struct(F.col("hs.size"), F.col("h"))
    chunks = F.ceil(F.greatest(F.col("size") / GROUP_CHUNK, F.col("mass") / CHUNK_TOKENS)).cast("int")
    pairs = checkpointed(
        pairs.join(groups.alias("gs"), F.col("g") == F.col("gs.grp"))
        .join(groups.alias("hs"), F.col("h") == F.col("hs.grp"))
        .where(fits)
        .select(
            F.when(opens, F.col("g")).otherwise(F.col("h")).alias("opened"),
            F.when(opens, F.col("h")).otherwise(F.col("g")).alias("asks"),
            F.when(opens, F.col("gs.size")).otherwise(F.col("hs.size")).alias("size"),
            F.when(opens, F.col("gs.mass")).otherwise(F.col("hs.mass")).alias("mass"),
            F.when(opens, F.col("gs.least")).otherwise(F.col("hs.least")).alias("least"),
            F.when(opens, F.col("gs.most")).otherwise(F.col("hs.most")).alias("most"),
        )
    )
    removed(index)
    own_chunk = F.pmod(F.xxhash64("digest"), F.col("n_chunks"))
    candidates = pairs.select("opened", chunks.alias("n_chunks")).union(groups.where("size > 1").select("grp", chunks))
    members = classes.join(candidates.distinct(), F.col("grp") == F.col("opened")).select(
        "opened", own_chunk.cast("int").alias("chunk"), "rep", "digest", "weight", "n", "n_chunks"
    )
    queries = (
        pairs.join(classes, F.col("asks") == F.col("grp"))
        .where((F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent))
        .select("opened", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "rep", "digest", "weight", "n")
    )
    across = members.where("chunk + 1 < n_chunks").select(
        "opened", F.explode(F.expr("sequence(chunk + 1, n_chunks - 1)")).alias("chunk"), "rep", "digest", "weight", "n"
    )
    # a chunk with many queries is opened in several places, each with its share of them
    asking = checkpointed(queries.union(across))
    places = asking.groupBy(F.col("opened").alias("o"), F.col("chunk").alias("c")).agg(
        F.ceil(F.greatest(F.count("*") / CHUNK_QUERIES, F.sum("n") / (2 * CHUNK_TOKENS))).cast("int").alias("n_places")
    )
    at_place = (F.col("opened") == F.col("o")) & (F.col("chunk") == F.col("c"))
    spread = members.join(places, at_place, "left").select(
        "opened", "chunk", F.explode(F.sequence(F.lit(0), F.coalesce("n_places", F.lit(1)) - 1)).alias("place"), "rep", "digest", "weight",
        F.lit(True).alias("member"),
    )
    dealt = asking.join(places, at_place).select(
        "opened", "chunk", F.pmod(F.xxhash64("digest", F.lit("place")), F.col("n_places")).cast("int").alias("place"), "rep", "digest", "weight",
        F.lit(False).alias("member"),
    )
    sent = checkpointed(spread.union(dealt))
    opened = context.broadcast(id_map(sent.select("rep")))
    sets = opened_sets(texts, words, opened)
    placed = sent.join(
        sets, (F.col("rep") == F.col("id")) & (sent["digest"] == sets["digest"])
    ).select("opened", "chunk", "place", "member", "weight", sent["digest"].alias("digest"), "tokens")

    def link(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, counts = _open_group(batches, percent, key[2].as_py() == 0)
        ones, others = [x for x, _ in links] + list(counts), [y for _, y in links] + [None] * len(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ones, pa.binary()), pa.array(others, pa.binary()), pa.array([0] * len(links) + list(counts.values()), pa.int64())], ["x", "y", "n"]
        )

    found = checkpointed(placed.groupBy("opened", "chunk", "place").applyInArrow(link, "x binary, y binary, n long"))
    # a set is named by its smallest id, then its digest: the smallest name of a component begins with its smallest id
    named = classes.select("digest", "weight", F.concat(sortable(F.col("rep"), id_kind), F.hex("digest")).alias("name"))
    links = found.where("y is not null").select("x", "y").distinct()
    by_name = links.join(named.select(F.col("digest").alias("x"), F.col("name").alias("a")), "x").join(
        named.select(F.col("digest").alias("y"), F.col("name").alias("b")), "y"
    )
    parts = connected_components(by_name.select("a", "b"))
    first_name = F.coalesce("component", "name")
    counts = found.where("y is null").groupBy(F.col("x").alias("counted")).agg(F.sum("n").alias("links"))
    sets = (
        named.join(parts, F.col("name") == F.col("node"), "left")
        .join(counts, F.col("digest") == F.col("counted"), "left")
        .select(
            F.col("digest").alias("of"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            unsorted(first_name if id_kind == "string" else F.substring(first_name, 1, 20), id_kind).alias("component"),
            F.coalesce(F.col("component") == F.col("name"), F.lit(True)).alias("is_first"),
        )
    )
    has_set = (F.col("digest") == F.col("of")) & (F.col("n") > 0) & F.col("id").isNotNull()
    return signed.join(sets, has_set, "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.col("digest").alias("set_digest"),
        "text_hash",
        F.coalesce("is_first", F.lit(True)).alias("is_first"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows that stand for their group of near duplicates, with all their columns.

    A group keeps the row with its smallest id. Where an id is repeated, rows with the same words count as copies and
    one stays (of texts that differ in other than words, the one with the smallest hash); rows with other words are
    documents of their own. Rows with a null id stay.
    """
    text = options.get("text_col", "text")
    with shuffles_dropped(docs.sparkSession):
        found = _linked(docs, id_col, text, options.get("words", SHINGLE_WORDS), options.get("percent", 75))
        firsts = found.where(F.col("is_first") & (F.col(id_col) == F.col("component_id"))).groupBy(F.col(id_col).alias("__kept"), "set_digest")
        kept = checkpointed(firsts.agg(F.min("text_hash").alias("__text")).select("__kept", "__text"))
    hashed = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    stays = docs.join(kept, (docs[id_col] == kept["__kept"]) & (hashed == kept["__text"]), "left_semi").withColumn("__text", F.xxhash64(F.coalesce(text, F.lit(""))))
    return stays.dropDuplicates([id_col, "__text"]).drop("__text").union(docs.where(F.col(id_col).isNull()))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
