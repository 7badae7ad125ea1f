"""Operator 11: ranked lexical search that scores postings in fixed windows of documents."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.common import checkpointed, small_batches, table, with_offsets, written

#: Documents whose scores are added up at once: an array of so many integers stays in a core's cache.
WINDOW = 8192
#: Documents and postings of one segment, about.
SEGMENT_DOCS, SEGMENT_POSTINGS = 4 * WINDOW, 2_000_000
#: Different terms, and their bytes, that the index is narrowed to; beyond them it holds all terms.
VOCABULARY, VOCABULARY_BYTES = 2**17, 2**23
#: Terms of the queries of one block, about: what one pass over the index answers.
BLOCK_TERMS = 2**17
#: Bytes of a text that are cut into terms at once.
CHUNK = 4_000_000
#: Letters and digits and all bytes of other scripts are kept, A-Z in lower case; every other byte separates.
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def term_counts(text: str) -> Counter:
    """How often each term (as UTF-8) occurs in the whole text."""
    data = text.encode("utf-8", "surrogatepass").translate(_BYTES)
    if len(data) <= CHUNK:
        return Counter(data.split())
    counts: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        counts.update(data[at:end].split())
        at = end
    return counts


class Segment:
    """Documents of a task, and the postings of their terms."""

    def __init__(self):
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.posted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.postings = 0

    def add(self, ids: list[int], texts: list[str], wanted: frozenset[bytes] | None) -> None:
        number, slot, tf = [], [], []
        for doc_id, text in zip(ids, texts, strict=True):
            counts = term_counts(text)
            if not counts:
                continue
            here = counts.keys() if wanted is None else counts.keys() & wanted
            number += [self.terms.setdefault(t, len(self.terms)) for t in here]
            tf += [counts[t] for t in here]
            slot += [len(self.ids)] * len(here)
            self.ids.append(doc_id)
            self.lengths.append(counts.total())
        self.posted.append((np.array(number, np.int32), np.array(slot, np.int32), np.array(tf, np.int32)))
        self.postings += len(number)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.postings >= SEGMENT_POSTINGS

    def batch(self) -> pa.RecordBatch:
        """The segment as a row: slots in the order of the ids, postings in the order of terms and slots."""
        number, slot, tf = (np.concatenate(x) for x in zip(*self.posted, strict=True))
        ids = np.array(self.ids, np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        slot = place[slot]
        sort = np.lexsort((slot, number))
        df = np.bincount(number, minlength=len(self.terms))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([len(ids)], pa.int64()), pa.array([sum(self.lengths)], pa.int64()), pa.array([list(self.terms)], pa.list_(pa.binary())),
                pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([ids[order].tobytes()], pa.binary()),
                pa.array([np.array(self.lengths, np.int64)[order].tobytes()], pa.binary()), pa.array([slot[sort].tobytes()], pa.binary()), pa.array([tf[sort].tobytes()], pa.binary()),
            ],
            ["docs", "words", "terms", "dfs", "ids", "lengths", "slots", "tfs"],
        )


_SEGMENT = "docs long, words long, terms array<binary>, dfs array<bigint>, ids binary, lengths binary, slots binary, tfs binary"


def index_texts(docs: DataFrame, wanted: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An inverted index of all documents in segments, narrowed to the ``wanted`` terms if given.

    A segment holds the documents that a task has read, some ten thousand, in the order of their ids. Texts are not moved. A row:
    ``docs``, ``words`` (all terms with repeats), ``terms`` with ``dfs`` (documents of each), ``ids`` and ``lengths`` of the documents, ``slots`` and ``tfs`` (postings, term by term).
    Rows with a null id, and texts that are null or without a term, are not documents.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Segment()
        for batch in batches:
            held.add(batch.column("id").to_pylist(), batch.column("text").to_pylist(), wanted)
            if held.full():
                yield held.batch()
                held = Segment()
        if held.ids:
            yield held.batch()

    return rows.mapInArrow(build, _SEGMENT)


def impacts(tf: np.ndarray, length: np.ndarray, weight: int, docs: int, words: int) -> np.ndarray:
    """What a term adds to the documents of its postings, in 64-bit integers."""
    top = 25 * int(length.max(initial=0)) * docs
    share = (25 * length * docs) // words if top < 2**63 else np.array([(25 * int(n) * docs) // words for n in length], np.int64)
    m = 100 - 25 + share
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def weight_of(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Harvest:
    """The best documents of each query so far: a heap of (score, -id), its worst on top."""

    def __init__(self, queries: int, k: int):
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(queries)]
        self.k = k

    def take(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        heap = self.heaps[query]
        least = max(1, heap[0][0]) if len(heap) == self.k else 1
        good = np.flatnonzero(scores >= least)
        if len(good) > self.k:
            good = good[np.lexsort((ids[good], -scores[good]))[: self.k]]
        for score, doc_id in zip(scores[good].tolist(), ids[good].tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -doc_id))
            elif (score, -doc_id) > heap[0]:
                heapq.heapreplace(heap, (score, -doc_id))


def score_segment(row: dict, queries: list[list[tuple[bytes, int]]], weights: dict[bytes, int], docs: int, words: int, harvest: Harvest) -> None:
    """Add up all queries over one segment, window by window.

    In a window each query's postings are scattered into one array of scores; the bit set of the slots that its terms
    occupy is put together from the terms' own; the occupied slots are harvested and set to 0 again.
    """
    ids, length = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
    slots, tfs = np.frombuffer(row["slots"], np.int32), np.frombuffer(row["tfs"], np.int32)
    windows = np.arange(0, len(ids) + WINDOW, WINDOW)
    postings: dict[bytes, tuple[np.ndarray, np.ndarray, list[int]]] = {}
    at = 0
    for term, df in zip(row["terms"], row["dfs"], strict=True):
        if term in weights:
            slot = slots[at : at + df]
            postings[term] = slot, impacts(tfs[at : at + df].astype(np.int64), length[slot], weights[term], docs, words), np.searchsorted(slot, windows).tolist()
        at += df
    asked = [(q, [(t, n) for t, n in terms if t in postings]) for q, terms in enumerate(queries)]
    score = np.zeros(WINDOW, np.int64)
    for w in range(len(windows) - 1):
        base = w * WINDOW
        local: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for term, (slot, gain, cut) in postings.items():
            if cut[w] < cut[w + 1]:
                here = slot[cut[w] : cut[w + 1]] - base
                there = np.zeros(WINDOW, bool)
                there[here] = True
                local[term] = here, gain[cut[w] : cut[w + 1]], np.packbits(there)
        for q, terms in asked:
            occupied = np.zeros(WINDOW // 8, np.uint8)
            for term, times in terms:
                if term in local:
                    here, gain, bits = local[term]
                    score[here] += gain * times
                    occupied |= bits
            found = np.flatnonzero(np.unpackbits(occupied))
            if len(found):
                harvest.take(q, score[found], ids[base + found])
                score[found] = 0


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term, times) of every query; rows of one id are one query."""
    rows = items.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text").to_pylist(), strict=True):
                counts = term_counts(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * len(counts), item.type), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["item", "term", "times"]
                )

    return rows.mapInArrow(cut, f"item {kind}, term binary, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))


def search(
    items: DataFrame, docs: DataFrame, k: int = 20, item_col: str = "item_id", query_col: str = "text", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The ``k`` highest-scoring documents for each query, of all documents, exactly.

    Terms are the runs of letters, digits and other scripts' characters, A-Z in lower case. A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); it adds weight * (10^9 tf div
    (1000 tf + 12 m)) with m = 75 + (25 n N) div L, once for each time that the query says it. N documents have a term, L terms in all, n in this one.

    One pass over the texts writes segments of an index (``index_texts``), narrowed to the queries' terms while these are few enough to be sent to
    every task; N, L and df come from the segments. Then each block of queries is scored in a pass over the segments (``score_segment``): postings are traversed in fixed windows of documents in the order
    of their ids, scores are scattered into an array that fits a cache beside a bit set of the slots in use, and these are harvested into a heap. A task keeps one heap
    of ``k`` for each query over all its segments, so what is ranked at the end does not grow with the documents of a task.

    Returns item, ``rank`` (from 1), id and ``score``; equal scores by ascending id. Documents that score 0 are not returned. Rows with a null id, on either side, take no part;
    a null text has no terms. Rows of one query's id are one query with the terms of all; rows of one document's id are
    documents of their own. Without documents or queries the result is empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = checkpointed(query_terms(items, item_col, query_col))
    distinct = asked.select("term").distinct()
    n_terms, n_bytes = distinct.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    few = n_terms <= VOCABULARY and (n_bytes or 0) <= VOCABULARY_BYTES
    wanted = frozenset(bytes(t) for t in distinct.toArrow().column("term").to_pylist()) if few else None
    segments = written(index_texts(docs, wanted, id_col, text_col))
    n, words = segments.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    posted = segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("of")).agg(F.sum("x.dfs").alias("df"))

    sizes = asked.groupBy("item").agg(F.count("*").alias("size")).withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(1024)))
    blocks = checkpointed(with_offsets(sizes, "bucket", ["item"], {"size": "before"}).select(F.col("item").alias("of_item"), F.expr(f"before div {BLOCK_TERMS}").alias("block")))
    numbered = asked.join(blocks, F.col("item") == F.col("of_item")).join(posted, F.col("term") == F.col("of"))
    last = blocks.agg(F.max("block")).first()[0]
    if last is not None and last > 0:
        numbered = written(numbered.select("block", "item", "term", "times", "df"))
    best = None
    for block in range(0 if last is None else last + 1):
        # as many rows as a block may hold, and one query more
        held = numbered.where(F.col("block") == block).select("item", "term", "times", "df").toArrow()
        terms = held.to_pylist()
        found = segments.mapInArrow(_scorer(terms, n, words, k), "query int, id long, score long")
        names = sorted({t["item"] for t in terms})
        named = spark.createDataFrame(pa.table({"at": pa.array(range(len(names)), pa.int32()), "item": pa.array(names, held.schema.field("item").type)}))
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        # one row for each query of the block
        one = ranked.join(F.broadcast(named), F.col("query") == F.col("at")).select("item", "rank", "id", "score")
        one = written(one) if last else one
        best = one if best is None else best.union(one)
    if best is None:
        best = asked.limit(0).select("item", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score"))
    return best.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _scorer(terms: list[dict], docs: int, words: int, k: int):
    place = {item: i for i, item in enumerate(sorted({t["item"] for t in terms}))}
    queries: list[list[tuple[bytes, int]]] = [[] for _ in place]
    weights = {bytes(t["term"]): weight_of(docs, t["df"]) for t in terms}
    for t in terms:
        if weights[bytes(t["term"])] > 0:
            queries[place[t["item"]]].append((bytes(t["term"]), t["times"]))
    weights = {t: w for t, w in weights.items() if w > 0}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        harvest = Harvest(len(queries), k)
        for batch in batches:
            for i in range(len(batch)):
                score_segment(batch.slice(i, 1).to_pylist()[0], queries, weights, docs, words, harvest)
        rows = [(q, -doc, s) for q, heap in enumerate(harvest.heaps) for s, doc in heap]
        q, doc, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(doc, pa.int64()), pa.array(s, pa.int64())], ["query", "id", "score"])

    return score


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with words as materialized (
  select row_number() over () as nth, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null and doc_id is not null
), docs as materialized (
  select nth, doc_id, len(terms) as n from words where len(terms) > 0
), total as (
  select count(*) as n_docs, cast(sum(n) as bigint) as n_words from docs
), tfs as materialized (
  select nth, term, count(*) as tf from (select nth, unnest(terms) as term from words) group by nth, term
), asked as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark where item_id is not null and text is not null
  ) group by item_id, term
), weights as (
  select term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / (2 * count(*) + 1))) as bigint) as w from tfs, total group by term, n_docs
), scored as (
  select item_id, d.nth, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_words)))) as score
  from asked a join weights using (term) join tfs t using (term) join docs d on t.nth = d.nth cross join total
  group by item_id, d.nth, doc_id
)
select item_id, cast(rank as int) as rank, doc_id, cast(score as bigint) as score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
) where rank <= 20
"""
