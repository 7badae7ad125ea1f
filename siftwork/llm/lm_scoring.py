"""Operator 7: score texts by a causal self-attention model, beside a count-based base."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.attention import (
    CLASSES, COMMON, FEATURES, GROUPS, LEARNING_RATE, PARTS, WINDOWS_A_STEP, Attention, Subwords, describe_subwords, following, neighbour_keys,
)
from siftwork.llm.bpe import in_chunks, ragged
from siftwork.llm.common import small_batches, table, train_split, written
from siftwork.llm.shingles import hashes_of_spans, mix, word_spans

#: Tokens of the training texts from which one trainer takes the weights that all trainers start with, about.
FIT_TOKENS = 1_000_000
#: Tokens that one trainer learns from, about; trainers grow with the corpus, tasks up to a bound.
TRAINER_TOKENS = 4_000_000
TASKS = 20_000
TRAINED_AT_ONCE = 200_000
RATE = 0.003
#: Subwords whose neighbourhood is summed in one group.
BUCKETS = 8
#: Word counts that every task gets: those of the most frequent words, this many at most (16 MB).
SHARED_WORDS = 1 << 20
REMEMBERED = 2_000_000
CHUNK_CHARS = 800_000
#: Tokens whose keys are made at once, where pairs are counted.
COUNTED_AT_ONCE = 200_000
END_HASH = int(mix(np.array([0x454E44], np.uint64)).view(np.int64)[0])
LOG10 = float(np.log(10))


class Words:
    """Splits texts into words and gives each word's hash and subword ids; remembers distinct words."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.codec = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.spaced = np.zeros(self.end, bool)  # ids that begin with a blank
        self.spaced[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self._forget()

    def _forget(self) -> None:
        # keys of remembered words are sorted; those learnt of late stand apart until they are many, so that learning a
        # few words does not move all the others
        self.keys, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.late, self.late_number = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.flat, self.starts, self.counts = Growing(np.int32), Growing(np.int64), Growing(np.int64)

    def _numbers(self, distinct: np.ndarray) -> np.ndarray:
        """Number of each sorted key, -1 where the word is not remembered."""
        out = np.full(len(distinct), -1, np.int32)
        for keys, number in ((self.keys, self.number), (self.late, self.late_number)):
            if len(keys):
                at = np.searchsorted(keys, distinct)
                at[at == len(keys)] = 0
                known = keys[at] == distinct
                out[known] = number[at[known]]
        return out

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct word hashes, the place of each word among them, words of each text, ids (start and end
        around each text), ids of each text."""
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes: A-Z alone
        flat, begins, stops, bounds = word_spans(raw)
        hashes, counts = hashes_of_spans(flat, begins, stops), np.diff(bounds)
        # equal hashes stand together in this order; any of the words that share one will do
        order = np.argsort(hashes)
        ordered = np.take(hashes, order)
        fresh = np.ones(len(ordered), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
        distinct, some = ordered[fresh], order[fresh]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        if len(self.keys) + len(self.late) > REMEMBERED:
            self._forget()
        numbers = self._numbers(distinct)
        new = numbers < 0
        if new.any():
            text, where = flat.tobytes(), some[new]
            spans = zip(begins[where].tolist(), stops[where].tolist(), strict=True)
            numbers[new] = self._learn([text[a:b] for a, b in spans], distinct[new])
        at = numbers[inverse]
        sizes = np.take(self.counts.held, at)
        ids = ragged(self.flat.held, np.take(self.starts.held, at), sizes)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        lengths = sums[ends] - sums[ends - counts]
        out = np.full(len(ids) + 2 * len(texts), self.end, np.int32)
        shift = np.repeat(2 * np.arange(len(texts)) + 1, lengths)
        out[np.arange(len(ids)) + shift] = ids
        return distinct, inverse, counts, out, lengths + 2

    def _learn(self, words: list[bytes], keys: np.ndarray) -> np.ndarray:
        """Encode the words, remember them under their keys, and return their numbers."""
        found = [w.decode("utf-8", "surrogatepass") for w in words]
        ids = np.array(self.codec.encode_ordinary(" " + " ".join(found)), np.int32)
        begins = np.flatnonzero(self.spaced[ids])  # a blank stands before each word and nowhere else
        if len(begins) != len(found):
            each = [self.codec.encode_ordinary(" " + w) for w in found]
            ids = np.array([i for e in each for i in e], np.int32)
            begins = np.cumsum([0, *map(len, each)])[:-1]
        sizes = np.diff(np.append(begins, len(ids)))
        number = self.starts.size + np.arange(len(found), dtype=np.int32)
        self.starts.add(self.flat.size + np.cumsum(sizes) - sizes)
        self.counts.add(sizes)
        self.flat.add(ids)
        at = np.searchsorted(self.late, keys)
        self.late, self.late_number = np.insert(self.late, at, keys), np.insert(self.late_number, at, number)
        if len(self.late) > 50_000 + len(self.keys) // 8:
            at = np.searchsorted(self.keys, self.late)
            self.keys, self.number = np.insert(self.keys, at, self.late), np.insert(self.number, at, self.late_number)
            self.late, self.late_number = np.empty(0, np.uint64), np.empty(0, np.int32)
        return number


class Growing:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.room, self.size = np.empty(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.room):
            room = np.empty(max(3 * len(self.room) // 2, self.size + len(values)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.size]


_words: dict[tuple[str, str], Words] = {}


def words_of(path: str, pattern: str) -> Words:
    if (path, pattern) not in _words:
        _words[path, pattern] = Words(path, pattern)
    return _words[path, pattern]


def _id_type(words: Words) -> type:
    return np.uint16 if words.end < 1 << 16 else np.int32


class Counter:
    """Sums counts of 64-bit keys and gives them up in parts when they are many."""

    def __init__(self, most: int = 1_500_000):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def add(self, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.held.append((key, n))
        self.size += len(key)
        if self.size <= 2 * self.most:
            return None
        self.held = [self.total()]
        self.size = len(self.held[0][0])
        if self.size <= self.most:
            return None
        self.size = 0
        return self.held.pop()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key, place = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        return key, np.bincount(place, np.concatenate([n for _, n in self.held]), len(key)).astype(np.int64)


def tokenised(train: DataFrame, path: str, pattern: str) -> DataFrame:
    """Everything that is learnt from, after one pass over the training texts, written and read again.

    Rows of kind 0 are texts: ``at`` (a hash of the id), ``ids`` (packed subword ids, start and end included) and
    ``n`` of them. Rows of kind 1 count a word in a part of the texts: ``at`` (its hash) and ``n``; rows of kind 2 a
    subword: ``at`` (its id) and ``n``.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counter, docs = words_of(path, pattern), Counter(), 0
        subwords = np.zeros(words.end + 1, np.int64)

        def packed(kind: int, at, n, ids=None) -> pa.RecordBatch:
            ids = pa.nulls(len(at), pa.binary()) if ids is None else ids
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int8)), pa.array(at, pa.int64()), pa.array(n, pa.int64()), ids], ["kind", "at", "n", "ids"]
            )

        for batch in batches:
            texts, at = batch.column("text").to_pylist(), batch.column("at").to_numpy()
            for lo, hi in in_chunks(texts, CHUNK_CHARS):
                distinct, place, _, ids, lengths = words.split(texts[lo:hi])
                raw = ids.astype(_id_type(words))
                ends = np.concatenate([[0], np.cumsum(lengths)]) * raw.itemsize
                blobs = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                yield packed(0, at[lo:hi], lengths, blobs)
                docs += hi - lo
                subwords += np.bincount(ids, minlength=len(subwords))
                full = counter.add(distinct.view(np.int64), np.bincount(place, minlength=len(distinct)))
                if full is not None:
                    yield packed(1, *full)
        yield packed(1, *counter.total())
        if docs:
            yield packed(1, [END_HASH], [docs])
            yield packed(2, np.flatnonzero(subwords), subwords[subwords > 0])

    at = F.xxhash64("id", F.lit("lm"))
    return written(train.select(at.alias("at"), "text").mapInArrow(split, "kind byte, at long, n long, ids binary"))


def _runs(batches: Iterator[pa.RecordBatch], dtype: type, most: int = COUNTED_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed ids unpacked, in runs of about ``most`` tokens whatever the batches are."""
    held, size = [], 0
    for batch in batches:
        for blob in batch.column("ids").to_pylist():
            held.append(np.frombuffer(blob, dtype))
            size += len(held[-1])
            if size >= most:
                yield np.concatenate(held).astype(np.int32), np.fromiter(map(len, held), np.int64, len(held))
                held, size = [], 0
    if held:
        yield np.concatenate(held).astype(np.int32), np.fromiter(map(len, held), np.int64, len(held))


def _counted(texts: DataFrame, keys_of, size: int, dtype: type) -> DataFrame:
    """(key, n) over all texts: how often ``keys_of(ids, lengths)`` names each key below ``size``.

    A task adds up its texts in one array of that size, in place, so what it emits is bounded by the size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for ids, lengths in _runs(batches, dtype):
            total = np.zeros(size, np.int32) if total is None else total
            np.add.at(total, keys_of(ids, lengths), np.int32(1))
        if total is not None:
            some = np.flatnonzero(total)
            for lo in range(0, len(some), 100_000):
                key = some[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key].astype(np.int64))], ["key", "n"])

    return texts.select("ids").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _dense(counted: DataFrame, size: int) -> np.ndarray:
    """Counts as an array; the caller bounds the size."""
    found, out = counted.toArrow(), np.zeros(size)
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out


def _following_keys(ids: np.ndarray, lengths: np.ndarray, subwords: Subwords) -> np.ndarray:
    """Keys of (row, part that follows), and behind them of (group before, id)."""
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths) - lengths] = False  # starts are not predicted
    left, right = ids[:-1][inner[1:]], ids[1:][inner[1:]]
    part = np.take(subwords.of, right).astype(np.int64) * PARTS + np.take(subwords.part, right)
    pairs = np.take(subwords.row, left).astype(np.int64) * (CLASSES * PARTS) + part
    behind = subwords.rows * CLASSES * PARTS
    return np.concatenate([pairs, behind + np.take(subwords.group, left).astype(np.int64) * len(subwords.row) + right])


def learnt_subwords(parts: DataFrame, end: int, dtype: type) -> Subwords:
    """Classes, parts, rows and what follows them, from the neighbours of each id in all training texts.

    The driver gets one matrix of neighbours by neighbours (a few 100 KB) summed over buckets of ids, the
    coordinates, and the counts of what follows a row: all bounded by the vocabulary and the model.
    """
    context, size = parts.sparkSession.sparkContext, end + 1
    texts = parts.where("kind = 0")
    counts = _dense(parts.where("kind = 2").groupBy(F.col("at").alias("key")).agg(F.sum("n").alias("n")), size)
    if not counts.any():
        counts[end] = 2
    points = spectral_points(texts, counts, dtype)
    subwords = describe_subwords(points, counts)
    shared = context.broadcast(subwords)
    behind = subwords.rows * CLASSES * PARTS
    whole = behind + CLASSES * GROUPS * size
    found = _dense(_counted(texts, lambda i, n: _following_keys(i, n, shared.value), whole, dtype), whole)
    following(subwords, found[:behind].reshape(subwords.rows, -1), found[behind:].reshape(-1, size))
    return subwords


def spectral_points(texts: DataFrame, counts: np.ndarray, dtype: type) -> np.ndarray:
    """Coordinates of each id, from its neighbours in all training texts: zeros where it has none."""
    column = np.full(len(counts), COMMON)
    common = np.argsort(-counts, kind="stable")[:COMMON]
    column[common] = np.arange(len(common))
    wide, context = 2 * (COMMON + 1), texts.sparkSession.sparkContext
    shared = context.broadcast((column, counts))
    keys_of = lambda ids, lengths: neighbour_keys(ids, lengths, shared.value[0])
    near = written(
        _counted(texts, keys_of, len(counts) * wide, dtype).select(
            F.expr(f"cast(key div {wide} as int)").alias("id"), F.expr(f"cast(key % {wide} as int)").alias("side"), "n"
        )
    )

    def table_of(data: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, place = np.unique(data.column("id").to_numpy(), return_inverse=True)
        out = np.zeros((len(ids), wide))
        out[place, data.column("side").to_numpy()] = data.column("n").to_numpy()
        return ids, np.sqrt(out / out.sum(1, keepdims=True))

    def gram(key: tuple, data: pa.Table) -> pa.Table:
        ids, table = table_of(data)
        weight = shared.value[1][ids][:, None]
        whole = np.vstack([(table * weight).T @ table, (table * weight).sum(0)])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "gram": [whole.tobytes()]})

    bucket = F.expr(f"cast(id % {BUCKETS} as long)")
    grams = near.groupBy(bucket.alias("bucket")).applyInArrow(gram, "bucket long, gram binary").orderBy("bucket").collect()
    whole = sum((np.frombuffer(r["gram"]).reshape(wide + 1, wide) for r in grams), np.zeros((wide + 1, wide)))
    total, sums = whole[:-1], whole[-1]
    mean = sums / max(1, counts.sum())
    _, vectors = np.linalg.eigh(total - counts.sum() * np.outer(mean, mean))
    axes = context.broadcast((mean, vectors[:, -FEATURES:]))

    def project(key: tuple, data: pa.Table) -> pa.Table:
        ids, table = table_of(data)
        points = (table - axes.value[0]) @ axes.value[1]
        return pa.table({"id": pa.array(ids, pa.int32()), "point": [p.tobytes() for p in points]})

    found = near.groupBy(bucket).applyInArrow(project, "id int, point binary").orderBy("id").toArrow()
    points = np.zeros((len(counts), FEATURES))
    if len(found):
        points[found.column("id").to_numpy()] = np.frombuffer(b"".join(found.column("point").to_pylist())).reshape(-1, FEATURES)
    return points


def _trainers(texts: DataFrame, trainers: int, model: Attention, dtype: type, rate: float, passes: int, a_step: int, at_once: int) -> list[np.ndarray] | None:
    """Train from the model's weights in ``trainers`` trainers and average their weights by tokens; None without texts.

    A text's trainer and its place there follow from a hash of its id, so the result does not depend on how the
    rows are dealt to partitions. A task adds up the weights of its trainers; sums of parts meet in two steps.
    """
    context, tasks = texts.sparkSession.sparkContext, min(trainers, TASKS)
    shared = context.broadcast((model.subwords, model.weights()))
    cuts = np.cumsum([0, *(w.size for w in model.weights())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, start = shared.value
        total, tokens, own, now, held, size, seen = np.zeros(cuts[-1]), 0, None, None, [], 0, 0

        def some() -> None:
            nonlocal held, size, seen
            if held:
                own.train(np.concatenate(held).astype(np.int32), np.fromiter(map(len, held), np.int64, len(held)), rate, passes, falling=passes > 1, a_step=a_step)
                seen, held, size = seen + size, [], 0

        def close() -> None:
            nonlocal total, tokens, seen
            if own is not None:
                some()
                total += seen * np.concatenate([w.ravel() for w in own.weights()]).astype(np.float64)
                tokens, seen = tokens + seen, 0

        for batch in batches:
            for trainer, blob in zip(batch.column("trainer").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if trainer != now:
                    close()
                    own, now = Attention(subwords), trainer
                    own.set_weights(start)
                held.append(np.frombuffer(blob, dtype))
                size += len(held[-1])
                if size >= at_once:
                    some()
        close()
        if tokens:
            part = [total[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            salt = np.full(len(part), (now or 0) % 64, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(salt), pa.array(range(len(part)), pa.int32()), pa.array(part, pa.binary()), pa.array([tokens] * len(part), pa.int64())],
                ["salt", "part", "sums", "tokens"],
            )

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for batch in batches:
            for w, n in zip(batch.column("sums").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                total, tokens = np.frombuffer(w) if total is None else total + np.frombuffer(w), tokens + n
        salt = key[0].as_py() if len(key) == 2 else 0
        yield pa.RecordBatch.from_arrays(
            [pa.array([salt], pa.int32()), pa.array([key[-1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([tokens], pa.int64())],
            ["salt", "part", "sums", "tokens"],
        )

    schema = "salt int, part int, sums binary, tokens long"
    dealt = texts.select(F.pmod("at", F.lit(trainers)).alias("trainer"), "at", "ids").repartitionById(tasks, F.expr(f"cast(trainer % {tasks} as int)"))
    sums = dealt.sortWithinPartitions("trainer", "at", "ids").select("trainer", "ids").mapInArrow(learn, schema)
    if tasks > 64:
        sums = sums.groupBy("salt", "part").applyInArrow(add, schema)
    found = {r["part"]: np.frombuffer(r["sums"]) / r["tokens"] for r in sums.groupBy("part").applyInArrow(add, schema).collect()}
    return [found[i].reshape(w.shape) for i, w in enumerate(model.weights())] if found else None


def trained(texts: DataFrame, subwords: Subwords, dtype: type) -> Attention:
    """The model after one pass over all training texts, from weights fitted on a part of them by one trainer."""
    model = Attention(subwords)
    tokens = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    start = F.pmod(F.xxhash64("at"), F.lit(1_000_000)) < F.lit(1_000_000 * FIT_TOKENS / max(1, tokens))
    fit = (texts.where(start), 1, LEARNING_RATE, 3, 256, 2 * FIT_TOKENS)
    rest = (texts, max(1, -(-tokens // TRAINER_TOKENS)), RATE, 1, WINDOWS_A_STEP, TRAINED_AT_ONCE)
    for part, trainers, *how in (fit, rest):
        weights = _trainers(part, trainers, model, dtype, *how)
        if weights is not None:
            model.set_weights(weights)
    return model


def score_texts(
    docs: DataFrame, path: str, pattern: str, folds: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Log10 probability of every whole text under a causal self-attention model, and under word counts.

    The model reads the subword ids of each lower-cased word in turn. It predicts the class of the next id, its
    part of the class, and the id: class and part by what follows the last id (counted over all training texts)
    and one layer of causal attention over a window, the id by its share of its part after the group before.
    Windows overlap: each scores ``SCORED`` ids and sees ``BEFORE`` more, so every id is scored once. Classes and
    coordinates of ids come from their neighbours in all training texts. One trainer fits the weights that all
    start with; then trainers of about ``TRAINER_TOKENS`` train on all training texts and the weights are
    averaged. A text's trainer and place follow from its id, so scores do not depend on partitions.

    The base is a unigram over words and one end: log10((c + 0.1) / (N + 0.1 (V + 1))). Words are compared
    by a 64-bit hash. The counts of the most frequent words go to all tasks; rarer words of a text are
    joined, and no rarer word is frequent enough to make a hot key.

    Training texts are those whose crc32 of the id modulo ``folds`` is not 0; a null id is held out. Returns
    one row per input row: id, ``held_out``, ``n_tokens`` (words and one end), ``n_known``,
    ``train_tokens``, ``base_score``, ``score``. A null text counts as empty and has its end alone. With
    nothing to train on, counts are 0 and the model is its start. Repeated rows stay repeated and count
    each time; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(train_split(F.col(id_col), folds), F.lit(False)).alias("train"),
    )
    words = words_of(path, pattern)
    parts = tokenised(rows.where("train"), path, pattern)
    texts = parts.where("kind = 0").select("at", "n", "ids")
    model = trained(texts, learnt_subwords(parts, words.end, _id_type(words)), _id_type(words))
    word_counts = written(parts.where("kind = 1").groupBy(F.col("at").alias("key")).agg(F.sum("n").alias("n")))
    power_of = F.floor(F.log2("n")).cast("int").alias("power")
    ladder = word_counts.groupBy(power_of).agg(F.count("*").alias("count"), F.sum("n").alias("n")).collect()  # a row for each power of two
    n_words, distinct = sum(r["n"] for r in ladder), sum(r["count"] for r in ladder)
    power, held = max((r["power"] for r in ladder), default=0), 0
    for r in sorted(ladder, key=lambda r: -r["power"]):
        if held + r["count"] > SHARED_WORDS:
            break
        held, power = held + r["count"], r["power"]
    least = 2**power if held else 2**62
    frequent = word_counts.where(F.col("n") >= least).select("key", "n").orderBy("key").toArrow()

    floor = float(n_words + 0.1 * (distinct + 1))
    shared = spark.sparkContext.broadcast(
        (model, frequent.column("key").to_numpy().astype(np.int64), frequent.column("n").to_numpy().astype(np.float64))
    )
    id_type = rows.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, keys, n = shared.value
        logs = np.append(np.log10((n + 0.1) / floor), 0.0)
        splitter = words_of(path, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in in_chunks(texts, CHUNK_CHARS):
                some, place, per_text, ids, lengths = splitter.split(texts[lo:hi])
                scores = net.score(ids, lengths) / LOG10
                some = some.view(np.int64)
                at = np.searchsorted(keys, some)
                at[at == len(keys)] = 0
                hit = keys[at] == some if len(keys) else np.zeros(len(some), bool)
                known = np.where(hit, at, len(keys))[place] if len(some) else np.empty(0, np.int64)
                text_of = np.repeat(np.arange(hi - lo), per_text)
                base = np.bincount(text_of, logs[known], hi - lo)
                n_hit = np.bincount(text_of, known < len(keys), hi - lo).astype(np.int64)
                rest = known == len(keys)
                rare = np.bincount(text_of[rest], minlength=hi - lo)
                ends = pa.array(np.concatenate([[0], np.cumsum(rare)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo), batch.column("train").slice(lo, hi - lo), pa.array(per_text + 1),
                        pa.array(n_hit), pa.array(base), pa.array(scores),
                        pa.ListArray.from_arrays(ends, pa.array(some[place[rest]])),
                    ],
                    ["id", "train", "n_tokens", "n_hit", "base", "score", "rare"],
                )

    scored = rows.mapInArrow(
        score, f"id {id_type}, train boolean, n_tokens long, n_hit long, base double, score double, rare array<long>"
    )
    scored = written(scored.withColumn("place", F.monotonically_increasing_id()))
    ends = word_counts.where(F.col("key") == END_HASH).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rare = scored.select("place", F.explode("rare").alias("word")).groupBy("place", "word").agg(F.count("*").alias("times"))
    looked_up = (
        rare.join(word_counts.where(F.col("n") < least).select("key", "n"), F.col("word") == F.col("key"), "left")
        .groupBy("place")
        .agg(
            F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / floor)).alias("rare_base"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        )
        .withColumnRenamed("place", "at")
    )
    end_log = float(np.log10((ends + 0.1) / floor))
    return scored.join(looked_up, F.col("place") == F.col("at"), "left").select(
        F.col("id").alias(id_col),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_hit") + F.coalesce("rare_known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(int(n_words)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end_log).alias("base_score"),
        "score",
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return score_texts(
        table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    )
