"""Operator 1: language identification by prediction by partial matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.bpe import in_chunks
from siftwork.llm.common import light_batches, table, train_split

#: Contexts reach back so many bytes.
ORDER = 3
#: Bytes of labelled text that each language is fitted on, about; a smaller corpus is used whole.
FIT_BYTES = 6_000_000
#: A context seen less often than this in a language does not enter that language's tree.
LEAST_SEEN = 4
#: Nodes of one order, over all languages: with the bytes and the languages this bounds what is broadcast.
CONTEXTS = 60_000
#: Characters that are scored at once.
CHUNK_CHARS = 400_000
#: Before the first order a byte is one of so many, all alike.
ALPHABET = 256
_LETTER = regex.compile(r"\p{L}")


def gram_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, fit_bytes: int) -> DataFrame:
    """(lang, gram, count): how often each run of ``ORDER`` + 1 bytes occurs in the fitted texts.

    ``gram`` packs the bytes into an integer; before its first byte a text has zero bytes. Only rows of the
    training split with a label are read. Where the labelled text of a language exceeds ``fit_bytes``, a
    share of its rows, by a hash of the id, is taken whole; this bounds the fit, not what is scored.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(F.col(lang_col).isNotNull() & train_split(F.col(id_col), folds)).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), body.alias("text")
    )
    sizes = rows.groupBy(F.col("lang").alias("of_lang")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    dice = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000))
    # one row a language, and each language has a tree in every task anyway
    fitted = rows.join(F.broadcast(sizes), F.col("lang") == F.col("of_lang")).where(
        dice * F.col("bytes") <= F.lit(fit_bytes).cast("double") * 1_000_000
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lo, hi in in_chunks(texts, CHUNK_CHARS):
                for lang in set(langs[lo:hi]):
                    own = [t.encode("utf-8", "surrogatepass") for t, l in zip(texts[lo:hi], langs[lo:hi]) if l == lang]
                    pad = bytes(ORDER)
                    flat = np.frombuffer(pad.join([b"", *own]), np.uint8).astype(np.int64)
                    gram = np.zeros(max(0, len(flat) - ORDER), np.int64)
                    for k in range(ORDER + 1):
                        gram = (gram << 8) | flat[k : k + len(gram)]
                    gram = gram[(gram & 0xFF) != 0]
                    held.setdefault(lang, []).append(np.unique(gram, return_counts=True))
            for lang, parts in held.items():
                if len(parts) > 8:
                    held[lang] = [_added(parts)]
        for lang, parts in held.items():
            gram, n = _added(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"]
            )

    counted = fitted.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(place, np.concatenate([n for _, n in parts]), len(gram)).astype(np.int64)


class ContextTrees:
    """One context tree for each language over shared nodes, with the code length of every next byte.

    ``bits[node, symbol, lang]`` is the length of the symbol's code after the node's context. A language
    codes a symbol by its longest context in its own tree: with count c of n and q distinct successors the
    probability is c / (n + q); the escape q / (n + q) goes to the symbols not seen there, in proportion to
    their probability one byte shorter. Before the first order stands the flat distribution. The
    statistics are frozen, so every code length is exact and found by a lookup.
    """

    def __init__(self, langs: list[str], grams: np.ndarray, counts: np.ndarray, of: np.ndarray):
        self.langs = langs
        present = np.unique(np.concatenate([grams >> (8 * k) & 0xFF for k in range(ORDER + 1)])) if len(grams) else np.empty(0, np.int64)
        # symbol 0 is any byte that the fitted texts lack; zero bytes before a text count as it
        present = present[present != 0]
        self.symbol = np.zeros(256, np.int32)
        self.symbol[present] = np.arange(1, len(present) + 1)
        width = len(present) + 1
        self.width, n_langs = width, len(langs)
        unseen_bytes = ALPHABET - len(present)
        coded = np.zeros(len(grams), np.int64)
        for k in range(ORDER, -1, -1):
            coded = coded * width + self.symbol[grams >> (8 * k) & 0xFF]
        flat = np.full(width, 1 / ALPHABET)
        flat[0] = max(unseen_bytes, 1) / ALPHABET
        flat /= flat.sum()
        # order 0: the root
        tables = [self._row(np.bincount(coded[of == j] % width, counts[of == j], width), flat) for j in range(n_langs)]
        probs = [np.stack(tables, 1)[None]] if n_langs else [np.zeros((1, width, 0))]
        self.child: list[np.ndarray] = []
        self.sizes = [1]
        most = CONTEXTS // max(1, n_langs)
        for k in range(1, ORDER + 1):
            # a context of order k is the one of order k - 1 that ends a byte sooner, and one byte more
            context = coded // width % width**k
            seen = np.zeros(0, np.int64)
            for j in range(n_langs):
                own, place = np.unique(context[of == j], return_inverse=True)
                often = np.bincount(place, counts[of == j], len(own))
                least = max(LEAST_SEEN, np.partition(often, -most)[-most] + 1 if len(own) > most else 0)
                seen = np.union1d(seen, own[often >= least])
            parents = self._at(k - 1, seen // width)
            seen, parents = seen[parents >= 0], parents[parents >= 0]
            # the row after the last is that of no node, and leads nowhere
            child = np.full((len(probs[k - 1]) + 1, width), len(seen), np.int32)
            child[parents, seen % width] = np.arange(len(seen))
            self.child.append(child)
            shorter = self._at(k - 1, seen % width ** (k - 1))
            base = probs[k - 1][np.maximum(shorter, 0)]
            for i in np.flatnonzero(shorter < 0):
                base[i] = self._backed(probs, seen[i], k)
            out = base
            for j in range(n_langs):
                mine = of == j
                at = np.searchsorted(seen, context[mine])
                at[at == len(seen)] = 0
                hit = seen[at] == context[mine] if len(seen) else np.zeros(mine.sum(), bool)
                table = np.bincount(at[hit] * width + coded[mine][hit] % width, counts[mine][hit], len(seen) * width)
                table = table.reshape(len(seen), width)
                enough = table.sum(1) >= LEAST_SEEN
                out[enough, :, j] = self._row(table[enough], base[enough, :, j])
            probs.append(out)
            self.sizes.append(len(seen))
        starts = np.cumsum([0, *map(len, probs)])
        self.starts = starts[:-1].astype(np.int32)
        per_byte = np.ones(width)
        per_byte[0] = max(unseen_bytes, 1)
        bits = [-np.log2(p / per_byte[None, :, None]) for p in probs]
        flat_bits = np.concatenate(bits).astype(np.float32)
        self.bits = [np.ascontiguousarray(flat_bits[:, :, j]).ravel() for j in range(n_langs)]

    def _at(self, order: int, context: np.ndarray) -> np.ndarray:
        """Node of each context of that order, -1 where there is none."""
        node = np.zeros(len(context), np.int64)
        sizes = self.sizes
        for k in range(order):
            symbol = context // self.width ** (order - 1 - k) % self.width
            there = self.child[k][np.maximum(node, 0), symbol]
            node = np.where((node >= 0) & (there < sizes[k + 1]), there, -1)
        return node

    def _backed(self, probs: list[np.ndarray], context: int, order: int) -> np.ndarray:
        for k in range(order - 1, -1, -1):
            node = self._at(k, np.array([context % self.width**k]))[0]
            if node >= 0:
                return probs[k][node]
        return probs[0][0]

    @staticmethod
    def _row(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        counts = np.asarray(counts, float)
        n, q = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
        rest = np.where(counts > 0, 0, shorter)
        left = rest.sum(-1, keepdims=True)
        # where nothing is left to escape to, the seen symbols share all
        total = np.where(left > 0, n + q, n)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.where(counts > 0, counts / total, np.where(left > 0, rest / left * q / total, 0))
        return np.where(n > 0, out, shorter)

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits that each language needs for each whole text: one row a text, one column a language."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = self.symbol[np.frombuffer(bytes(ORDER).join([b"", *raw, b""]), np.uint8)]
        n = len(flat) - ORDER
        # at each byte the longest context that has a node; the node of a context follows from the node of
        # the context that ends a byte sooner
        longest, node = np.zeros(n, np.int64), np.zeros(len(flat), np.int32)
        for k in range(1, ORDER + 1):
            node = self.child[k - 1].ravel()[node[: len(flat) - 1 - (k - 1)].astype(np.int64) * self.width + flat[k - 1 : -1]]
            here = node[ORDER - k :]
            longest = np.where(here < self.sizes[k], here + self.starts[k], longest)
        at = longest * self.width + flat[ORDER:]
        starts = np.cumsum(sizes + ORDER) - sizes - ORDER
        edges = np.stack([starts, starts + sizes], 1).ravel()
        out = np.zeros((len(raw), len(self.langs)))
        for j in range(len(self.langs)):
            sums = np.add.reduceat(np.append(self.bits[j][at], np.float32(0)), edges, dtype=np.float64)[::2]
            out[:, j] = np.where(sizes > 0, sums, 0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 where there is no letter or nothing was learnt."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if self.langs and t and _LETTER.search(t)]
        for lo, hi in in_chunks([texts[i] for i in some], CHUNK_CHARS):
            bits = self.code_lengths([texts[i] for i in some[lo:hi]])
            best = bits.argmin(1)
            share = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
            for i, b, p in zip(some[lo:hi], best.tolist(), share.tolist(), strict=True):
                names[i], scores[i] = self.langs[b], p
        return names, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, fit_bytes: int = FIT_BYTES) -> ContextTrees:
    """Learn the context trees. What reaches the driver is bounded by ``fit_bytes`` a language."""
    grams = gram_counts(docs, id_col, text_col, lang_col, folds, fit_bytes).toArrow()
    names = grams.column("lang").to_pylist()
    langs = sorted(set(names))
    place = {lang: j for j, lang in enumerate(langs)}
    of = np.fromiter((place[x] for x in names), np.int64, len(names))
    return ContextTrees(
        langs, grams.column("gram").to_numpy().astype(np.int64), grams.column("n").to_numpy().astype(np.int64), of
    )


def identify_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    fit_bytes: int = FIT_BYTES,
    columns: list[str] | None = None,
) -> DataFrame:
    """As ``identify_languages``, with the input's columns (all, or those named) in a struct ``row``.

    ``letter`` tells whether the text holds one: where nothing could be learnt, such a text is ``und`` too.
    """
    light_batches(docs.sparkSession)
    trees = fit(docs, id_col, text_col, lang_col, folds, fit_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    names = list(columns or docs.columns)
    inside = text_col in names  # a text travels once
    source = docs.select(
        *([] if inside else [F.col(text_col).alias("__text")]),
        F.coalesce(~train_split(F.col(id_col), folds), F.lit(True)).alias("held_out"),
        F.struct(*[F.col(c) for c in names]).alias("row"),
    )
    row_type = source.schema["row"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = (pc.struct_field(batch.column("row"), [names.index(text_col)]) if inside else batch.column("__text")).to_pylist()
            langs, scores = model.predict(texts)
            letters = [bool(t and _LETTER.search(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.bool_())],
                ["row", "held_out", "lang_pred", "score", "letter"],
            )
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(label, f"row {row_type}, held_out boolean, lang_pred string, score double, letter boolean")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Predict the language of every whole text by prediction by partial matching.

    The trees are learnt from the text and the non-null label of rows whose crc32 of the id modulo
    ``folds`` is not 0. They code a text byte by byte; the language with the shortest code wins (ties:
    first by name) and ``score`` is its share of the posterior under equal priors.

    Returns one row per input row: id, ``held_out``, ``lang_pred`` and ``score`` (0 to 1). A text that is
    null or has no letter is ``und`` with score 0, and so is every text if nothing could be learnt. A null
    id is held out. Repeated rows stay repeated, an empty table gives an empty result, other columns are
    ignored. Labels, ids and sources are not looked at in a prediction.
    """
    found = identify_rows(docs, id_col, columns=[id_col], **options)
    return found.select(F.col(f"row.{id_col}").alias(id_col), "held_out", "lang_pred", "score")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
