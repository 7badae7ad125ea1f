"""The inverted lexicon against plain substring search."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions import lexicons as lex
from siftwork.functions import text
from siftwork.functions.phrases import ANCHOR, PhraseIndex, grams, searched, whole_lexicon


def search(spark, index, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", index.found(F.col("t")).alias("found")).collect()
    return [sorted(r["found"]) for r in sorted(rows, key=lambda r: r["i"])]


def plain(phrases, texts):
    return [sorted({p for p in phrases if t is not None and p in t}) for t in texts]


def test_small_alphabet(spark):
    random.seed(4)
    word = lambda n: "".join(random.choices("ab ", k=n))
    phrases = [word(random.randrange(1, 9)) for _ in range(60)]
    texts = [word(random.randrange(0, 40)) for _ in range(300)] + [None, ""]
    assert search(spark, PhraseIndex(phrases), texts) == plain(phrases, texts)


def test_patterns_signs_and_scripts(spark):
    phrases = ["a.b", "a+b", "[x]", "(y", "z)", "\\d", "\\", "^$", "?", "*", "{2}", "|", "-", "&&", "~", "#1", "é☃", "\U0001f600\U0001f600", "नमस्ते", "a\nb", "qr", "qrcode"]
    texts = ["a.b a+b axb", "[x] (y z)", "\\d ^$ ? * {2} | - && ~ #1", "é☃ \U0001f600\U0001f600", "नमस्ते a\nb", "qrc", "qrcode", "xqrx", "aaaa"]
    assert search(spark, PhraseIndex(phrases), texts) == plain(phrases, texts)


def test_every_phrase_of_the_lexicon_is_found(spark):
    index = whole_lexicon()
    random.seed(9)
    texts = [f"x{p}y" for p in index.phrases] + [" ".join(random.sample(index.phrases, 30)) for _ in range(20)] + ["long " * 20_000 + index.phrases[5]]
    assert search(spark, index, texts) == plain(index.phrases, texts)


def test_documents_as_substrings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select(text.normalise(F.col("text")).alias("t"))
    index = whole_lexicon()
    both = df.select(F.array_sort(index.found(F.col("t"))).alias("a"), F.array_sort(text.phrases_in(F.col("t"), index.phrases)).alias("b"))
    assert both.where("a <> b").count() == 0


def test_phrases_are_held_under_a_rare_run():
    index = PhraseIndex(["the end", "the start", "the quiz", "zebra", "ab"])
    assert sum(map(len, index.held.values())) == 5
    for anchor, phrases in index.held.items():
        assert all(anchor in grams(p) and len(anchor) <= ANCHOR for p in phrases)
    assert len(index.held) == 5
    assert PhraseIndex(["ab", "abcd"]).candidates() == {"ab": ["ab"], "abcd": ["ab", "abcd"]}


def test_what_was_not_searched_for_is_refused(spark):
    df, t = searched(spark.createDataFrame([("a b",)], "t string"), "t", PhraseIndex(["a", "c"]))
    row = df.select(text.phrase_count(t, ["a", "a", "c"]).alias("n"), text.has_any(t, ["c"]).alias("c")).first()
    assert (row["n"], row["c"]) == (1, False)
    with pytest.raises(ValueError):
        text.phrase_count(t, ["a", "b"])
    with pytest.raises(ValueError):
        PhraseIndex([""])
    assert set(lex.BLOCKED_PHRASES) <= set(whole_lexicon().phrases)


def test_no_phrases(spark):
    assert search(spark, PhraseIndex([]), ["a", None]) == [[], []]
