"""The pipeline's stages against brute force, one after another."""

import base64
import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_documents import brute_components, rows

import corpus_pipeline
from siftwork.llm import mixing
from siftwork.llm.common import written


def test_run(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    clear = [(i, t) for i, t in docs.items() if t and any(c.isalpha() for c in t)]
    kept = {i for i, (_, c, _) in brute_components(clear).items() if i == c}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = rows(corpus_pipeline.run(spark, sf_dir))
    assert sorted(r["doc_id"] for r in found) == sorted(kept)
    for r in found:
        ids = encoding.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_stages_keep_the_columns_on_traps_and_on_nothing(spark, docs, sf_dir):
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf_dir)
            assert out.columns == df.columns
            df = written(out)
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() == df.count()


def test_texts_without_labels_stay(spark, docs, sf_dir):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = rows(corpus_pipeline.known_language(spark, bare, sf_dir).select("doc_id", "text"))
    want = [(r["doc_id"], r["text"]) for r in rows(bare) if r["text"] and any(c.isalpha() for c in r["text"])]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(repr, want))


def test_files_hold_the_mix_in_order(spark, docs):
    laid = written(mixing.mixed_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"])))
    placed = laid.select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("k")).collect()
    order = [r["doc_id"] for r in sorted(placed, key=lambda r: (r["f"], r["k"]))]
    want = mixing.mix_sources(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).orderBy("slot", "seq").collect()
    assert order == [r["doc_id"] for r in want]
