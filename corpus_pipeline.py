"""A corpus in four stages: known language, one of each group of near copies, target mix, subword ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.bpe import encode_texts
from siftwork.llm.common import table, written
from siftwork.llm.jaccard import one_of_each
from siftwork.llm.language import identify_rows
from siftwork.llm.mixing import mixed_documents


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language can't be told: null, empty, or without a letter.

    Every other text is code-length scored; it stays whatever its language, and keeps its label. Where no
    row is labelled no language can be learnt, and every text with a letter stays.
    """
    return identify_rows(docs).where("letter").select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group linked by 5-word shingles at 0.75 or more."""
    return one_of_each(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lay the documents out in the Pfair order of their sources; none is dropped or repeated.

    Targets are the sources' row counts to the power 0.5. Rows are range-partitioned by their place and
    sorted, so the files of the result hold the mix in order.
    """
    return mixed_documents(docs)


def subword_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each whole text, decode it again, and return the digests of both beside the id."""
    import public_tokenizers as tokenizers

    encoded = encode_texts(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("mix", target_mix),
    ("subwords", subword_ids),
]

#: SQL can express neither code lengths under a learnt tree nor byte pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
