"""A training-data pipeline over ``documents``: five of the library's operators in a row.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on; it is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, jaccard_join, line_dedup, quality, sentence_pieces
from quire.llm.store import saved, unused


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the rules or the model reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that an earlier document has go; n_chars follows the text."""
    n_lines, n_dropped = unused("n_lines", docs), unused("n_dropped", docs)
    kept = line_dedup.dedup_lines(docs, n_lines=n_lines, n_dropped=n_dropped)
    out = kept.where((F.col(n_dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))  # a document with nothing left goes
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, similarity 0.8): one document of each group stays."""
    return jaccard_join.keep_first(docs, k=5, p=4, q=5)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that leak an item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text and the digest of their decoding."""
    model = sentence_pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentence_pieces.encode_digests(docs, model)


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", clean_of_benchmark),
    ("SentencePiece encoding and decoding", encoded_documents),
]

#: A fitted model and latent vectors can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return docs


QUERIES = {"pipeline": run}
ORACLE_SQL_BY_QUERY: dict[str, str] = {}
