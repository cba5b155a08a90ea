"""The corpus pipeline: language, shared lines, near copies, benchmark leaks, tokens.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.llm import decontaminate, langid, line_dedup, sentencepiece_codec, simhash
from geotally.llm.common import scratch, table
from geotally.llm.registry import PIECE_MODEL, language_training

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document stays if its best language has more than the share of all others together.
MIN_SHARE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in a language that the model is sure of (operator 3)."""
    found = langid.identify(docs, language_training(docs), PIECE_MODEL)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") > MIN_SHARE)).select(*COLUMNS)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, lines that five of them share left in one (operator 6)."""
    found = line_dedup.drop_frequent_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: fingerprints of five-word
    shingles (operator 9), an exact Jaccard similarity of 0.8."""
    return simhash.keep_similar(docs, shingle_words=5, percent=80).select(*COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found (operator 1)."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and digests of ids and decoded text (operator 8)."""
    return sentencepiece_codec.encode_decode(docs, PIECE_MODEL, with_text=False)


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_shared_lines),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_leaks),
    ("SentencePiece encoding and decoding", as_tokens),
]

#: Models, fingerprints and tokens are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
