"""From raw documents to tokens: identify the language, drop repeated lines, near copies and benchmark passages, encode.

Each stage takes ``(spark, docs, sf_dir)`` with ``docs`` as its predecessor left them, and works on all of them.
Stages of filters keep a document's columns as they are, but for ``text`` and ``n_chars`` where lines are
taken out. ``run`` writes each stage's result to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm import bpe, decontamination, langid, lines, near_copies
from scanlake.llm.common import table
from scanlake.llm.queries import language_model_of
from scanlake.session import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: not those without a letter, or with a posterior under a half."""
    return langid.keep_identified(docs, language_model_of(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that another line of the corpus stands for; those with none left go."""
    left = lines.drop_repeated_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Documents are linked by fingerprints within 3 bits, as in ``op8_simhash``, and by 0.8 of five-word shingles.
    """
    return near_copies.drop_near_copies(docs, bits=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in benchmark windows."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and the SHA-256 of what the ids decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    decoded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return decoded.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("near-dedup", drop_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokenize),
]

#: Language likelihoods, components and merges are not for SQL; a test runs the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
