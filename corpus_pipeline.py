"""Corpus cleaning: toxicity, near duplicates, benchmark leaks, personal data, tokens.

Each stage works on all documents that the one before kept; its result is written as Parquet in the shared folder and read again. All stages but the last return the columns of ``documents``.

Edge cases: rows with a null doc_id are kept by the filtering stages; null and empty texts are kept as they are but for copies of one another, of which the least doc_id stays; repeated rows are one document after the second stage; a very long text is a text like any other; ties of a class go
to the least doc_id; further columns of ``documents`` are passed on, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelore.llm import decontaminate, near_duplicates, personal_data, piece_sampling, toxicity
from pricelore.llm._common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents of a score of 0.3 or more go."""
    return toxicity.harmless(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each class the document with the least id stays."""
    return near_duplicates.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each span becomes its kind in angle brackets."""
    return personal_data.redact(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: doc_id and two sampled segmentations."""
    import public_tokenizers

    return piece_sampling.sample(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("PII", redact_personal_data),
    ("SentencePiece", sample_pieces),
]
#: A trained classifier and a sampler can't be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
