"""The pipeline from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result
as Parquet in the shared folder and reads it again as the next stage's documents. All stages but
the last return the columns of `documents`.
"""

import public_tokenizers

from paperlake.llm import decontaminate, jaccard, language, packing, queries, secret_scan
from paperlake.session import cut
from paperlake.testviews import table


def language_id(spark, docs, sf_dir):
    """Drops the documents that language identification rejects."""
    found = language.identify(docs, queries.language_model(docs), docs.columns)
    return found.where("NOT rejected").select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return jaccard.keep_one(docs, shingle=5, percent=80)


def benchmark_decontamination(spark, docs, sf_dir):
    """Drops the documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark, docs, sf_dir):
    """Masks the secrets in the texts."""
    return secret_scan.redact(docs)


def pack(spark, docs, sf_dir):
    """Packs the remaining texts into windows of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

ORACLE_SQL = None
"""Learned models, signatures and tokenizers are beyond SQL; tests compare with brute force."""


def run(spark, sf_dir):
    """All stages over the documents; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
