"""One query per operator over the whole tables, and SQL where SQL can express them."""

import public_tokenizers
from pyspark.sql import functions as F

from paperlake.testviews import table

from . import (
    alignment,
    audit,
    decontaminate,
    extraction,
    jaccard,
    language,
    licenses,
    oracles,
    packing,
    quality,
    recipes,
    repeats,
    secret_scan,
    urls,
)


def held_out():
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_model(docs):
    """A model of the documents' languages, learned from those not held out."""
    return language.fit(docs.where(~held_out()))


def op1_ngram_jaccard_join(spark, sf_dir):
    """Three-word shingles, similarity 0.9."""
    return jaccard.links(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op2_license_scans(spark, sf_dir):
    """The licences of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    """The rules' counts and the verdict on every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark, sf_dir):
    """Every leak of a benchmark item in a document."""
    return decontaminate.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op5_url_filters(spark, sf_dir):
    """The verdict on every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_packing(spark, sf_dir):
    """All documents in windows of 2048 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path)


def op7_html_extraction(spark, sf_dir):
    """The main text of every page."""
    found = extraction.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_language_id(spark, sf_dir):
    """The language of every document, by a model of those not held out."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    found = language.identify(rows, language_model(docs), ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_secret_scans(spark, sf_dir):
    """The secrets of every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    """Words left of every document without windows of 50 that a smaller document holds."""
    report, _ = repeats.remove(table(spark, sf_dir, "documents"))
    return report.withColumnRenamed("digest", "kept_sha256")


def op11_exact_dedup(spark, sf_dir):
    """Every document's group of equal texts, and whether it stays."""
    return recipes.groups(table(spark, sf_dir, "documents"))


def op12_filter_interactions(spark, sf_dir):
    """What five filters remove from every source's documents, in every order."""
    return audit.interactions(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op13_tokenizer_alignment(spark, sf_dir):
    """Every document's tokens of two tokenizers, aligned and linked."""
    paths = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), *paths)


QUERIES = {
    query.__name__: query
    for query in [
        op1_ngram_jaccard_join,
        op2_license_scans,
        op3_quality_rules,
        op4_benchmark_decontamination,
        op5_url_filters,
        op6_packing,
        op7_html_extraction,
        op8_language_id,
        op9_secret_scans,
        op10_substring_dedup,
        op11_exact_dedup,
        op12_filter_interactions,
        op13_tokenizer_alignment,
    ]
}

ORACLES = {
    "op1_ngram_jaccard_join": oracles.NEAR_DUPLICATES,
    "op10_substring_dedup": oracles.REPEATS,
    "op11_exact_dedup": oracles.EQUAL_TEXTS,
    "op12_filter_interactions": oracles.FILTER_INTERACTIONS,
}
