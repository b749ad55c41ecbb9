"""Readers of landed harvest pages and enrichment documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.functions.text import trimmed
from paperlake.operators.harvest import NO_RECORDS
from paperlake.schemas import OAI_ERROR, OAI_RECORD, OAI_TOKEN, S2_PAPER

XML_OPTIONS = {"ignoreSurroundingSpaces": "false"}


def _xml(reader, tag: str, schema):
    return reader.format("xml").options(rowTag=tag, **XML_OPTIONS).schema(schema)


def with_order(records: DataFrame) -> DataFrame:
    """Turn `page` into `seq`: file name, then place in the file. Later pages override earlier.

    A page is read by one task in document order, so row numbers rise within a file.
    """
    seq = F.struct(F.col("page"), F.monotonically_increasing_id().alias("place"))
    return records.withColumn("seq", seq).drop("page")


def _records(raw: DataFrame) -> DataFrame:
    return raw.select("*", F.col("_metadata.file_path").alias("page"))


def harvest_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all landed pages, in order."""
    return with_order(_records(_xml(spark.read, "record", OAI_RECORD).load(path)))


def harvest_record_stream(spark: SparkSession, path: str, pages_per_batch: int = 1000):
    """Records of newly landed pages, with their `page`; order them with `with_order` per batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", pages_per_batch)
    return _records(_xml(reader, "record", OAI_RECORD).load(path))


def _error_rows(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("_metadata.file_path").alias("page"),
        F.col("_code").alias("code"),
        trimmed("_VALUE").alias("message"),
    ).where(~F.col("code").eqNullSafe(NO_RECORDS))


def harvest_errors(spark: SparkSession, path: str) -> DataFrame:
    """Error answers (page, code, message), without the one that only means "no records"."""
    return _error_rows(_xml(spark.read, "error", OAI_ERROR).load(path))


def harvest_error_stream(spark: SparkSession, path: str) -> DataFrame:
    return _error_rows(_xml(spark.readStream, "error", OAI_ERROR).load(path))


def page_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Resume token, total size and cursor of each page; the last page has an empty token."""
    raw = _xml(spark.read, "resumptionToken", OAI_TOKEN).load(path)
    return raw.select(
        F.col("_metadata.file_path").alias("page"),
        F.coalesce(trimmed("_VALUE"), F.lit("")).alias("token"),
        F.col("_completeListSize").alias("complete_size"),
        F.col("_cursor").alias("cursor"),
    )


def parse_documents(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Documents of JSON array payloads; null elements and documents without id are dropped."""
    parsed = F.from_json(column, T.ArrayType(S2_PAPER))
    documents = payloads.select(F.explode(parsed).alias("paper")).select("paper.*")
    return documents.where(F.col("externalIds.ArXiv") != "")


def enrichment_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Landed payloads: one JSON array per file, or with `lines` one per line."""
    return parse_documents(spark.read.text(path, wholetext=not lines))
