"""Full-text and JSON sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.schemas import FULLTEXT
from paperlake.session import path_exists


def write_full_texts(texts: DataFrame, path: str, batch: str) -> None:
    """Store (arxiv_id, text, category) rows by category.

    Each batch has its own folder, which a repeated batch overwrites. A crowded category is split
    over several tasks by the rebalance.
    """
    rows = texts.select(*FULLTEXT.fieldNames()).hint("rebalance", "category")
    rows.write.partitionBy("category").mode("overwrite").parquet(f"{path}/batch={batch}")


def read_full_texts(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], FULLTEXT)
    schema = T.StructType([*FULLTEXT.fields, T.StructField("batch", T.StringType())])
    return spark.read.schema(schema).parquet(path)


def _json_field(field: T.StructField):
    column = F.col(field.name)
    if isinstance(field.dataType, T.TimestampNTZType):
        instant = F.concat(F.replace(column.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
        return instant.alias(field.name)
    if isinstance(field.dataType, T.StringType) and field.name not in ("arxiv_id", "title"):
        return F.nullif(column, F.lit("")).alias(field.name)
    return column


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON text per row; empty fields are left out, flags and counts are kept."""
    fields = F.struct(*[_json_field(f) for f in rows.schema.fields])
    return rows.select(F.to_json(fields, {"ignoreNullFields": "true"}).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    """Results of any size as JSON lines, written in parallel."""
    json_rows(rows).write.mode("overwrite").text(path)


def headed_lines(rows: DataFrame, label: str, **header) -> DataFrame:
    """An answer without a limit, (part, value): a `header` line with the count, and the rows."""
    fields = [F.lit(v).alias(k) for k, v in header.items()]
    head = rows.agg(F.count("*").alias("count")).select(
        F.lit("header").alias("part"), F.to_json(F.struct(*fields, "count")).alias("value")
    )
    return head.unionByName(json_rows(rows).select(F.lit(label).alias("part"), "value"))


def envelope(rows: DataFrame, label: str = "papers", **header) -> DataFrame:
    """One JSON answer: the header fields, the row count, then the rows in order.

    Meant for limited listings: the rows of one answer end up in one value. Use `write_json` for
    answers without a limit.
    """
    numbered = json_rows(rows).select(
        F.monotonically_increasing_id().alias("n"), F.col("value")
    )
    listed = F.array_sort(F.collect_list(F.struct("n", "value")))
    body = F.array_join(F.transform(listed, lambda item: item["value"]), ",")
    head = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in header.items()]))
    text = F.concat(
        F.regexp_replace(head, r"\}\z", ""),
        F.lit(',"count":'),
        F.count("*").cast("string"),
        F.lit(f',"{label}":['),
        body,
        F.lit("]}"),
    )
    return numbered.agg(text.alias("value"))
