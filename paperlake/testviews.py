"""Archive tables derived from the test tables: whole tables, the same rules for both engines."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions.ids import full_text_path, primary_category
from paperlake.schemas import PAPERS

# The archive's "now": one day after the last publication date.
AS_OF = "2001-08-02 00:00:00"
TEXT_ROOT = "texts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paper_id(number) -> Column:
    month = (F.lit(2301) + F.col(number) % 12).cast("int")
    return F.format_string("%04d.%05d", month, F.col(number))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dated by the order of the same number; toxic ones have no date."""
    docs = table(spark, sf_dir, "documents")
    dates = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), "o_orderdate"
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    arxiv_id = paper_id("doc_id")
    categories = F.concat(F.lit("cs."), F.upper("lang"), F.lit(","), F.col("source"))
    has_text = F.col("n_chars") > 500
    path = full_text_path(TEXT_ROOT, primary_category(categories), arxiv_id)
    rows = docs.join(dates, "doc_id", "left").join(labels, "doc_id", "left")
    return rows.select(
        arxiv_id.alias("arxiv_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("abstract"),
        F.col("source").alias("authors"),
        categories.alias("categories"),
        F.when(F.coalesce("toxic", F.lit(0)) == 0, F.col("o_orderdate")).alias("published"),
        F.col("o_orderdate").alias("updated"),
        F.lit(None).cast("string").alias("doi"),
        F.lit(None).cast("string").alias("journal_ref"),
        has_text.alias("has_full_text"),
        F.when(has_text, path).alias("full_text_path"),
        F.lit(None).cast("timestamp_ntz").alias("fetched_at"),
    ).select(*PAPERS.fieldNames())


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the documents of the same number."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    known = vectors.join(docs, "doc_id", "left_semi")
    return known.select(paper_id("doc_id").alias("arxiv_id"), "embedding")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order cites the parts of its lines; ends outside the documents stay dangling."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        paper_id("l_orderkey").alias("from_id"), paper_id("l_partkey").alias("to_id")
    ).distinct()


def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event type per user, and the time of the last event as last sync."""
    events = table(spark, sf_dir, "events")
    latest = events.groupBy(F.col("user_id").cast("string").alias("key")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("value")
    )
    last = events.agg(
        F.lit("last_sync").alias("key"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("value"),
    )
    return latest.unionByName(last)


def fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(paper_id("doc_id").alias("arxiv_id"), "text", F.col("lang").alias("category"))


def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a batch: a conversation's turns hit the same paper in order.

    Every other conversation is numbered past the documents, so it adds a paper.
    """
    turns = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    empty = F.lit("")
    number = F.col("conv_id") + F.when(F.col("conv_id") % 2 == 1, 500_000).otherwise(0)
    turns = turns.withColumn("number", number)
    return turns.select(
        paper_id("number").alias("arxiv_id"),
        F.col("role").alias("title"),
        F.col("text").alias("abstract"),
        F.when(user, F.lit("user")).otherwise(empty).alias("authors"),
        F.when(user, F.lit(None)).otherwise(F.lit("cs.DL")).alias("categories"),
        F.lit(None).cast("timestamp_ntz").alias("published"),
        F.lit(None).cast("timestamp_ntz").alias("updated"),
        F.when(user, F.concat(F.lit("10.1/"), F.col("turn"))).otherwise(empty).alias("doi"),
        empty.alias("journal_ref"),
        (F.length("text") > 500).alias("has_full_text"),
        empty.alias("full_text_path"),
        F.col("turn").alias("seq"),
    )


def harvest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as harvested records: versioned header ids, and toxic ones marked deleted.

    Documents with a label keep their own id, the others only have the header's.
    """
    rows = (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .join(
            table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "doc_id"),
            "doc_id",
            "left",
        )
    )
    own = F.when(F.col("quality").isNotNull(), paper_id("doc_id"))
    created = F.date_format("o_orderdate", "yyyy-MM-dd")
    author = F.struct(F.col("source").alias("keyname"), F.initcap("lang").alias("forenames"))
    header = F.struct(
        F.when(F.col("toxic") == 1, F.lit("deleted")).alias("_status"),
        F.concat(
            F.lit("oai:arXiv.org:"), paper_id("doc_id"), F.lit("v"), F.length("source")
        ).alias("identifier"),
        created.alias("datestamp"),
        F.array(F.concat(F.lit("cs:cs:"), F.upper("lang"))).alias("setSpec"),
    )
    record = F.struct(
        own.alias("id"),
        created.alias("created"),
        F.concat(created, F.lit("T10:30:00Z")).alias("updated"),
        F.struct(F.array(author, author).alias("author")).alias("authors"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat(F.lit("cs."), F.upper("lang"), F.lit(" "), F.col("source")).alias("categories"),
        F.col("text").alias("abstract"),
        F.lit(None).cast("string").alias("doi"),
        F.col("o_orderpriority").alias("journal-ref"),
    )
    return rows.select(header.alias("header"), F.struct(record.alias("arXiv")).alias("metadata"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment payloads (value): one JSON array per order line, with a null element each.

    A line's order cites its part and is cited by its supplier; a second cited item has no id.
    """
    lines = table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("string")

    def linked(arxiv_id):
        external = F.struct(arxiv_id.alias("ArXiv"), none.alias("DOI"))
        return F.struct(F.lit("p").alias("paperId"), external.alias("externalIds"))

    own = F.struct(paper_id("l_orderkey").alias("ArXiv"))
    tldr = F.when(F.col("l_returnflag") == "R", F.struct(F.col("l_linestatus").alias("text")))
    url = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("https://x/"), F.col("l_partkey")))
    paper = F.struct(
        own.alias("externalIds"),
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("abstract"),
        tldr.alias("tldr"),
        F.struct(url.alias("url")).alias("openAccessPdf"),
        F.array(linked(paper_id("l_partkey")), linked(none)).alias("references"),
        F.array(linked(paper_id("l_suppkey"))).alias("citations"),
    )
    return lines.select(
        F.concat(F.lit("["), F.to_json(paper), F.lit(",null]")).alias("value")
    )
