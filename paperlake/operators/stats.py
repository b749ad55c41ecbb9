"""Archive-wide statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.operators.catalog import published_since, timestamp

NO_DATE = "1970-01-01"


def category_names(papers: DataFrame, separator: str = ",") -> DataFrame:
    """Distinct category names. `,` keeps the names untrimmed; `[,\\s]+` reads both list styles."""
    listed = papers.where(F.col("categories") != "")
    return listed.select(F.explode(F.split("categories", separator)).alias("category")).distinct()


def archive_stats(
    papers: DataFrame, embeddings: DataFrame, refs: DataFrame, sync_state: DataFrame, as_of,
    separator: str = ",",
) -> DataFrame:
    """All statistics as one row. Papers are read twice, for the counts and for the categories."""
    n_vectors = embeddings.agg(F.count("*")).scalar()
    n_refs = refs.agg(F.count("*")).scalar()
    n_categories = category_names(papers, separator).agg(F.count("*")).scalar()
    last_sync = (
        sync_state.where(F.col("key") == "last_sync").agg(F.max("value")).scalar()
    )
    counts = papers.agg(
        F.count("*").alias("total_papers"),
        F.count_if("has_full_text").alias("with_full_text"),
        F.coalesce(F.min("published"), timestamp(NO_DATE)).alias("oldest_paper"),
        F.coalesce(F.max("published"), timestamp(NO_DATE)).alias("newest_paper"),
        F.count_if(published_since(as_of, 7)).alias("papers_last_7_days"),
        F.count_if(published_since(as_of, 30)).alias("papers_last_30_days"),
    )
    return counts.select(
        "total_papers",
        "with_full_text",
        n_vectors.alias("with_embedding"),
        n_refs.alias("total_refs"),
        n_categories.alias("categories_count"),
        "oldest_paper",
        "newest_paper",
        F.coalesce(last_sync, F.lit("")).alias("last_sync"),
        "papers_last_7_days",
        "papers_last_30_days",
    )


def progress(papers: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Total papers, those with full text, those with a vector."""
    return papers.agg(
        F.count("*").alias("total"), F.count_if("has_full_text").alias("with_text")
    ).select("total", "with_text", embeddings.agg(F.count("*")).scalar().alias("with_embedding"))
