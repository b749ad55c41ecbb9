"""Citation edges: neighbours, degrees, papers without references."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.schemas import LIST_COLS


def _linked(refs: DataFrame, papers: DataFrame, end: str) -> DataFrame:
    wanted = refs.select(F.col(end).alias("arxiv_id"))
    found = papers.select(*LIST_COLS).join(wanted, "arxiv_id")
    return found.select(*LIST_COLS).orderBy(F.col("published").desc_nulls_last(), "arxiv_id")


def references(refs: DataFrame, papers: DataFrame, arxiv_id: str) -> DataFrame:
    """Papers cited by `arxiv_id`, newest first; targets outside the archive are left out."""
    return _linked(refs.where(F.col("from_id") == arxiv_id), papers, "to_id")


def cited_by(refs: DataFrame, papers: DataFrame, arxiv_id: str) -> DataFrame:
    """Papers citing `arxiv_id`, newest first."""
    return _linked(refs.where(F.col("to_id") == arxiv_id), papers, "from_id")


def reference_ids(refs: DataFrame, arxiv_id: str) -> DataFrame:
    """Raw target ids, those outside the archive included."""
    return refs.where(F.col("from_id") == arxiv_id).select("to_id")


def cited_by_ids(refs: DataFrame, arxiv_id: str) -> DataFrame:
    return refs.where(F.col("to_id") == arxiv_id).select("from_id")


def degrees(refs: DataFrame) -> DataFrame:
    """Outgoing and incoming edge counts per id, dangling edges included.

    Each edge is emitted once per end and counted in one aggregation: one scan, one shuffle of
    partial counts, and a hub id reaches the shuffle as one row per task.
    """
    ends = F.array(
        F.struct(F.col("from_id").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("inc")),
        F.struct(F.col("to_id").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("inc")),
    )
    return (
        refs.select(F.inline(ends))
        .groupBy(F.col("id").alias("arxiv_id"))
        .agg(F.sum("out").alias("ref_count"), F.sum("inc").alias("cited_by_count"))
    )


def degree(refs: DataFrame, arxiv_id: str) -> DataFrame:
    """Edge counts of one id as a single row, zeros when it has no edge."""
    return refs.where((F.col("from_id") == arxiv_id) | (F.col("to_id") == arxiv_id)).agg(
        F.count_if(F.col("from_id") == arxiv_id).alias("ref_count"),
        F.count_if(F.col("to_id") == arxiv_id).alias("cited_by_count"),
    )


def missing_references(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """Papers with full text and no outgoing edge.

    Sources are made distinct before the join (same partitioning, so no further shuffle): a paper
    holding a large share of the edges then counts once per task.
    """
    sources = refs.select(F.col("from_id").alias("arxiv_id")).distinct()
    return papers.where(F.col("has_full_text")).join(sources, "arxiv_id", "left_anti")


def missing_reference_count(papers: DataFrame, refs: DataFrame) -> DataFrame:
    return missing_references(papers, refs).agg(F.countDistinct("arxiv_id").alias("papers"))
