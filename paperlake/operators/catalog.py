"""Reads over the paper table: look-ups, recency listings, work queues, details."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake import params
from paperlake.functions.text import as_column, day, shortened
from paperlake.operators import graph, membership
from paperlake.schemas import (
    EMBED_QUEUE_COLS,
    LIST_COLS,
    PAPER_COLS,
    PUBLISHED_DAY,
    TEXT_QUEUE_COLS,
)


def timestamp(value) -> Column:
    """A wall-clock timestamp from a datetime, an ISO string or a column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(" ")
    return F.lit(value).cast("timestamp_ntz")


def newest_first(nulls_last: bool = True) -> list[Column]:
    published = F.col("published")
    order = published.desc_nulls_last() if nulls_last else published.desc()
    return [order, F.col("arxiv_id").asc()]


def published_since(as_of, days: int) -> Column:
    """Published in the `days` before `as_of` or later; unknown dates are excluded."""
    return F.col("published") >= timestamp(as_of) - F.make_dt_interval(F.lit(days))


def in_category(category: str, exact: bool = False, separator: str = r"[,\s]+") -> Column:
    """Category filter: by default a LIKE substring, wildcards included; `exact` compares names."""
    if exact:
        return F.array_contains(F.split("categories", separator), category)
    return F.col("categories").like(f"%{category}%")


def recent(papers: DataFrame, as_of, category: str = "", days=None, limit=None) -> DataFrame:
    """Latest papers of the last days, optionally of one category."""
    days = params.positive(days, params.RECENT_DAYS)
    found = papers.where(published_since(as_of, days))
    if PUBLISHED_DAY.name in papers.columns:
        # Implied by the line above, and skips the row groups of older days.
        first = timestamp(as_of) - F.make_dt_interval(F.lit(days))
        found = found.where(F.col(PUBLISHED_DAY.name) >= first.cast("date"))
    if category:
        found = found.where(in_category(category))
    found = found.select(*LIST_COLS).orderBy(*newest_first())
    return found.limit(params.positive(limit, params.RECENT_LIMIT))


def get_paper(papers: DataFrame, arxiv_id: str) -> DataFrame:
    """The row of one id, or none."""
    return papers.where(F.col("arxiv_id") == arxiv_id).select(*PAPER_COLS)


def get_papers(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """The papers named in `ids` (arxiv_id)."""
    return papers.join(ids.select("arxiv_id"), "arxiv_id", "left_semi").select(*PAPER_COLS)


def with_embedding(papers: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The full row: metadata with its vector, when there is one."""
    columns = PAPER_COLS[:-1] + ["embedding", PAPER_COLS[-1]]
    vectors = embeddings.select("arxiv_id", "embedding")
    return papers.join(vectors, "arxiv_id", "left").select(*columns)


def known_ids(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """Rows of `candidates` (arxiv_id, ...) already in the archive."""
    return membership.known(candidates, papers, "arxiv_id")


def unknown_ids(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    return membership.unknown(candidates, papers, "arxiv_id")


def _queue(pending: DataFrame, columns: list[str], limit) -> DataFrame:
    """Newest first; `limit=None` keeps the default size, `limit="all"` the whole queue."""
    ordered = pending.select(*columns).orderBy(*newest_first())
    if limit == "all":
        return ordered
    return ordered.limit(params.positive(limit, params.QUEUE_LIMIT))


def pending_embedding(papers: DataFrame, embeddings: DataFrame, limit="all") -> DataFrame:
    """Papers with an abstract and no vector."""
    without = papers.where(F.col("abstract") != "").join(
        embeddings.select("arxiv_id"), "arxiv_id", "left_anti"
    )
    return _queue(without, EMBED_QUEUE_COLS, limit)


def pending_full_text(papers: DataFrame, limit="all") -> DataFrame:
    """Papers marked as having no full text (an unknown mark is not pending)."""
    return _queue(papers.where(~F.col("has_full_text")), TEXT_QUEUE_COLS, limit)


def listing(papers: DataFrame) -> DataFrame:
    """Display columns: id, shortened title, day, shortened categories."""
    return papers.select(
        "arxiv_id",
        shortened(as_column("title"), 80).alias("title"),
        day("published").alias("date"),
        shortened(as_column("categories"), 30).alias("categories"),
    )


def attach_full_text(papers: DataFrame, fulltext: DataFrame) -> DataFrame:
    """Add `full_text` where the paper is marked as having one; a missing text stays NULL."""
    marked = F.col("has_full_text") & (F.col("full_text_path") != "")
    texts = fulltext.select("arxiv_id", F.col("text").alias("_text"))
    joined = papers.join(texts, "arxiv_id", "left")
    return joined.withColumn("full_text", F.when(marked, F.col("_text"))).drop("_text")


def paper_details(
    papers: DataFrame, embeddings: DataFrame, refs: DataFrame, fulltext: DataFrame
) -> DataFrame:
    """Full rows with reference counts and full text. Filter `papers` first for a few ids."""
    counts = graph.degrees(refs)
    rows = with_embedding(papers, embeddings).join(counts, "arxiv_id", "left")
    rows = rows.withColumns(
        {
            "ref_count": F.coalesce("ref_count", F.lit(0)),
            "cited_by_count": F.coalesce("cited_by_count", F.lit(0)),
        }
    )
    return attach_full_text(rows, fulltext)


def paper_detail(
    papers: DataFrame, embeddings: DataFrame, refs: DataFrame, fulltext: DataFrame, arxiv_id: str
) -> DataFrame:
    """Details of one paper; the id filter reaches every table's scan."""
    own = F.col("arxiv_id") == arxiv_id
    touching = refs.where((F.col("from_id") == arxiv_id) | (F.col("to_id") == arxiv_id))
    return paper_details(
        papers.where(own), embeddings.where(own), touching, fulltext.where(own)
    )
