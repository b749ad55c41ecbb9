"""Similar papers: stored neighbours first, then the index, then a scan."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake import params
from paperlake.functions.ids import looks_like_id
from paperlake.operators import embed, ivf, knn, neighbours
from paperlake.session import cut


def stored(similar: DataFrame, papers: DataFrame, arxiv_id: str, limit=None) -> DataFrame:
    """Stored neighbours of one paper that are still in the archive: (arxiv_id, similarity)."""
    mine = similar.where(F.col("arxiv_id") == arxiv_id).select(
        F.col("similar_id").alias("arxiv_id"), "similarity"
    )
    known = mine.join(papers.select("arxiv_id"), "arxiv_id", "left_semi")
    return known.orderBy(*knn.best_first()).limit(params.positive(limit, params.SIMILAR_LIMIT))


def by_id(
    papers: DataFrame, embeddings: DataFrame, arxiv_id: str, limit=None, similar=None, index=None
) -> DataFrame:
    """Listing rows of the papers closest to a stored paper.

    Uses the neighbour table if it has rows for the paper, else the index, else the scan.
    """
    if similar is not None:
        found = stored(similar, papers, arxiv_id, limit)
        rows = found.collect()
        if rows:
            return knn.with_papers(papers.sparkSession.createDataFrame(rows, found.schema), papers)
    if index is not None:
        hits = ivf.search_by_id(index, embeddings, arxiv_id, limit)
    else:
        hits = knn.similar_by_id(embeddings, arxiv_id, limit)
    return knn.with_papers(hits, papers)


def by_text(
    papers: DataFrame, embeddings: DataFrame, text: str, limit=None, embedder=None,
    dim: int = params.EMBED_DIM, index=None,
) -> DataFrame:
    """Listing rows of the papers closest to a free text."""
    vector = embed.embed_query(papers.sparkSession, text, embedder, dim)
    if index is not None:
        hits = ivf.search(index, vector, limit)
    else:
        hits = knn.similar_by_vector(embeddings, vector, limit)
    return knn.with_papers(hits, papers)


def lookup(papers: DataFrame, embeddings: DataFrame, text_or_id: str, **options) -> DataFrame:
    """An id-shaped argument looks up that paper, anything else is embedded as text."""
    spark = papers.sparkSession
    shaped = spark.range(1).select(looks_like_id(F.lit(text_or_id))).first()[0]
    if shaped:
        options = {k: v for k, v in options.items() if k not in ("embedder", "dim")}
        return by_id(papers, embeddings, text_or_id, **options)
    options.pop("similar", None)
    return by_text(papers, embeddings, text_or_id, **options)


def many(similar: DataFrame, papers: DataFrame, embeddings: DataFrame, ids: DataFrame, limit=None):
    """Neighbours of many papers: (arxiv_id, similar_id, similarity, rank).

    Stored neighbours that left the archive are dropped first, the limit counts what is left. Ids
    without any are compared, in blocks, with the vectors of the archive's papers.
    """
    limit = params.positive(limit, params.SIMILAR_LIMIT)
    asked = ids.select("arxiv_id").distinct()
    mine = similar.join(asked, "arxiv_id", "left_semi")
    known = mine.join(
        papers.select(F.col("arxiv_id").alias("similar_id")), "similar_id", "left_semi"
    ).select("arxiv_id", "similar_id", "similarity")
    rest = asked.join(known.select("arxiv_id"), "arxiv_id", "left_anti")
    queries = cut(embeddings.join(rest, "arxiv_id", "left_semi"), "queries")
    if not queries.isEmpty():
        there = embeddings.join(papers.select("arxiv_id"), "arxiv_id", "left_semi")
        found = neighbours.lists(queries, there, limit)
        known = known.unionByName(found.select("arxiv_id", "similar_id", "similarity"))
    best = Window.partitionBy("arxiv_id").orderBy(F.desc("similarity"), "similar_id")
    return known.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
