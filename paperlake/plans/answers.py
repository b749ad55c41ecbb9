"""The archive's answers as JSON: one function per endpoint."""

from pyspark.sql import DataFrame

from paperlake import params
from paperlake.operators import catalog, graph, search, stats
from paperlake.plans import similar
from paperlake.sources.outputs import envelope, headed_lines, json_rows


def paper(papers, embeddings, refs, fulltext, arxiv_id: str) -> DataFrame:
    """One paper with counts and text; no row when it is not in the archive."""
    return json_rows(catalog.paper_detail(papers, embeddings, refs, fulltext, arxiv_id))


def search_papers(
    papers, query: str, limit=None, analyzer: str = "english", index=None
) -> DataFrame:
    """The best papers, from the archive's index where there is one, else by a scan."""
    if index is None:
        found = search.search(papers, query, limit, analyzer)
    else:
        found = search.with_papers(index.search(query, limit), papers)
        found = found.orderBy(*search.best_first())
    return envelope(found, query=query)


def similar_papers(papers, embeddings, arxiv_id: str, limit=None, **sources) -> DataFrame:
    return envelope(similar.by_id(papers, embeddings, arxiv_id, limit, **sources), source=arxiv_id)


def similar_to_text(papers, embeddings, text: str, limit=None, **options) -> DataFrame:
    return envelope(similar.by_text(papers, embeddings, text, limit, **options), query=text)


def recent(papers, as_of, category: str = "", days=None, limit=None) -> DataFrame:
    days = params.positive(days, params.RECENT_DAYS)
    rows = catalog.recent(papers, as_of, category, days, limit)
    return envelope(rows, category=category, days=days)


def references(refs, papers, arxiv_id: str) -> DataFrame:
    """A header line and JSON lines, as the answer has no limit."""
    return headed_lines(graph.references(refs, papers, arxiv_id), "refs", source=arxiv_id)


def cited_by(refs, papers, arxiv_id: str) -> DataFrame:
    """A header line and JSON lines, as the answer has no limit."""
    return headed_lines(graph.cited_by(refs, papers, arxiv_id), "cited_by", source=arxiv_id)


def archive_stats(papers, embeddings, refs, sync_state, as_of) -> DataFrame:
    return json_rows(stats.archive_stats(papers, embeddings, refs, sync_state, as_of))
