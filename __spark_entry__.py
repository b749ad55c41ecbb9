"""Registered queries over the test tables, with equivalent SQL where SQL can express them."""

from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from paperlake import testviews as tv  # noqa: E402
from paperlake.functions import ids, text  # noqa: E402
from paperlake.functions.analysis import tokens  # noqa: E402
from paperlake.operators import (  # noqa: E402
    catalog,
    embed,
    graph,
    harvest,
    ivf,
    knn,
    merge,
    neighbours,
    search,
    stats,
)
from paperlake.plans import answers, similar, sync  # noqa: E402
from paperlake.functions.vectors import vector_problem  # noqa: E402
from paperlake.schemas import LIST_COLS, SEARCH_COLS  # noqa: E402
from paperlake.session import cut, scratch_path, ship_package  # noqa: E402
from paperlake.sources import inputs, outputs  # noqa: E402
from paperlake.sources.store import Archive  # noqa: E402
from paperlake.streaming.harvest import mark_key, upsert_pages  # noqa: E402

try:
    import corpus_pipeline
    from paperlake.llm import queries as llm_queries
except ImportError as error:
    # Only where the subpackage is not there; a missing library is an error.
    if not (error.name or "").startswith(("corpus_pipeline", "paperlake.llm")):
        raise
    corpus_pipeline = llm_queries = None

PAPER = "2306.00005"
AS_OF = datetime.fromisoformat(tv.AS_OF)
ONE_WORD = "Thin"
TWO_WORDS = "thin, than"
THREE_WORDS = "Than from thin!"
ENGLISH = "the thins from eren"
HASH_DIM = 64
TERM_BUCKETS = 16


def _time(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _listed(rows: DataFrame, *more) -> DataFrame:
    return rows.select("arxiv_id", "title", "authors", "categories", _time("published"), *more)


def _similarity(rows: DataFrame) -> DataFrame:
    return rows.select("arxiv_id", F.round("similarity", 6).alias("similarity"))


def _ranked(rows: DataFrame, *more) -> DataFrame:
    return rows.select(*more, "arxiv_id", F.round(F.col("rank").cast("double"), 6).alias("rank"))


# --- column expressions ------------------------------------------------------------------------


def normalize_ids(spark, sf_dir):
    raw = F.col("header.identifier")
    rows = tv.harvest_records(spark, sf_dir)
    return rows.select(raw.alias("raw"), ids.normalize_id(raw).alias("arxiv_id"))


def clean_text(spark, sf_dir):
    docs = tv.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.clean_text("text").alias("cleaned"))


def parse_dates(spark, sf_dir):
    events = tv.table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    clock = F.date_format("ts", "HH:mm:ss")
    forms = {
        "from_day": day,
        "from_instant": F.concat(day, F.lit("T"), clock, F.lit("Z")),
        "from_offset": F.concat(day, F.lit("T"), clock, F.lit(".25+02:00")),
        "from_year": F.date_format("ts", "yyyy"),
        "from_words": F.col("event_type"),
    }
    shown = [
        F.date_format(text.parse_date(form), "yyyy-MM-dd HH:mm:ss.SSS").alias(name)
        for name, form in forms.items()
    ]
    return events.select("event_id", *shown)


def classify_inputs(spark, sf_dir):
    urls = tv.table(spark, sf_dir, "pages").select(F.col("url").alias("input"))
    numbers = tv.table(spark, sf_dir, "documents").select(tv.paper_id("doc_id").alias("input"))
    names = tv.table(spark, sf_dir, "part").select(F.col("p_name").alias("input"))
    texts = tv.table(spark, sf_dir, "documents").select(F.col("text").alias("input"))
    rows = urls.union(numbers).union(names).union(texts)
    return rows.select("input", ids.looks_like_id("input").alias("is_id"))


def category_columns(spark, sf_dir):
    names = F.col("categories")
    primary = ids.primary_category(names)
    return tv.papers(spark, sf_dir).select(
        "arxiv_id",
        ids.harvest_set(names).alias("harvest_set"),
        primary.alias("primary_category"),
        ids.primary_category("categories", r"[,\s]+").alias("primary_any_separator"),
        ids.full_text_path("/data", primary, F.col("arxiv_id")).alias("path"),
        ids.request_id(F.col("arxiv_id")).alias("request_id"),
        text.embedding_text().alias("embedding_text"),
        text.searchable_text().alias("search_text"),
    )


def listing(spark, sf_dir):
    return catalog.listing(tv.papers(spark, sf_dir))


# --- harvest and enrichment --------------------------------------------------------------------


def _harvested(papers):
    return _listed(papers, "abstract", _time("updated"), "journal_ref", "has_full_text")


def harvest_papers(spark, sf_dir):
    return _harvested(harvest.records_to_papers(tv.harvest_records(spark, sf_dir)))


def _land_pages(spark, sf_dir) -> str:
    """The harvest records as XML pages in the shared folder."""
    path = scratch_path(spark, "landing")
    records = tv.harvest_records(spark, sf_dir)
    records.write.format("xml").option("rowTag", "record").option("rootTag", "ListRecords").save(
        path
    )
    return path


def harvest_pages(spark, sf_dir):
    records = inputs.harvest_records(spark, _land_pages(spark, sf_dir))
    return _harvested(harvest.records_to_papers(records))


def harvest_stream(spark, sf_dir):
    archive = Archive(spark, scratch_path(spark, "archive"), buckets=8).create()
    upsert_pages(archive, _land_pages(spark, sf_dir), scratch_path(spark, "progress"))
    return _harvested(archive.papers.read())


def page_envelopes(spark, sf_dir):
    """Resume tokens and error answers of landed pages: customers as tokens, suppliers as errors."""
    token = F.when(F.col("c_nationkey") != 0, F.concat(F.lit(" "), "c_name")).otherwise("")
    tokens = tv.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_cursor"), F.col("c_nationkey").alias("_completeListSize"),
        token.alias("_VALUE"),
    )
    code = F.when(F.col("s_nationkey") == 0, "noRecordsMatch").otherwise("badArgument")
    errors = tv.table(spark, sf_dir, "supplier").select(
        code.alias("_code"), F.concat("s_name", F.lit("\n")).alias("_VALUE")
    )
    paths = {}
    for tag, rows in (("resumptionToken", tokens), ("error", errors)):
        paths[tag] = scratch_path(spark, tag)
        pages = rows.write.format("xml").option("rowTag", tag).option("rootTag", "ListRecords")
        pages.save(paths[tag])
    found = inputs.page_tokens(spark, paths["resumptionToken"]).select(
        F.lit("token").alias("kind"), F.col("token").alias("value"),
        F.col("complete_size").cast("string").alias("code_or_size"),
        F.col("cursor").cast("string").alias("cursor"),
    )
    return found.unionByName(
        inputs.harvest_errors(spark, paths["error"]).select(
            F.lit("error").alias("kind"), F.col("message").alias("value"),
            F.col("code").alias("code_or_size"), F.lit(None).cast("string").alias("cursor"),
        )
    )


def harvest_changed(spark, sf_dir):
    """Records of two categories changed since their marks."""
    records = tv.harvest_records(spark, sf_dir)
    found = harvest.changed_since(records, {"cs.EN": "2000-01-01", "cs.FR": ""})
    return found.select(
        F.col("header.identifier").alias("identifier"),
        F.col("header.datestamp").alias("datestamp"),
    )


def category_marks(spark, sf_dir):
    records = tv.harvest_records(spark, sf_dir)
    return harvest.newest_datestamp(records, ["cs.EN", "cs.DE", "cs.FR", "cs.ES"])


def _documents(spark, sf_dir):
    return inputs.parse_documents(tv.documents(spark, sf_dir))


def document_edges(spark, sf_dir):
    return harvest.document_edges(_documents(spark, sf_dir)).groupBy("from_id", "to_id").agg(
        F.count("*").alias("n")
    )


def document_texts(spark, sf_dir):
    texts = harvest.full_texts(_documents(spark, sf_dir))
    return texts.groupBy("arxiv_id", "text").agg(F.count("*").alias("n"))


def open_access_urls(spark, sf_dir):
    return harvest.open_access_urls(_documents(spark, sf_dir))


def document_files(spark, sf_dir):
    """The payloads landed as text lines and read back: open-access addresses."""
    path = scratch_path(spark, "documents")
    tv.documents(spark, sf_dir).write.text(path)
    return harvest.open_access_urls(inputs.enrichment_documents(spark, path, lines=True))


def enrich_batches(spark, sf_dir):
    """A given service asked for the papers without full text, in batches."""

    def fetch(wanted):
        known = '{"externalIds": {"ArXiv": "%s"}, "abstract": "%d"}'
        return [known % (w.removeprefix("arXiv:"), len(w)) for w in wanted]

    queue = catalog.pending_full_text(tv.papers(spark, sf_dir), "all")
    return harvest.full_texts(embed.enrich(queue, fetch))


# --- catalog -----------------------------------------------------------------------------------


def recent_week(spark, sf_dir):
    return _listed(catalog.recent(tv.papers(spark, sf_dir), tv.AS_OF))


def recent_year(spark, sf_dir):
    return _listed(catalog.recent(tv.papers(spark, sf_dir), tv.AS_OF, days=365))


def recent_by_category(spark, sf_dir):
    return _listed(catalog.recent(tv.papers(spark, sf_dir), tv.AS_OF, "cs.E", 365))


def recent_exact_category(spark, sf_dir):
    papers = tv.papers(spark, sf_dir)
    found = papers.where(catalog.in_category("cs.EN", exact=True))
    return _listed(catalog.recent(found, tv.AS_OF, days=3000))


def _whole(rows, *more):
    """All columns of the listing endpoints."""
    times = {"published", "updated", "fetched_at"}
    return rows.select(*(_time(c) if c in times else c for c in LIST_COLS), *more)


def recent_rows(spark, sf_dir):
    """The endpoint's whole rows."""
    return _whole(catalog.recent(tv.papers(spark, sf_dir), tv.AS_OF, days=365))


def get_paper(spark, sf_dir):
    return _listed(catalog.get_paper(tv.papers(spark, sf_dir), PAPER))


def _detail(rows):
    return _listed(
        rows, "ref_count", "cited_by_count", "full_text", F.size("embedding").alias("dim")
    )


def paper_detail(spark, sf_dir):
    tables = (f(spark, sf_dir) for f in (tv.papers, tv.embeddings, tv.refs, tv.fulltext))
    return _detail(catalog.paper_detail(*tables, PAPER))


def paper_details(spark, sf_dir):
    tables = (f(spark, sf_dir) for f in (tv.papers, tv.embeddings, tv.refs, tv.fulltext))
    return _detail(catalog.paper_details(*tables))


def pending_embedding(spark, sf_dir):
    papers, vectors = tv.papers(spark, sf_dir), tv.embeddings(spark, sf_dir)
    rows = catalog.pending_embedding(papers, vectors, 500)
    return rows.select("arxiv_id", "title", "categories", _time("published"))


def pending_embedding_all(spark, sf_dir):
    papers, vectors = tv.papers(spark, sf_dir), tv.embeddings(spark, sf_dir)
    rows = catalog.pending_embedding(papers, vectors, "all")
    return rows.select("arxiv_id", "title", "categories", _time("published"))


def pending_newest(spark, sf_dir):
    """The newest of the queue, with their places, under a limit that binds."""
    queue = catalog.pending_full_text(tv.papers(spark, sf_dir), limit=25)
    order = Window.orderBy(F.desc_nulls_last("published"), "arxiv_id")
    return queue.select(
        F.row_number().over(order).alias("place"), "arxiv_id", _time("published")
    )


def pending_full_text(spark, sf_dir):
    rows = catalog.pending_full_text(tv.papers(spark, sf_dir), 500)
    return rows.select("arxiv_id", "title", "categories", _time("published"))


def known_ids(spark, sf_dir):
    parts = tv.table(spark, sf_dir, "part").select(tv.paper_id("p_partkey").alias("arxiv_id"))
    return catalog.known_ids(parts, tv.papers(spark, sf_dir))


def unknown_ids(spark, sf_dir):
    orders = tv.table(spark, sf_dir, "orders").select(tv.paper_id("o_orderkey").alias("arxiv_id"))
    return catalog.unknown_ids(orders, tv.papers(spark, sf_dir))


# --- statistics --------------------------------------------------------------------------------


def archive_stats(spark, sf_dir):
    tables = (f(spark, sf_dir) for f in (tv.papers, tv.embeddings, tv.refs, tv.sync_state))
    row = stats.archive_stats(*tables, tv.AS_OF)
    return row.withColumns(
        {name: F.date_format(name, "yyyy-MM-dd HH:mm:ss") for name in ("oldest_paper",
                                                                      "newest_paper")}
    )


def category_names(spark, sf_dir):
    return stats.category_names(tv.papers(spark, sf_dir))


def progress(spark, sf_dir):
    return stats.progress(tv.papers(spark, sf_dir), tv.embeddings(spark, sf_dir))


# --- citation graph ----------------------------------------------------------------------------


def refs_of(spark, sf_dir):
    return _listed(graph.references(tv.refs(spark, sf_dir), tv.papers(spark, sf_dir), PAPER))


def cited_by(spark, sf_dir):
    return _listed(graph.cited_by(tv.refs(spark, sf_dir), tv.papers(spark, sf_dir), PAPER))


def ref_ids(spark, sf_dir):
    return graph.reference_ids(tv.refs(spark, sf_dir), PAPER)


def cited_by_ids(spark, sf_dir):
    return graph.cited_by_ids(tv.refs(spark, sf_dir), PAPER)


def degrees(spark, sf_dir):
    return graph.degrees(tv.refs(spark, sf_dir))


def degree_of(spark, sf_dir):
    return graph.degree(tv.refs(spark, sf_dir), PAPER)


def missing_refs(spark, sf_dir):
    rows = graph.missing_references(tv.papers(spark, sf_dir), tv.refs(spark, sf_dir))
    return rows.select("arxiv_id", "title")


def missing_ref_count(spark, sf_dir):
    return graph.missing_reference_count(tv.papers(spark, sf_dir), tv.refs(spark, sf_dir))


# --- table mutation ----------------------------------------------------------------------------


def _merged(rows):
    return _listed(rows, "abstract", "doi", "has_full_text", _time("fetched_at"))


def fold_batch(spark, sf_dir):
    rows = merge.fold_batch(tv.upserts(spark, sf_dir))
    return rows.select("arxiv_id", "title", "abstract", "authors", "categories", "doi",
                       "has_full_text")


def upsert_papers(spark, sf_dir):
    """Conversation turns merged into all papers: changed, new and untouched rows."""
    folded = merge.fold_batch(tv.upserts(spark, sf_dir))
    return _merged(merge.merge_papers(tv.papers(spark, sf_dir), folded, tv.AS_OF))


def upsert_papers_strict(spark, sf_dir):
    """As before, with empty texts overwriting stored ones."""
    folded = merge.fold_batch(tv.upserts(spark, sf_dir), strict=True)
    return _merged(merge.merge_papers(tv.papers(spark, sf_dir), folded, tv.AS_OF, strict=True))


def upsert_papers_stored(spark, sf_dir):
    """The same upsert through the stored, bucketed table."""
    archive = Archive(spark, scratch_path(spark, "archive"), buckets=8).create()
    archive.papers.write(tv.papers(spark, sf_dir), whole=True)
    archive.upsert_papers(tv.upserts(spark, sf_dir), tv.AS_OF, "turns")
    return _merged(archive.papers.read())


def insert_ignore_refs(spark, sf_dir):
    """Supplier edges that are not part edges already."""
    edges = tv.table(spark, sf_dir, "lineitem").select(
        tv.paper_id("l_orderkey").alias("from_id"), tv.paper_id("l_suppkey").alias("to_id")
    )
    return merge.new_edges(edges, tv.refs(spark, sf_dir))


def update_embeddings(spark, sf_dir):
    """Each order line sets its part's vector to its supplier's; the last line wins."""
    lines = tv.table(spark, sf_dir, "lineitem").select(
        tv.paper_id("l_partkey").alias("arxiv_id"),
        F.col("l_suppkey").alias("vec_id"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("seq"),
    )
    vectors = tv.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    changed = merge.fold_embeddings(lines, tv.papers(spark, sf_dir), vectors=vectors)
    rows = merge.replace_rows(tv.embeddings(spark, sf_dir), changed, "arxiv_id")
    first = F.round(F.element_at("embedding", 1).cast("double"), 6)
    return rows.select("arxiv_id", F.size("embedding").alias("dim"), first.alias("first"))


def insert_refs_stored(spark, sf_dir):
    """Part edges, then supplier edges, through the stored tables: the copy kept by target."""
    archive = Archive(spark, scratch_path(spark, "archive"), buckets=8).create()
    archive.insert_refs(tv.refs(spark, sf_dir))
    edges = tv.table(spark, sf_dir, "lineitem").select(
        tv.paper_id("l_orderkey").alias("from_id"), tv.paper_id("l_suppkey").alias("to_id")
    )
    archive.insert_refs(edges)
    return archive.refs_by_target.read()


def mark_full_text(spark, sf_dir):
    texts = tv.table(spark, sf_dir, "labels").select(
        tv.paper_id("doc_id").alias("arxiv_id"),
        F.concat(F.lit("texts/"), F.col("quality")).alias("full_text_path"),
    )
    rows = merge.mark_full_text(tv.papers(spark, sf_dir), texts)
    return rows.select("arxiv_id", "has_full_text", "full_text_path")


def kv_upsert(spark, sf_dir):
    """Events as state changes on top of the event types seen for orders of the same number."""
    events = tv.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"),
        F.col("event_type").alias("value"),
        F.struct("ts", "event_id").alias("seq"),
    )
    current = tv.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value")
    )
    return merge.replace_rows(current, merge.fold_state(events), "key")


# --- full-text search --------------------------------------------------------------------------


def token_counts(spark, sf_dir):
    docs = tv.table(spark, sf_dir, "documents")
    return docs.select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(
        F.count("*").alias("n")
    )


def postings(spark, sf_dir):
    return _postings(search.build_postings(tv.papers(spark, sf_dir), "simple"))


def _postings(rows):
    return rows.select(
        "term",
        "arxiv_id",
        F.size("positions").alias("n"),
        F.array_min("positions").alias("first"),
        F.array_max("positions").alias("last"),
    )


def search_one_word(spark, sf_dir):
    return _ranked(search.search(tv.papers(spark, sf_dir), ONE_WORD, analyzer="simple"))


def search_two_words(spark, sf_dir):
    return _ranked(search.search(tv.papers(spark, sf_dir), TWO_WORDS, analyzer="simple"))


def search_matches(spark, sf_dir):
    """Every match of three words, ranked."""
    terms = search.analysis.query_terms(THREE_WORDS, "simple")
    found = search.matches(tv.papers(spark, sf_dir), terms, "simple")
    return _ranked(found.select("arxiv_id", search.rank_positions("positions").alias("rank")))


def search_english(spark, sf_dir):
    return _ranked(search.search(tv.papers(spark, sf_dir), ENGLISH))


def _write_index(spark, sf_dir, analyzer="simple"):
    path = scratch_path(spark, "postings")
    rows = search.build_postings(tv.papers(spark, sf_dir), analyzer)
    search.write_postings(rows, path, TERM_BUCKETS)
    return path


def _index(spark, sf_dir, analyzer="simple"):
    return search.read_postings(spark, _write_index(spark, sf_dir, analyzer))


def search_index(spark, sf_dir):
    found = search.search_index(
        _index(spark, sf_dir), THREE_WORDS, analyzer="simple", buckets=TERM_BUCKETS
    )
    return _ranked(search.with_papers(found, tv.papers(spark, sf_dir)), "title")


def search_index_english(spark, sf_dir):
    """The endpoint's whole rows, from an index of stems."""
    found = search.search_index(_index(spark, sf_dir, "english"), ENGLISH, buckets=TERM_BUCKETS)
    rows = search.with_papers(found, tv.papers(spark, sf_dir))
    times = {"published", "updated", "fetched_at"}
    shown = [_time(c) if c in times else c for c in SEARCH_COLS]
    return rows.select(*shown, F.round(F.col("rank").cast("double"), 6).alias("rank"))


def _questions(spark, sf_dir):
    items = tv.table(spark, sf_dir, "benchmark")
    first = F.get(tokens(F.col("text")), 0)
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).union(
        items.select(-1 - F.col("item_id"), first)
    )


def search_batch(spark, sf_dir):
    """Every benchmark text, and the first word of each, as queries over all papers."""
    queries = _questions(spark, sf_dir)
    path = _write_index(spark, sf_dir)
    found = search.search_batch(
        search.read_postings(spark, path), queries, analyzer="simple", buckets=TERM_BUCKETS,
        terms=search.read_terms(spark, path),
    )
    return _ranked(found, "query_id", "place")


def _changed_index(spark, sf_dir):
    """An archive whose index was built before the conversation turns were upserted."""
    archive = Archive(
        spark, scratch_path(spark, "archive"), buckets=8, term_buckets=TERM_BUCKETS
    ).create()
    archive.papers.write(tv.papers(spark, sf_dir), whole=True)
    archive.build_index("simple")
    archive.upsert_papers(tv.upserts(spark, sf_dir), tv.AS_OF, "turns")
    return archive.index()


def postings_after_upsert(spark, sf_dir):
    """The index as kept up to date by an upsert."""
    return _postings(_changed_index(spark, sf_dir).postings())


def search_after_upsert(spark, sf_dir):
    """The benchmark's queries over the index as kept up to date by an upsert."""
    found = _changed_index(spark, sf_dir).search_batch(_questions(spark, sf_dir))
    return _ranked(found, "query_id", "place")


# --- vectors -----------------------------------------------------------------------------------


def similar_by_id(spark, sf_dir):
    return _similarity(knn.similar_by_id(tv.embeddings(spark, sf_dir), PAPER))


def similar_rows(spark, sf_dir):
    """The endpoint's whole rows."""
    found = similar.by_id(tv.papers(spark, sf_dir), tv.embeddings(spark, sf_dir), PAPER)
    return _whole(found, F.round("similarity", 6).alias("similarity"))


def vector_checks(spark, sf_dir):
    """What the check says of vectors cut short by their label, and of missing ones."""
    rows = tv.table(spark, sf_dir, "embeddings")
    short = F.slice("embedding", 1, 64 - F.pmod("label", F.lit(3)))
    vector = F.when(F.col("label") != 0, short)
    return rows.select("vec_id", vector_problem(vector, 64).alias("problem"))


def similar_by_vector(spark, sf_dir):
    """A stored vector as the query: its own paper comes first."""
    vectors = tv.embeddings(spark, sf_dir)
    found = knn.similar_by_vector(vectors, knn.vector_of(vectors, PAPER))
    return _similarity(knn.with_papers(found, tv.papers(spark, sf_dir)))


def cosine_columns(spark, sf_dir):
    """Similarity of every paper with one paper, as a column expression."""
    from paperlake.functions.vectors import cosine_similarity

    vectors = tv.embeddings(spark, sf_dir)
    one = vectors.where(F.col("arxiv_id") == PAPER).select("embedding").scalar()
    rows = vectors.withColumn("other", one)
    return _similarity(
        rows.select("arxiv_id", cosine_similarity("embedding", "other").alias("similarity"))
    )


def similar_by_text(spark, sf_dir):
    """Hashed vectors of all papers, searched with a free text."""
    papers = tv.papers(spark, sf_dir)
    vectors = embed.embed_papers(papers, dim=HASH_DIM)
    found = similar.by_text(papers, vectors, "thin things", embedder=None, dim=HASH_DIM)
    return _similarity(found)


def _letters(texts):
    return [[t.count("e"), t.count("n"), len(t)] for t in texts]


def similar_by_letters(spark, sf_dir):
    """Vectors by a given embedder (letter counts), looked up with a free text."""
    papers = tv.papers(spark, sf_dir)
    vectors = embed.embed_papers(papers, _letters, 3)
    return _similarity(
        similar.lookup(papers, vectors, "thin things", embedder=_letters, dim=3, limit=10)
    )


def similar_ivf(spark, sf_dir):
    """Index search with as many cells as the table asks for, finished exactly."""
    vectors = tv.embeddings(spark, sf_dir)
    index = ivf.build(vectors, scratch_path(spark, "index"))
    return _similarity(ivf.search_by_id(index, vectors, PAPER, exact=True))


def similar_ivf_probed(spark, sf_dir):
    """The probing form: how many of the ten nearest papers it finds."""
    vectors = tv.embeddings(spark, sf_dir)
    index = ivf.build(vectors, scratch_path(spark, "index"))
    found = ivf.search_by_id(index, vectors, PAPER).select("arxiv_id")
    exact = knn.similar_by_id(vectors, PAPER)
    return exact.join(found, "arxiv_id", "left_semi").agg(F.count("*").alias("found_of_ten"))


def similar_ivf_cells(spark, sf_dir):
    """Index search over 20 cells, finished exactly, at any table size."""
    vectors = tv.embeddings(spark, sf_dir)
    index = ivf.build(vectors, scratch_path(spark, "index"), lists=20)
    return _similarity(ivf.search_by_id(index, vectors, PAPER, nprobe=3, exact=True))


def _neighbour_rows(rows):
    return rows.select("arxiv_id", "similar_id", F.round("similarity", 6).alias("similarity"),
                       "rank")


def build_similar(spark, sf_dir):
    return _neighbour_rows(neighbours.build(tv.embeddings(spark, sf_dir)))


def build_similar_blocks(spark, sf_dir):
    """The same table with small blocks, so that cells, routing and merging take part."""
    return _neighbour_rows(neighbours.build(tv.embeddings(spark, sf_dir), max_block=128))


def similar_precomputed(spark, sf_dir):
    """Stored neighbours of one paper, joined with the papers."""
    table = cut(neighbours.build(tv.embeddings(spark, sf_dir)))
    papers, vectors = tv.papers(spark, sf_dir), tv.embeddings(spark, sf_dir)
    return _similarity(similar.by_id(papers, vectors, PAPER, similar=table))


def _stored_for_labels(spark, sf_dir):
    """The neighbour table of the labelled papers only."""
    everyone = cut(neighbours.build(tv.embeddings(spark, sf_dir)), "similar")
    labelled = tv.table(spark, sf_dir, "labels").select(tv.paper_id("doc_id").alias("arxiv_id"))
    return catalog.known_ids(everyone, labelled)


def similar_filled(spark, sf_dir):
    """Neighbours of all papers: stored ones for the labelled papers, scanned for the others."""
    papers, vectors = tv.papers(spark, sf_dir), tv.embeddings(spark, sf_dir)
    stored = _stored_for_labels(spark, sf_dir)
    return _neighbour_rows(similar.many(stored, papers, vectors, papers))


def _number(name="arxiv_id"):
    return F.substring_index(name, ".", -1).cast("int")


def similar_many(spark, sf_dir):
    """Three neighbours of all papers, when the labelled papers are left in the archive and those of
    the conversations have stored neighbours."""
    papers, vectors = tv.papers(spark, sf_dir), tv.embeddings(spark, sf_dir)
    everyone = cut(neighbours.build(vectors), "similar")
    turns, labels = (tv.table(spark, sf_dir, name) for name in ("conversations", "labels"))
    stored = catalog.known_ids(everyone, turns.select(tv.paper_id("conv_id").alias("arxiv_id")))
    left = catalog.known_ids(papers, labels.select(tv.paper_id("doc_id").alias("arxiv_id")))
    return _neighbour_rows(similar.many(stored, left, vectors, papers, limit=3))


def similar_recall(spark, sf_dir):
    """Whether searching as many cells as a sample asks for finds nine tenths of the ten nearest
    papers of all papers with a number divisible by 20, over cells of at most 32 papers."""
    vectors = tv.embeddings(spark, sf_dir)
    asked = cut(vectors.where(_number() % 20 == 0), "asked")
    exact = neighbours.lists(asked, vectors)
    probed = neighbours.lists(asked, vectors, max_block=32, recall=0.95)
    hits = probed.select("arxiv_id", "similar_id", F.lit(1).alias("hit"))
    found = exact.join(hits, ["arxiv_id", "similar_id"], "left")
    return found.agg(
        F.count_distinct("arxiv_id").alias("asked"),
        F.count("*").alias("neighbours"),
        (F.count("hit") >= 0.9 * F.count("*")).alias("nine_tenths_found"),
    )


def similar_lookup(spark, sf_dir):
    """An id-shaped argument finds that paper's neighbours."""
    papers, vectors = tv.papers(spark, sf_dir), tv.embeddings(spark, sf_dir)
    return _similarity(similar.lookup(papers, vectors, PAPER))


def embed_pending(spark, sf_dir):
    """Hashed vectors of the papers without one: length and norm."""
    queue = catalog.pending_embedding(
        tv.papers(spark, sf_dir), tv.embeddings(spark, sf_dir), "all"
    )
    rows = embed.embed_papers(queue, dim=HASH_DIM)
    from paperlake.functions.vectors import dot

    norm = F.round(F.sqrt(dot("embedding", "embedding")), 4)
    return rows.select("arxiv_id", F.size("embedding").alias("dim"), norm.alias("norm"))


def embed_batches(spark, sf_dir):
    """A given embedder called in batches: here, letter counts of all papers."""

    rows = embed.embed_papers(tv.papers(spark, sf_dir), _letters, 3)
    parts = [F.element_at("embedding", i).cast("long").alias(f"v{i}") for i in (1, 2, 3)]
    return rows.select("arxiv_id", *parts, "failed")


# --- answers and runs --------------------------------------------------------------------------


def _read_answer(lines):
    shape = "arxiv_id string, title string, published string, source string, count long"
    return lines.select("part", F.from_json("value", shape).alias("r")).select("part", "r.*")


def answer_cited_by(spark, sf_dir):
    """Header and lines of the papers citing one paper, read back."""
    return _read_answer(answers.cited_by(tv.refs(spark, sf_dir), tv.papers(spark, sf_dir), PAPER))


def answer_lines(spark, sf_dir):
    """The lines alone."""
    rows = answer_cited_by(spark, sf_dir).where("part = 'cited_by'")
    return rows.select("arxiv_id", "title", "published")


def answer_refs(spark, sf_dir):
    """Header and lines of the papers one paper cites, read back."""
    return _read_answer(answers.references(tv.refs(spark, sf_dir), tv.papers(spark, sf_dir), PAPER))


def answer_recent(spark, sf_dir):
    """The recent listing as one JSON answer, read back."""
    answer = answers.recent(tv.papers(spark, sf_dir), tv.AS_OF, days=365)
    shape = "category string, days int, count long, papers array<struct<arxiv_id:string>>"
    read = answer.select(F.from_json("value", shape).alias("r")).select("r.*")
    return read.select("category", "days", "count", F.posexplode("papers")).select(
        "category", "days", "count", F.col("pos").alias("place"), F.col("col.arxiv_id")
    )


def full_text_store(spark, sf_dir):
    """Full texts written by category and attached to the marked papers again."""
    path = scratch_path(spark, "texts")
    outputs.write_full_texts(tv.fulltext(spark, sf_dir), path, "first")
    rows = catalog.attach_full_text(
        tv.papers(spark, sf_dir), outputs.read_full_texts(spark, path)
    )
    return rows.select("arxiv_id", F.length("full_text").alias("n_chars"))


def state_stored(spark, sf_dir):
    """The categories' marks, kept in the sync state and set again with their counts."""
    archive = Archive(spark, scratch_path(spark, "archive"), buckets=8).create()
    records = tv.harvest_records(spark, sf_dir)
    marks = harvest.newest_datestamp(records, ["cs.EN", "cs.DE", "cs.FR", "cs.ES"]).collect()
    archive.set_state(**{mark_key(m.category): "" for m in marks}, other="kept")
    archive.set_state(**{mark_key(m.category): m.datestamp for m in marks})
    return archive.state.read()


def _synced(spark, sf_dir, *steps):
    archive = Archive(spark, scratch_path(spark, "archive"), buckets=8).create()
    for step in steps:
        sync.run(
            archive,
            step,
            landing=_land_pages(spark, sf_dir) if step in ("", "metadata") else None,
            checkpoint=scratch_path(spark, "progress"),
            documents=_documents(spark, sf_dir),
            embedder=sync.HASHED,
            dim=HASH_DIM,
            now=AS_OF,
        )
    return archive


def sync_texts(spark, sf_dir):
    """Texts stored by the first two steps, with their paper's category."""
    archive = _synced(spark, sf_dir, "metadata", "fulltext")
    texts = outputs.read_full_texts(spark, archive.fulltext_path)
    return texts.select("arxiv_id", "category", F.length("text").alias("n_chars"))


def sync_record(spark, sf_dir):
    """What a run of all steps leaves in the sync state, but for its duration."""
    kept = F.col("key").startswith("run_") | (F.col("key") == "last_sync")
    return _synced(spark, sf_dir, "").state.read().where(kept)


def sync_run(spark, sf_dir):
    """All four steps from landed pages and documents; then the state of the archive."""
    archive = Archive(spark, scratch_path(spark, "archive"), buckets=8).create()
    sync.run(
        archive,
        landing=_land_pages(spark, sf_dir),
        checkpoint=scratch_path(spark, "progress"),
        documents=_documents(spark, sf_dir),
        embedder=sync.HASHED,
        dim=HASH_DIM,
    )
    papers, refs = archive.papers.read(), archive.refs.read()
    counts = stats.progress(papers, archive.embeddings.read())
    missing = graph.missing_reference_count(papers, refs).scalar()
    texts = outputs.read_full_texts(spark, archive.fulltext_path).agg(F.count("*")).scalar()
    edges = refs.agg(F.count("*")).scalar()
    back = archive.refs_by_target.read().agg(F.count("*")).scalar()
    return counts.select(
        "*", texts.alias("texts"), edges.alias("edges"), back.alias("edges_by_target"),
        missing.alias("missing_refs"),
    )


_QUERIES = [
    normalize_ids, clean_text, parse_dates, classify_inputs, category_columns, listing,
    harvest_papers, harvest_pages, page_envelopes, harvest_stream, harvest_changed, category_marks,
    document_edges, document_texts, open_access_urls, document_files, enrich_batches,
    recent_week, recent_year, recent_rows, recent_by_category, recent_exact_category, get_paper, paper_detail, paper_details,
    pending_embedding, pending_embedding_all, pending_newest, pending_full_text, known_ids, unknown_ids,
    archive_stats, category_names, progress,
    refs_of, cited_by, ref_ids, cited_by_ids, degrees, degree_of, missing_refs,
    missing_ref_count,
    fold_batch, upsert_papers, upsert_papers_strict, upsert_papers_stored, insert_ignore_refs,
    insert_refs_stored, update_embeddings, mark_full_text, kv_upsert,
    token_counts, postings, search_one_word, search_two_words, search_matches, search_english,
    search_index, search_index_english, search_batch, postings_after_upsert, search_after_upsert,
    similar_by_id, similar_rows, vector_checks, similar_by_vector, cosine_columns, similar_by_text, similar_by_letters, similar_ivf,
    similar_ivf_cells, similar_ivf_probed, build_similar, build_similar_blocks, similar_precomputed,
    similar_filled, similar_many, similar_recall, similar_lookup, embed_pending, embed_batches,
    answer_lines, answer_cited_by, answer_refs, answer_recent, full_text_store, state_stored, sync_texts,
    sync_record, sync_run,
]


def _ready(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: every benchmark text searched in all papers, on the smallest tables."""
    ship_package(spark)
    return search_batch(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries by name; each takes (spark, sf_dir)."""
    found = {query.__name__: query for query in _QUERIES}
    if llm_queries is not None:
        found |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return {name: _ready(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    """Equivalent SQL by query name."""
    from oracle_queries import ORACLES

    found = dict(ORACLES)
    if llm_queries is not None:
        found |= llm_queries.ORACLES
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
