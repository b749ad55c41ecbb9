"""From landed records to papers and edges."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.ids import harvest_set, normalize_id
from paperlake.functions.text import clean_text, format_authors, full_text_body, parse_date

# Header status of a removed record, error code of an empty answer.
DELETED = "deleted"
NO_RECORDS = "noRecordsMatch"


def _raw(name: str) -> Column:
    return F.coalesce(F.col(f"metadata.arXiv.`{name}`"), F.lit(""))


def records_to_papers(records: DataFrame, *keep: str) -> DataFrame:
    """Cleaned paper rows; deleted records and records without any id are dropped.

    `keep` names further columns of `records` to carry along, such as an order column.
    """
    live = records.where(~F.col("header._status").eqNullSafe(DELETED))
    own_id = F.nullif(_raw("id"), F.lit(""))
    header_id = normalize_id(F.col("header.identifier"))
    arxiv_id = F.coalesce(own_id, F.nullif(header_id, F.lit("")))
    return live.select(
        arxiv_id.alias("arxiv_id"),
        clean_text(_raw("title")).alias("title"),
        clean_text(_raw("abstract")).alias("abstract"),
        format_authors(F.col("metadata.arXiv.authors.author")).alias("authors"),
        _raw("categories").alias("categories"),
        parse_date(_raw("created")).alias("published"),
        parse_date(_raw("updated")).alias("updated"),
        _raw("doi").alias("doi"),
        _raw("journal-ref").alias("journal_ref"),
        F.lit(False).alias("has_full_text"),
        F.lit("").alias("full_text_path"),
        *keep,
    ).where(F.col("arxiv_id").isNotNull())


def in_categories(records: DataFrame, categories: list[str]) -> DataFrame:
    """Records listed in the sets of the wanted categories."""
    sets = F.array(*[harvest_set(F.lit(c)) for c in categories])
    return records.where(F.arrays_overlap("header.setSpec", sets))


def newest_datestamp(records: DataFrame, categories: list[str]) -> DataFrame:
    """Records and largest datestamp per wanted category: (category, records, datestamp)."""
    spark = records.sparkSession
    wanted = spark.createDataFrame([(c,) for c in categories], "category string")
    wanted = wanted.select("category", harvest_set(F.col("category")).alias("set"))
    listed = records.select(
        F.explode("header.setSpec").alias("set"), F.col("header.datestamp").alias("datestamp")
    )
    # Categories are a short argument list; counts are combined per task before the shuffle.
    return (
        listed.join(wanted, "set")
        .groupBy("category")
        .agg(F.count("*").alias("records"), F.max("datestamp").alias("datestamp"))
    )


def changed_since(records: DataFrame, marks: dict[str, str]) -> DataFrame:
    """Records of the categories in `marks`, each from its mark on (an empty mark takes all)."""
    wanted = F.lit(False)
    for category, mark in marks.items():
        listed = F.array_contains("header.setSpec", harvest_set(F.lit(category)))
        recent = F.col("header.datestamp") >= mark if mark else F.lit(True)
        wanted = wanted | (listed & recent)
    return records.where(wanted)


def _edges(column: str, edge) -> Column:
    """Edges to the items of a list column that have an id, as an array."""
    ids = F.transform(column, lambda link: link["externalIds"]["ArXiv"])
    edges = F.transform(F.filter(ids, lambda i: i != ""), edge)
    return F.coalesce(edges, F.array())


def _outgoing() -> Column:
    own = F.col("externalIds.ArXiv")
    return _edges("references", lambda i: F.struct(own.alias("from_id"), i.alias("to_id")))


def _incoming() -> Column:
    own = F.col("externalIds.ArXiv")
    return _edges("citations", lambda i: F.struct(i.alias("from_id"), own.alias("to_id")))


def outgoing_edges(documents: DataFrame) -> DataFrame:
    """(paper, cited paper) for every listed reference that has an id."""
    return documents.select(F.inline(_outgoing()))


def incoming_edges(documents: DataFrame) -> DataFrame:
    """(citing paper, paper) for every listed citation that has an id."""
    return documents.select(F.inline(_incoming()))


def document_edges(documents: DataFrame) -> DataFrame:
    """Both directions in one pass over the documents."""
    return documents.select(F.inline(F.concat(_outgoing(), _incoming())))


def slim(documents: DataFrame) -> DataFrame:
    """The documents with only what their texts and edges are taken from."""
    def linked(column):
        ids = F.filter(
            F.transform(column, lambda link: link["externalIds"]["ArXiv"]), lambda i: i != ""
        )
        struct = F.transform(ids, lambda i: F.struct(F.struct(i.alias("ArXiv")).alias("externalIds")))
        return struct.alias(column)

    return documents.select(
        F.struct(F.col("externalIds.ArXiv").alias("ArXiv")).alias("externalIds"),
        "abstract",
        F.struct(F.col("tldr.text").alias("text")).alias("tldr"),
        linked("references"),
        linked("citations"),
    )


def full_texts(documents: DataFrame) -> DataFrame:
    """(arxiv_id, text) of documents that have an abstract or a short summary."""
    text = full_text_body(F.col("abstract"), F.col("tldr.text"))
    rows = documents.select(F.col("externalIds.ArXiv").alias("arxiv_id"), text.alias("text"))
    return rows.where(F.col("text") != "")


def open_access_urls(documents: DataFrame) -> DataFrame:
    """(arxiv_id, url) of documents with an open-access file."""
    rows = documents.select(
        F.col("externalIds.ArXiv").alias("arxiv_id"), F.col("openAccessPdf.url").alias("url")
    )
    return rows.where(F.col("url") != "")
