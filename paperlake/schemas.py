"""Declared schemas of the archive's tables and of its two input formats."""

from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PAPERS = T.StructType(
    [
        T.StructField("arxiv_id", _S, False),
        T.StructField("title", _S, False),
        T.StructField("abstract", _S),
        T.StructField("authors", _S),
        T.StructField("categories", _S),
        T.StructField("published", T.TimestampNTZType()),
        T.StructField("updated", T.TimestampNTZType()),
        T.StructField("doi", _S),
        T.StructField("journal_ref", _S),
        T.StructField("has_full_text", T.BooleanType()),
        T.StructField("full_text_path", _S),
        T.StructField("fetched_at", T.TimestampNTZType()),
    ]
)

# Kept next to `published` in the stored table: Parquet skips row groups by dates, not by
# timestamps without time zone.
PUBLISHED_DAY = T.StructField("published_day", T.DateType())

# Vectors live in their own table, so that a metadata upsert never rewrites them.
EMBEDDINGS = T.StructType(
    [
        T.StructField("arxiv_id", _S, False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
    ]
)

REFS = T.StructType([T.StructField("from_id", _S, False), T.StructField("to_id", _S, False)])

SIMILAR = _struct(arxiv_id=_S, similar_id=_S, similarity=T.DoubleType(), rank=T.IntegerType())

SYNC_STATE = T.StructType([T.StructField("key", _S, False), T.StructField("value", _S)])

FULLTEXT = _struct(arxiv_id=_S, text=_S, category=_S)

POSTINGS = _struct(term=_S, arxiv_id=_S, positions=T.ArrayType(T.IntegerType(), False))

# One <record> of a harvest page; attributes carry a leading underscore.
OAI_RECORD = _struct(
    header=_struct(_status=_S, identifier=_S, datestamp=_S, setSpec=T.ArrayType(_S)),
    metadata=_struct(
        arXiv=T.StructType(
            [
                T.StructField("id", _S),
                T.StructField("created", _S),
                T.StructField("updated", _S),
                T.StructField(
                    "authors",
                    _struct(author=T.ArrayType(_struct(keyname=_S, forenames=_S))),
                ),
                T.StructField("title", _S),
                T.StructField("categories", _S),
                T.StructField("abstract", _S),
                T.StructField("doi", _S),
                T.StructField("journal-ref", _S),
            ]
        )
    ),
)

OAI_TOKEN = _struct(_VALUE=_S, _completeListSize=_S, _cursor=_S)
OAI_ERROR = _struct(_VALUE=_S, _code=_S)

_EXTERNAL = _struct(ArXiv=_S, DOI=_S)
_LINKED = T.ArrayType(_struct(paperId=_S, externalIds=_EXTERNAL, title=_S))

S2_PAPER = _struct(
    paperId=_S,
    externalIds=_EXTERNAL,
    title=_S,
    abstract=_S,
    tldr=_struct(model=_S, text=_S),
    publicationDate=_S,
    openAccessPdf=_struct(url=_S, status=_S),
    references=_LINKED,
    citations=_LINKED,
)

# Column lists returned by the endpoints.
PAPER_COLS = [f.name for f in PAPERS.fields]
SEARCH_COLS = [c for c in PAPER_COLS if c != "full_text_path"]
LIST_COLS = [c for c in SEARCH_COLS if c not in ("doi", "journal_ref")]
EMBED_QUEUE_COLS = ["arxiv_id", "title", "abstract", "categories", "published"]
TEXT_QUEUE_COLS = ["arxiv_id", "title", "categories", "published"]
