"""Identifier and category expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.functions.text import trimmed

# The harvest feed's identifier prefix and the enrichment service's.
HARVEST_PREFIX = r"\Aoai:arXiv\.org:"
REQUEST_PREFIX = "arXiv:"
UNKNOWN_CATEGORY = "unknown"


def normalize_id(raw) -> Column:
    """Drop the feed prefix, then a trailing version such as `v2`."""
    bare = F.regexp_replace(raw, HARVEST_PREFIX, "")
    return F.regexp_replace(bare, r"(?s)\A(.+)v[0-9]+\z", "$1")


def looks_like_id(text) -> Column:
    """True for strings shaped like an id: a dot as fifth byte (9+ bytes), or any slash."""
    s = trimmed(text)
    fifth_byte = F.substring(F.encode(s, "UTF-8"), 5, 1)
    return (
        F.when(F.contains(s, F.lit(" ")), False)
        .when((F.octet_length(s) >= 9) & (fifth_byte == F.expr("X'2E'")), True)
        .otherwise(F.contains(s, F.lit("/")))
    )


def harvest_set(category) -> Column:
    """`cs.AI` becomes the feed's set name `cs:cs:AI`."""
    return F.regexp_replace(category, r"(?s)\A([^.]*)\.(.*)\z", "$1:$1:$2")


def primary_category(categories, separator=",") -> Column:
    """First element of a category list. `separator` is a regex; `[,\\s]+` reads both styles."""
    first = trimmed(F.element_at(F.split(trimmed(categories), separator), 1))
    return F.coalesce(F.nullif(first, F.lit("")), F.lit(UNKNOWN_CATEGORY))


def full_text_path(root, category, arxiv_id) -> Column:
    folder = F.replace(category, F.lit("."), F.lit("/"))
    return F.concat_ws("/", F.lit(root), folder, F.concat(arxiv_id, F.lit(".txt")))


def request_id(arxiv_id) -> Column:
    prefixed = F.startswith(arxiv_id, F.lit(REQUEST_PREFIX))
    return F.when(prefixed, arxiv_id).otherwise(F.concat(F.lit(REQUEST_PREFIX), arxiv_id))
