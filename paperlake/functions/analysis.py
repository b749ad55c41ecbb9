"""Full-text analysis: positioned terms of documents and of queries.

Tokens are cut by Spark (`regexp_extract_all`). Grouping them into terms happens inside Arrow
batches: a document's tokens sit in one row, so no token is ever shuffled.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.functions.stemming import english_term

TOKEN_CHARACTER = r"[\p{L}\p{N}]"
TOKEN = f"{TOKEN_CHARACTER}+"

ANALYZERS = ("simple", "english")


def tokens(text) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def term_of(analyzer: str):
    """Function from a token to its index term (None: not indexed)."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer: {analyzer}")
    return english_term if analyzer == "english" else (lambda token: token)


def query_terms(query: str, analyzer: str = "english") -> list[str]:
    """Distinct index terms of one query string; all of them must match."""
    words = re.findall(r"[^\W_]+", query.lower())
    found = (term_of(analyzer)(word) for word in words)
    return sorted({term for term in found if term is not None})


def distinct_terms(token_lists, analyzer: str) -> Column:
    """Distinct index terms of an array-of-tokens column."""
    if analyzer == "simple":
        return F.array_distinct(token_lists)

    to_term = term_of(analyzer)

    @F.arrow_udf("array<string>")
    def analyse(lists: pa.Array) -> pa.Array:
        encoded = lists.flatten().dictionary_encode()
        mapped = pa.array([to_term(t) for t in encoded.dictionary.to_pylist()], pa.string())
        return pa.ListArray.from_arrays(_offsets(lists), mapped.take(encoded.indices))

    return F.array_distinct(F.filter(analyse(token_lists), lambda t: t.isNotNull()))


def _offsets(lists: pa.Array) -> pa.Array:
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())


def group_positions(lists: pa.Array, to_term) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Group the tokens of a batch of documents by (document, term).

    Gives the document's row in the batch, the term, and all its ascending positions. Dropped
    tokens still count as positions.
    """
    offsets = _offsets(lists).to_numpy()
    lengths = np.diff(offsets)
    docs = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(offsets[-1]) - offsets[docs] + 1

    encoded = lists.flatten().dictionary_encode()
    codes = {}
    code_of_word = np.array(
        [
            -1 if (term := to_term(word)) is None else codes.setdefault(term, len(codes))
            for word in encoded.dictionary.to_pylist()
        ],
        dtype=np.int64,
    )
    terms = code_of_word[encoded.indices.to_numpy(zero_copy_only=False)] if len(docs) else docs
    kept = terms >= 0
    docs, places, terms = docs[kept], places[kept], terms[kept]

    order = np.lexsort((places, terms, docs))
    docs, places, terms = docs[order], places[order], terms[order]
    starts = np.flatnonzero(
        np.concatenate(([True], (docs[1:] != docs[:-1]) | (terms[1:] != terms[:-1])))[: len(docs)]
    )
    bounds = np.concatenate((starts, [len(docs)]))
    positions = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(places, pa.int32()))
    names = pa.array(list(codes), pa.string())
    return docs[starts], names.take(pa.array(terms[starts], pa.int64())), positions
