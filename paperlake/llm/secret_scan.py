"""Secret scans with multipart credential linking, in DataFrame functions only.

Each kind's pattern is matched from left to right without overlap. `assign`, `access` and `hex`
are reported alone; `id`, `key` and `endpoint` are weak parts of a credential: an interval join
over the places within one text reports an identifier or a key where the other (or a strong
secret or identifier) lies within the scope, and an endpoint where both do.

Places are code points from 0, ends are exclusive. Defined cases: a null or empty text has no
spans; rows that repeat a `doc_id` are scanned one by one, and equal ones get equal results; rows
without `doc_id` are scanned too; further columns are ignored by `scan` and kept by `redact`; an
empty table gives no rows; equal starts are in the order of the kinds.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.session import cut

SCOPE = 300
"""Characters between the starts of linked parts."""
MASK = "<secret>"
MOST_SPANS = 1_000_000
"""Masks whose places are sent to all tasks (some 16 MB); with more the texts are shuffled."""

# The patterns, with the least length of a match or of its second group.
_ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_NAMED = r"""(?i)(client_?id|key_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.+-]+)"""
KINDS = [
    ("assign", _ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("id", _NAMED, 2, 3),
    ("key", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
    ("endpoint", r"""https?://[^\s"'<>]+""", 0, 8),
]
BASE = 3
KEY = 4
_IDENTIFIERS = (1, 3)
_SECRETS = (0, 2, 4)
_ENDPOINTS = (5,)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id", F.xxhash64("text").alias("text_id"), F.coalesce("text", F.lit("")).alias("text")
    )


def _numbered(number: int):
    """The function of a matched part that adds its kind."""
    return lambda x: F.struct(
        F.lit(number).alias("kind"), x["before"].alias("before"), x["match"].alias("match")
    )


def _matches(rows: DataFrame) -> DataFrame:
    """(doc_id, text_id, kind, place, before, match): matches in order, each with the number of
    characters since the one before."""
    kinds = []
    for number, (_, pattern, _, _) in enumerate(KINDS):
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        between = F.transform(F.split("text", pattern, -1), F.length)
        zipped = F.transform(
            F.arrays_zip(found.alias("match"), between.alias("before")), _numbered(number)
        )
        kinds.append(F.when(F.col("text").rlike(pattern), zipped))
    empty = F.array().cast("array<struct<kind:int,before:int,match:string>>")
    parts = F.concat(*(F.coalesce(k, empty) for k in kinds))
    return (
        rows.select("doc_id", "text_id", F.posexplode(parts).alias("place", "part"))
        .select("doc_id", "text_id", "place", "part.*")
        .where("match IS NOT NULL")
        .distinct()
    )


def _parts(documents: DataFrame) -> DataFrame:
    """(doc_id, text_id, kind, start, end) of the matches that are long enough."""
    ordered = Window.partitionBy("doc_id", "text_id", "kind").orderBy("place")
    end = F.sum(F.col("before") + F.length("match")).over(
        ordered.rowsBetween(Window.unboundedPreceding, 0)
    )
    length = F.length("match")
    for number, (_, pattern, group, _) in enumerate(KINDS):
        if group:
            value = F.length(F.regexp_extract("match", pattern, group))
            length = F.when(F.col("kind") == number, value).otherwise(length)
    # A key has letters and digits, which plain long words do not.
    mixed = F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]")
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("kind") + 1)
    return (
        _matches(_keyed(documents))
        .withColumn("end", end)
        .where((length >= least) & ((F.col("kind") != KEY) | mixed))
        .select("doc_id", "text_id", "kind", (F.col("end") - F.length("match")).alias("start"), "end")
    )


def spans(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_id, kind, start, end) of all reported spans; `kind` counts `KINDS` from 0."""
    near = (
        Window.partitionBy("doc_id", "text_id").orderBy("start").rangeBetween(-scope, scope)
    )

    def holds(kinds):
        return F.max(F.col("kind").isin(*kinds)).over(near)

    linked = _parts(documents).select(
        "*",
        holds(_IDENTIFIERS).alias("identified"),
        holds(_SECRETS).alias("secret"),
    )
    kind = F.col("kind")
    reported = (
        (kind < BASE)
        | ((kind == 3) & F.col("secret"))
        | ((kind == KEY) & F.col("identified"))
        | ((kind == 5) & F.col("identified") & F.col("secret"))
    )
    return linked.where(reported).drop("identified", "secret")


def _listed(spans_column):
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(
        F.transform(
            spans_column,
            lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"]),
        ),
        ",",
    )


def _by_text(documents: DataFrame, scope: int) -> DataFrame:
    span = F.struct("start", "kind", "end")
    return (
        spans(documents, scope)
        .groupBy("doc_id", "text_id")
        .agg(F.array_sort(F.collect_list(span)).alias("spans"))
        .withColumnsRenamed({"doc_id": "found_id", "text_id": "found_text"})
    )


def _with_spans(rows: DataFrame, documents: DataFrame, scope: int) -> DataFrame:
    found = _by_text(documents, scope)
    return rows.join(
        found,
        F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_id") == F.col("found_text")),
        "left",
    )


def scan(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The texts are read twice, for their rows and for their matches; only matches are shuffled.
    """
    rows = _with_spans(_keyed(documents).drop("text"), documents, scope)
    found = F.coalesce("spans", F.array().cast("array<struct<start:long,kind:int,end:long>>"))
    rows = rows.select("doc_id", found.alias("spans"))
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [
        (F.size("spans") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{kind[0]}")
        for i, kind in enumerate(KINDS[:BASE])
    ]
    base = _listed(F.filter("spans", lambda x: x["kind"] < BASE))
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(base, 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def _gaps(documents: DataFrame, scope: int) -> DataFrame:
    """Per text with spans (`__id`, `__text`): the ranges between its masks (`__gaps`, the first
    one before the first mask) and the end of the last mask (`__tail`)."""
    earlier = (
        Window.partitionBy("doc_id", "text_id")
        .orderBy("start", "end")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    opening = F.col("before").isNull() | (F.col("start") > F.col("before"))
    gap = F.struct(F.coalesce("before", F.lit(0)).alias("begin"), F.col("start").alias("end"))
    return (
        spans(documents, scope)
        .withColumn("before", F.max("end").over(earlier))
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text"))
        .agg(
            F.array_sort(F.collect_list(F.when(opening, gap))).alias("__gaps"),
            F.max("end").alias("__tail"),
        )
    )


def redact(documents: DataFrame, scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """The documents with every reported span replaced by `mask`, and `n_chars` to match.

    Spans that overlap or touch are replaced together. All rows and columns stay; a null text
    stays null. The texts stay where they are if at most `MOST_SPANS` masks are to be set, else
    they are shuffled to meet theirs.
    """
    columns = documents.columns
    found = cut(_gaps(documents, scope), "masks")
    if (found.agg(F.sum(F.size("__gaps") + 1)).first()[0] or 0) <= MOST_SPANS:
        found = F.broadcast(found)
    joined = documents.join(
        found,
        documents["doc_id"].eqNullSafe(F.col("__id"))
        & (F.xxhash64(documents["text"]) == F.col("__text")),
        "left",
    )

    def part(begin, length):
        return F.substring(F.col("text"), begin.cast("int") + 1, length.cast("int"))

    between = F.transform("__gaps", lambda gap: part(gap["begin"], gap["end"] - gap["begin"]))
    hidden = F.concat(F.array_join(between, mask), F.lit(mask), part(F.col("__tail"), F.length("text")))
    text = F.when(F.col("__gaps").isNull(), F.col("text")).otherwise(hidden)
    changed = joined.withColumn("text", text).select(*columns)
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return changed
