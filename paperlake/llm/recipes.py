"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text is normalised (each run of ASCII white space becomes one space) and cut into segments of a
few words; a segment whose hash is a multiple of `ONE_IN` ends a chunk. Cuts thus depend on the
content around them, so texts share the chunks of the passages they share, wherever these stand.
Equal texts have equal chunks. A chunk's identifier is a hash that is verified: the distinct chunks
are grouped by identifier, and if one identifier stands for two contents, the identifiers get
twice as many bits and are verified again. Texts are equal when their ordered identifiers are.

Texts are read twice, once for the chunks and once for the recipes. Distinct chunks, partly
aggregated, are the only text that moves, once; then only recipes do (16 bytes for each chunk of
some 350 characters). A group of copies of any size is aggregated before it moves, and the join
that gives each row its group is one that adaptive execution splits where a group is large.

Defined cases: a null text counts as empty, and all empty texts are equal; a text is not trimmed;
a null `doc_id` comes after all others, and the row stays if its group has no other; of rows that
repeat both the smallest `doc_id` and the text exactly one stays; further columns are ignored; an
empty table gives no rows. A text of any length is cut into chunks of bounded size.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.session import cut

SPACE = r"[\x20\x09-\x0D]+"
SEGMENT = r"(?s).{16,126}?(?:\p{P}|[adoty0369а-иα-θ] )|.{1,128}"
"""Up to 128 characters, ended after 16 by punctuation or a space after one of some letters. Such
ends are rare enough for cuts of shifted texts to fall together soon."""
ONE_IN = 8
"""One segment of so many ends a chunk."""
LONGEST = 32
"""Segments after which a chunk ends though no segment's hash ends it."""
BITS = 128


def normalised(text) -> Column:
    """The text with one space for each run of white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _segments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SEGMENT), 0)


def chunked(rows: DataFrame, text: str, name: str = "chunks") -> DataFrame:
    """`rows` with the chunks of column `text` as an array; joined they are the text."""
    rows = rows.withColumn("__segments", _segments(F.col(text)))
    ends = F.transform("__segments", lambda x: F.pmod(F.xxhash64(x), F.lit(ONE_IN)) == 0)
    rows = rows.withColumn("__cuts", ends)
    places = F.transform("__cuts", lambda here, i: F.when(_ends(here, i), i + 1))
    rows = rows.withColumn("__ends", F.array_compact(places))

    def chunk(end, k):
        first = F.when(k == 0, 0).otherwise(F.get("__ends", k - 1))
        return F.array_join(F.slice("__segments", first + 1, end - first), "")

    return rows.withColumn(name, F.transform("__ends", chunk)).drop(
        "__segments", "__cuts", "__ends"
    )


def _ends(here: Column, i: Column) -> Column:
    """Whether segment `i` ends a chunk: its hash, the text's end, or no end for too long."""
    before = F.slice("__cuts", i - (LONGEST - 2), LONGEST - 1)
    none = F.when(i % LONGEST == LONGEST - 1, ~F.exists(before, lambda x: x)).otherwise(False)
    return here | (i == F.size("__cuts") - 1) | none


def identifier(chunk, bits: int = BITS) -> Column:
    """A chunk's hash as 64-bit numbers, or one number of fewer bits."""
    if bits < 64:
        return F.array(F.pmod(F.xxhash64(chunk), F.lit(1 << bits)))
    return F.array(*(F.xxhash64(F.lit(i), chunk) for i in range(bits // 64)))


def ambiguous(chunks: DataFrame, bits: int) -> DataFrame:
    """Identifiers that stand for several contents; `chunks` has one column, `chunk`."""
    contents = chunks.select(identifier("chunk", bits).alias("id"), "chunk").distinct()
    return contents.groupBy("id").count().where("count > 1")


def verified_bits(chunks: DataFrame, bits: int = BITS) -> int:
    """The number of bits, doubled as often as needed, with which no two contents share an
    identifier."""
    while not ambiguous(chunks, bits).isEmpty():
        bits *= 2
    return bits


def recipes(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """The documents' columns, with the normalised text's SHA-256 and its recipe: the ordered
    identifiers of its chunks, verified. Neither the text nor its chunks are kept."""
    texts = documents.select(normalised(F.col("text")).alias("__text"))
    # An outer generator: for an inner one Spark would compute the chunks once more in a filter.
    chunks = chunked(texts, "__text").select(F.explode_outer("chunks").alias("chunk"))
    chunks = chunks.where("chunk IS NOT NULL")
    bits = verified_bits(chunks, bits)
    rows = documents.withColumn("__text", normalised(F.col("text"))).drop("text")
    rows = rows.withColumn("text_sha256", F.sha2("__text", 256))
    rows = chunked(rows, "__text").drop("__text")
    return rows.withColumn("recipe", F.transform("chunks", lambda x: identifier(x, bits))).drop(
        "chunks"
    )


def groups(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = recipes(documents.select("doc_id", "text"), bits)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "recipes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    copies = rows.groupBy("recipe").agg(
        F.count("*").alias("group_size"), F.min(order).alias("first")
    )
    copies = copies.where("group_size > 1").select(
        "recipe", "group_size", "first.doc_id", "first.row"
    )
    copies = copies.withColumnsRenamed({"doc_id": "first_id", "row": "first_row"})
    found = rows.join(copies, "recipe", "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("first_row"))).alias("kept"),
        "text_sha256",
    )
