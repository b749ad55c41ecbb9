"""Table mutations as DataFrame merges: fold a batch, merge papers, new edges, key/value rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.operators import membership
from paperlake.operators.catalog import timestamp
from paperlake.schemas import PAPERS

REPLACED = ["title", "abstract"]
KEPT_TEXT = ["authors", "categories", "doi", "journal_ref", "full_text_path"]
KEPT = [*KEPT_TEXT[:2], "published", "updated", *KEPT_TEXT[2:]]


def _given(name: str, strict: bool, prefix: str = "") -> Column:
    """The incoming value; an empty text counts as missing unless `strict`."""
    column = F.col(f"{prefix}{name}")
    return F.nullif(column, F.lit("")) if name in KEPT_TEXT and not strict else column


def fold_batch(batch: DataFrame, order: str = "seq", strict: bool = False) -> DataFrame:
    """One row per id, as if the batch's rows were upserted one after the other by `order`.

    Aggregates keep one value per id and task, so a repeated id costs no extra shuffle.
    """
    def last(name):
        value = _given(name, strict)
        return F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(name)

    # Titles and abstracts are replaced even by NULL: take them from the last row as they are.
    text = F.max_by(F.struct(*REPLACED), F.col(order)).alias("text")
    folded = batch.groupBy("arxiv_id").agg(
        text, *[last(name) for name in KEPT], F.bool_or("has_full_text").alias("has_full_text")
    )
    return folded.select(
        "arxiv_id", *[F.col(f"text.{name}").alias(name) for name in REPLACED], *KEPT,
        "has_full_text",
    )


def merge_papers(current: DataFrame, folded: DataFrame, fetched_at, strict: bool = False):
    """The paper table after upserting a folded batch.

    `fetched_at` is the batch's own time, so that repeating a batch changes nothing. The folded
    batch and the stored side are each read once, and joined by id.
    """
    old = current.select(
        "arxiv_id",
        F.lit(True).alias("known"),
        *[F.col(c).alias(f"old_{c}") for c in PAPERS.fieldNames()[1:]],
    )
    new = folded.select(
        "arxiv_id",
        F.lit(True).alias("given"),
        *[F.col(c).alias(f"new_{c}") for c in [*REPLACED, *KEPT, "has_full_text"]],
    )
    joined = old.join(new, "arxiv_id", "full_outer")
    return joined.select(*_merged_columns(fetched_at, strict))


def _merged_columns(fetched_at, strict: bool) -> list[Column]:
    columns = {"arxiv_id": F.col("arxiv_id")}
    for name in REPLACED:
        columns[name] = F.when(F.col("given"), F.col(f"new_{name}")).otherwise(F.col(f"old_{name}"))
    for name in KEPT:
        columns[name] = F.coalesce(_given(name, strict, "new_"), F.col(f"old_{name}"))
    either = F.col("new_has_full_text") | F.col("old_has_full_text")
    columns["has_full_text"] = (
        F.when(F.col("given") & F.col("known"), either)
        .when(F.col("given"), F.col("new_has_full_text"))
        .otherwise(F.col("old_has_full_text"))
    )
    columns["fetched_at"] = F.when(F.col("given"), timestamp(fetched_at)).otherwise(
        F.col("old_fetched_at")
    )
    return [columns[c].alias(c) for c in PAPERS.fieldNames()]


def mark_full_text(papers: DataFrame, texts: DataFrame) -> DataFrame:
    """Set the full-text mark and path of the papers in `texts` (arxiv_id, full_text_path)."""
    paths = texts.groupBy("arxiv_id").agg(F.max("full_text_path").alias("_path"))
    joined = papers.join(paths, "arxiv_id", "left")
    stored = F.col("_path").isNotNull()
    return joined.withColumns(
        {
            "has_full_text": stored | F.col("has_full_text"),
            "full_text_path": F.coalesce("_path", "full_text_path"),
        }
    ).select(*papers.columns)


def new_edges(edges: DataFrame, refs: DataFrame, place: Column | None = None) -> DataFrame:
    """Distinct edges not stored yet: what an insert that ignores duplicates would add.

    With `place`, a number that the ends decide, both tables meet by it in one shuffle, and the new
    edges stay in the tasks of their places.
    """
    ends = ["from_id", "to_id"]
    if place is None:
        return membership.unknown(edges.select(*ends).distinct(), refs, *ends)
    # As in a join, an edge without one of its ends equals no stored one.
    stored = refs.where("from_id IS NOT NULL AND to_id IS NOT NULL")
    rows = edges.select(*ends, F.lit(False).alias("stored")).unionByName(
        stored.select(*ends, F.lit(True).alias("stored"))
    )
    rows = rows.withColumn("place", place).repartition("place")
    found = rows.groupBy("place", *ends).agg(F.max("stored").alias("stored"))
    return found.where("NOT stored").select(*ends)


def fold_embeddings(
    batch: DataFrame, papers: DataFrame, order: str = "seq", vectors: DataFrame | None = None
) -> DataFrame:
    """Last vector per id; unknown ids are dropped before their vectors are folded.

    A batch may name its vectors instead of holding them: `vectors` has a column of their names and
    `embedding`. Then names are folded, and only each id's last one is looked up; names without a
    vector do not count.
    """
    if vectors is None:
        wanted = membership.known(batch, papers, "arxiv_id")
        return wanted.groupBy("arxiv_id").agg(F.max_by("embedding", order).alias("embedding"))
    (name,) = [c for c in vectors.columns if c != "embedding"]
    named = batch.groupBy("arxiv_id", name).agg(F.max(order).alias(order))
    named = named.join(vectors.select(name), name, "left_semi")
    named = named.join(papers.select("arxiv_id"), "arxiv_id", "left_semi")
    last = named.groupBy("arxiv_id").agg(F.max_by(name, order).alias(name))
    found = last.join(vectors, name).select("arxiv_id", "embedding")
    return found.dropDuplicates(["arxiv_id"])


def replace_rows(current: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """`current` with the rows of `changed` added or put in place, by `key`."""
    kept = current.join(changed.select(key), key, "left_anti")
    return kept.unionByName(changed.select(*current.columns))


def fold_state(batch: DataFrame, order: str = "seq") -> DataFrame:
    """Last value per key."""
    return batch.groupBy("key").agg(F.max_by("value", order).alias("value"))
