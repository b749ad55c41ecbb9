"""What each filter removes in every order of the filters, by folds over counted masks.

Every document gets one mask of the filters it fails. Documents are counted by part and mask, with
those labelled good and toxic, so the orders are never applied to documents: each of the at most
32 masks of a part is folded across the array of all orders (`transform` over the orders,
`aggregate` over the steps of one), which gives one struct for each order and step, weighted by the
mask's counts; the structs of all masks are added element by element.

The filters: `A` under 50 words; `B` 100 * distinct words < 65 * words; `C` 100 * upper-case ASCII
letters > 5 * code points; `D` any of `#$%&*|`; `E` a document of a smaller `doc_id` in the whole
table has the same text. Equal texts are found by SHA-256. Texts are read once; only a digest of a text, its
mask, id and part are shuffled. A text that fills a third of the table is counted in each task before it moves,
and so are parts.

Defined cases: a null text counts as empty; a null part is the empty string; a null `doc_id` is
neither smaller nor larger than another, so it neither fails `E` nor makes others fail; rows that
repeat both `doc_id` and text do not make each other fail; a document is good (toxic) if any label
row of its id is; further columns are ignored; an empty table gives no rows.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.session import cut

from .recipes import SPACE

FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
SIGNS = "[#$%&*|]"


def failures(text) -> list[Column]:
    """Whether a text fails each of the filters that look at it alone: `A` to `D`."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n < 50,
        F.lit(100) * distinct.cast("long") < F.lit(65) * n.cast("long"),
        F.lit(100) * upper.cast("long") > F.lit(5) * F.length(text).cast("long"),
        text.rlike(SIGNS),
    ]


def _mask(fails: list[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: id, part, digest, mask of `A` to `D`, good, toxic."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        _mask(failures(text)).alias("mask"),
    )
    flags = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    rows = rows.join(flags, "id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by part and whole mask: part, mask, n, good, toxic."""
    own = ["digest", "mask", "part"]
    weights = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    rows = labelled(documents, labels)
    # The rows of one id come first, so that those of a text's smallest id can be told apart.
    by_id = rows.groupBy(*own, "id").agg(*weights)
    counts = F.struct("n", "good", "toxic")
    one = by_id.groupBy(*own).agg(
        *(F.sum(c).alias(c) for c in ("n", "good", "toxic")),
        F.min("id").alias("least"),
        F.min_by(counts, "id").alias("at_least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("n_null"),
        F.sum(F.when(F.col("id").isNull(), F.col("good"))).alias("good_null"),
        F.sum(F.when(F.col("id").isNull(), F.col("toxic"))).alias("toxic_null"),
    )
    one = cut(one, "texts")
    first = one.groupBy("digest").agg(F.min("least").alias("first"))
    one = one.join(first, "digest")

    def passing(name):
        least = F.when(F.col("least") == F.col("first"), F.col("at_least")[name])
        return F.coalesce(least, F.lit(0)) + F.coalesce(f"{name}_null", F.lit(0))

    failing = 1 << FILTERS.index("E")
    both = F.array(
        F.struct("mask", *(passing(c).alias(c) for c in ("n", "good", "toxic"))),
        F.struct(
            (F.col("mask") + failing).alias("mask"),
            *((F.col(c) - passing(c)).alias(c) for c in ("n", "good", "toxic")),
        ),
    )
    split = one.select("part", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def orders() -> list[list[int]]:
    """All orders of the filters, each as the filters' numbers."""
    return [list(order) for order in permutations(range(len(FILTERS)))]


def _fold(cell: Column, order: Column) -> Column:
    """One struct for each step of an order, for the documents of one mask."""
    zero = F.lit(0).cast("long")

    def fails(f):
        return F.call_function("getbit", cell["mask"], f) == 1

    def step(done, f):
        lost = fails(f) & ~done["gone"]
        gone = done["gone"] | fails(f)
        alone = cell["mask"] == F.call_function("shiftleft", F.lit(1), f)
        values = [
            F.when(gone, zero).otherwise(cell["n"]),
            F.when(lost, cell["n"]).otherwise(zero),
            F.when(fails(f) & done["gone"], cell["n"]).otherwise(zero),
            F.when(alone, cell["n"]).otherwise(zero),
            F.when(lost, cell["good"]).otherwise(zero),
            F.when(lost, cell["toxic"]).otherwise(zero),
        ]
        counts = F.struct(*(v.alias(c) for v, c in zip(values, COUNTS, strict=True)))
        return F.struct(
            gone.alias("gone"), F.concat(done["steps"], F.array(counts)).alias("steps")
        )

    counts = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(counts).alias("steps"))
    return F.aggregate(order, start, step, lambda done: done["steps"])


def _added(left: Column, right: Column) -> Column:
    def both(a, b):
        return F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS))

    return F.when(F.size(left) == 0, right).otherwise(F.zip_with(left, right, both))


def interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: part, filter_order, step, `COUNTS`, shapley."""
    every = orders()
    per_part = masks(documents, labels).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")
    )
    numbers = F.lit(every)
    none = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")
    folded = F.aggregate(
        "cells",
        none,
        lambda done, cell: _added(
            done, F.flatten(F.transform(numbers, lambda order: _fold(cell, order)))
        ),
    )
    filters = F.flatten(numbers)
    per_part = per_part.select("part", folded.alias("steps"))
    # Removed by each filter over all orders, in the filters' order.
    shares = F.transform(
        F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)),
        lambda f: F.aggregate(
            F.zip_with(
                "steps", filters, lambda s, own: F.when(own == f, s["removed"]).otherwise(0)
            ),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        ),
    )
    rows = per_part.select("part", shares.alias("shares"), F.posexplode_outer("steps"))
    place = F.col("pos")
    order = F.get(numbers, F.floor(place / len(FILTERS)).cast("int"))
    names = F.transform(order, lambda f: F.substring(F.lit(FILTERS), f + 1, 1))
    rows = rows.withColumn("own", order)
    return rows.select(
        "part",
        F.array_join(names, "").alias("filter_order"),
        (place % len(FILTERS) + 1).alias("step"),
        *(F.col(f"col.{c}").alias(c) for c in COUNTS),
        F.get("shares", F.get("own", place % len(FILTERS))).alias("shapley"),
    )
