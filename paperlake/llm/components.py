"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.session import cut


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or with `both` off the smaller ones and itself)
    linked with the smallest node among its neighbours and itself."""
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        ends = ends.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = ends.join(least, "u")
    if both:
        linked = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return linked.where("a > b").distinct()


def _state(edges: DataFrame):
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge (`a`, `b`); the component is its smallest node.

    Edges with equal ends or a null end are left out. Hot nodes are pre-aggregated before they
    are shuffled, and each round is written to the shared folder. The number of rounds is
    logarithmic in the longest path.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut(pairs.distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = cut(_star(_star(now, True), False), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
