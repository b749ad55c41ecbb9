"""Two-level cells of vectors by direction: coarse cells, and fine cells inside each.

For `c` cells there are about sqrt(c) coarse centroids, trained on a sample that comes to the
driver (`SAMPLE` rows for each), and each coarse cell trains its fine centroids in a task of its
own, again on `SAMPLE` rows for each. Training thus costs in the order of `c` comparisons, and a
vector is compared with some 2 sqrt(c) centroids, never with all. Fine centroids are a table; only
the coarse ones travel with tasks. Every vector gets a cell, sampled or not.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.operators import knn
from paperlake.session import cut

SAMPLE = 64
"""Training rows for each centroid."""
ROUNDS = 10
TASK_BYTES = 16 << 20
"""Bytes of vectors that one task holds at a time."""
PLACED_ROWS = 4096
"""Vectors compared with the fine centroids at a time."""

# Slack for comparing angles computed in floating point.
ANGLE_SLACK = 1e-6


def kmeans(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most `k` unit centroids of unit rows, by cosine."""
    centroids = rows[np.random.default_rng(seed).permutation(len(rows))[:k]]
    for _ in range(ROUNDS):
        own = (rows @ centroids.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        filled, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(rows[order], first, axis=0)
        moved = np.linalg.norm(sums, axis=1) > 0
        centroids = centroids.copy()
        centroids[filled[moved]] = knn.unit_rows(sums[moved])
    return centroids


def rows_per_task(dim: int) -> int:
    """Vectors of `dim` numbers that a task holds at a time."""
    return max(TASK_BYTES // (4 * max(dim, 1)), 1)


def share(name: str, parts: Column) -> Column:
    """One of `parts` numbers, by the hash of a column."""
    return F.pmod(F.xxhash64(F.lit("part"), name), parts).cast("int")


def by_cell(values) -> Column:
    """A value for each coarse cell, as an array the size of which is the number of these cells."""
    return F.element_at(F.lit([float(v) for v in values]), F.col("coarse") + 1)


def _allotted(cells: int, sizes: np.ndarray) -> np.ndarray:
    """The number of fine cells of each coarse one, in proportion, at least one."""
    wanted = cells * sizes / sizes.sum()
    fines = np.maximum(np.floor(wanted), 1)
    more = max(int(cells - fines.sum()), 0)
    fines[np.argsort(np.floor(wanted) - wanted, kind="stable")[:more]] += 1
    return np.where(sizes > 0, fines, 1)


def _sampled(fraction) -> Column:
    number = F.pmod(F.xxhash64(F.lit("sample"), "rep"), F.lit(1 << 30))
    return number < fraction * float(1 << 30)


@dataclass
class Cells:
    """Vectors in their cells.

    `rows`: rep, embedding, coarse, fine, angle; `fine`: coarse, fine, centroid, rows, radius.
    """

    rows: DataFrame
    fine: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    dim: int


def coarse_cells(centroids: np.ndarray):
    """A function over batches with an `embedding`: adds the nearest coarse cell and its angle."""

    def nearest(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cosines = knn.unit_rows(knn.matrix(batch.column("embedding"))) @ centroids.T
            cell = cosines.argmax(axis=1).astype(np.int32)
            angle = np.arccos(np.clip(cosines[np.arange(len(cell)), cell], -1, 1))
            yield batch.append_column("coarse", pa.array(cell)).append_column(
                "coarse_angle", pa.array(angle)
            )

    return nearest


def _fine_angles(left: pa.Table, right: pa.Table):
    """Angles of the left rows' vectors with the right rows' centroids, in order of `fine`."""
    right = right.sort_by("fine")
    centroids = knn.matrix(right["centroid"].combine_chunks())
    rows = knn.unit_rows(knn.matrix(left["embedding"].combine_chunks()))
    return np.arccos(np.clip(rows @ centroids.T, -1, 1)), right


def build(vectors: DataFrame, count: int, cells: int, seed: int = 7) -> Cells:
    """Cells of `count` nonzero vectors (rep, embedding), about `cells` of them."""
    dim = vectors.select(F.size("embedding")).first()[0]
    wanted = max(round(cells**0.5), 1)
    some = vectors.where(_sampled(F.lit(min(2 * SAMPLE * wanted / count, 1.0))))
    some = some.limit(SAMPLE * wanted).select("embedding").toArrow()
    if not some.num_rows:
        some = vectors.limit(1).select("embedding").toArrow()
    sample = knn.unit_rows(knn.matrix(some["embedding"].combine_chunks()))
    centroids = kmeans(sample, wanted, seed)

    shape = "rep string, embedding array<float>, coarse int, coarse_angle double"
    rows = vectors.select("rep", "embedding").mapInArrow(coarse_cells(centroids), shape)
    rows = cut(rows, "coarse")
    sizes, radius = np.zeros(len(centroids)), np.full(len(centroids), -1.0)
    summary = rows.groupBy("coarse").agg(
        F.count("*").alias("rows"), F.max("coarse_angle").alias("radius")
    )
    for row in summary.collect():
        sizes[row.coarse], radius[row.coarse] = row.rows, row.radius

    fines = _allotted(cells, sizes)
    chosen = rows.where(_sampled(by_cell(np.minimum(SAMPLE * fines / np.maximum(sizes, 1), 1))))
    # The coarse centroid joins the sample, so that no cell is left without a row.
    own = vectors.sparkSession.createDataFrame(
        [(c, centroids[c].tolist()) for c in np.flatnonzero(sizes).tolist()],
        "coarse int, embedding array<float>",
    )

    def train(table: pa.Table) -> pa.Table:
        coarse = table["coarse"][0].as_py()
        units = knn.unit_rows(knn.matrix(table["embedding"].combine_chunks()))
        found = kmeans(units, int(fines[coarse]), seed)
        return pa.table(
            {
                "coarse": pa.array(np.full(len(found), coarse, np.int32)),
                "fine": pa.array(np.arange(len(found), dtype=np.int32)),
                "centroid": pa.array(found.tolist(), pa.list_(pa.float64())),
            }
        )

    samples = chosen.select("coarse", "embedding").unionByName(own)
    fine = cut(
        samples.groupBy("coarse").applyInArrow(train, "coarse int, fine int, centroid array<double>"),
        "fine",
    )

    parts = np.maximum(np.ceil(sizes / rows_per_task(dim)), 1)
    placed = rows.withColumn("part", share("rep", by_cell(parts).cast("int")))
    copies = fine.withColumn(
        "part", F.explode(F.sequence(F.lit(0), by_cell(parts).cast("int") - 1))
    )

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        angles, right = _fine_angles(left, right)
        cell = angles.argmin(axis=1)
        return pa.table(
            {
                "rep": left["rep"], "embedding": left["embedding"], "coarse": left["coarse"],
                "fine": right["fine"].take(pa.array(cell)),
                "angle": pa.array(angles[np.arange(len(cell)), cell]),
            }
        )

    def placed_only(left, right):
        pieces = [
            place(left.slice(start, PLACED_ROWS), right)
            for start in range(0, left.num_rows, PLACED_ROWS)
        ]
        return pa.concat_tables(pieces) if pieces else _no_rows(left.schema)

    schema = "rep string, embedding array<float>, coarse int, fine int, angle double"
    copies = copies.withColumnsRenamed({"coarse": "their_coarse", "part": "their_part"})
    both = placed.groupBy("coarse", "part").cogroup(copies.groupBy("their_coarse", "their_part"))
    rows = cut(both.applyInArrow(placed_only, schema), "cells")
    summary = rows.groupBy("coarse", "fine").agg(
        F.count("*").alias("rows"), F.max("angle").alias("radius")
    )
    # A cell that got no vector has no radius.
    fine = cut(fine.join(summary, ["coarse", "fine"], "left").fillna(0, "rows"), "fine")
    return Cells(rows, fine, centroids, radius, dim)


def _no_rows(schema: pa.Schema) -> pa.Table:
    fields = [schema.field("rep"), schema.field("embedding"), ("coarse", pa.int32())]
    return pa.schema([*fields, ("fine", pa.int32()), ("angle", pa.float64())]).empty_table()
