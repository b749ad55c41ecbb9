"""Approximate index: vectors grouped by nearest centroid and stored one partition per cell."""

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake import params
from paperlake.operators import cells, knn
from paperlake.operators.cells import ANGLE_SLACK
from paperlake.schemas import EMBEDDINGS
from paperlake.session import child_names, cut, path_exists


def n_lists(n_vectors: int) -> int:
    """Number of cells: the square root of the vectors, so that cells and their vectors grow
    alike; a probe of a cell and the comparison with all centroids cost the same."""
    return max(round(math.sqrt(n_vectors)), 2)


def nonzero(embeddings: DataFrame) -> DataFrame:
    """Vectors with a direction; zero vectors cannot be indexed by cosine."""
    return embeddings.where(F.exists("embedding", lambda x: x != 0))


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add the nearest `cell` and the `angle` to its centroid."""
    schema = T.StructType(
        [
            *vectors.schema.fields,
            T.StructField("cell", T.IntegerType()),
            T.StructField("angle", T.DoubleType()),
        ]
    )

    def nearest(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cosines = knn.unit_rows(knn.matrix(batch.column("embedding"))) @ centroids.T
            cell = cosines.argmax(axis=1).astype(np.int32)
            best = cosines[np.arange(len(cell)), cell]
            angle = np.arccos(np.clip(best, -1, 1))
            yield batch.append_column("cell", cell).append_column("angle", angle)

    return vectors.mapInArrow(nearest, schema)


@dataclass
class Index:
    """A stored index: centroids with the radius of their cells, and the finished batches."""

    spark: object
    path: str
    centroids: np.ndarray
    radius: np.ndarray
    batches: list

    def cells(self) -> DataFrame:
        stored = [
            T.StructField("batch", T.StringType()),
            T.StructField("cell", T.IntegerType()),
        ]
        schema = T.StructType([*EMBEDDINGS.fields, *stored])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/cells")
        return rows.where(F.col("batch").isin(self.batches))


def build(embeddings: DataFrame, path: str, lists=None, seed: int = 7):
    """Write the index under `path` and open it; None if there is no vector to index.

    Its cells are two-level ones: trained on samples, and a vector is compared with the centroids
    of one coarse cell only. An index that is there already is opened as it is.
    """
    spark = embeddings.sparkSession
    if _batches(spark, path):
        return open_index(spark, path)
    vectors = nonzero(embeddings.select("arxiv_id", "embedding"))
    n_vectors = vectors.count()
    if not n_vectors:
        return None
    named = vectors.withColumnRenamed("arxiv_id", "rep")
    found = cells.build(named, n_vectors, lists or n_lists(n_vectors), seed)
    order = Window.orderBy("coarse", "fine")
    table = found.fine.withColumn("cell", F.row_number().over(order) - 1)
    table = cut(table.select("cell", "coarse", "fine", "centroid").coalesce(1), "centroids")
    table.select("cell", "centroid").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    rows = found.rows.join(table.select("cell", "coarse", "fine"), ["coarse", "fine"])
    rows = rows.withColumnRenamed("rep", "arxiv_id")
    _write_cells(rows.select("arxiv_id", "embedding", "cell", "angle"), path, "base")
    return open_index(spark, path)


def add(index: Index, embeddings: DataFrame, batch: str) -> Index:
    """Add new papers' vectors to their cells. A repeated batch overwrites itself."""
    vectors = nonzero(embeddings.select("arxiv_id", "embedding"))
    _write_cells(cut(assign(vectors, index.centroids), "assigned"), index.path, batch)
    return open_index(index.spark, index.path)


def _write_cells(assigned: DataFrame, path: str, batch: str) -> None:
    # Small cells share a task, crowded ones are split by the rebalance.
    placed = assigned.select("arxiv_id", "embedding", "cell").hint("rebalance", "cell")
    placed.write.partitionBy("cell").mode("overwrite").parquet(f"{path}/cells/batch={batch}")
    # One row per cell, written last: the radii make the batch visible.
    summary = assigned.groupBy("cell").agg(F.max("angle").alias("radius"))
    summary.coalesce(1).write.mode("overwrite").parquet(f"{path}/radius/{batch}")


def _batches(spark, path: str) -> list[str]:
    names = child_names(spark, f"{path}/radius")
    return [n for n in names if path_exists(spark, f"{path}/radius/{n}/_SUCCESS")]


def open_index(spark, path: str) -> Index:
    batches = _batches(spark, path)
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    radii = spark.read.parquet(*[f"{path}/radius/{name}" for name in batches])
    radius = np.full(len(rows), -1.0)
    for row in radii.groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radius[row.cell] = row.radius
    return Index(spark, path, np.array([row.centroid for row in rows]), radius, batches)


def search(
    index: Index, vector, limit=None, nprobe: int = 10, exclude=None, exact: bool = False
) -> DataFrame:
    """Papers closest to `vector` among the `nprobe` cells with the nearest centroids.

    Only those partitions are read. With `exact`, a second scan reads every further cell that can
    still hold a closer vector, by the triangle inequality on angles, so nothing is missed.
    """
    k = params.positive(limit, params.SIMILAR_LIMIT)
    query = np.asarray(vector, dtype=np.float64)[None, :]
    unit = knn.unit_rows(query)[0]
    if np.isnan(unit).any():
        return knn.no_hits(index.spark)
    angles = np.arccos(np.clip(index.centroids @ unit, -1, 1))
    order = np.argsort(angles, kind="stable")
    filled = [int(c) for c in order if index.radius[c] >= 0]
    probed, rest = filled[:nprobe], filled[nprobe:]

    def scan(cells):
        wanted = index.cells().where(F.col("cell").isin(cells))
        return knn.scan(wanted, query, k, [exclude]).drop("query")

    first = scan(probed)
    if not exact or not rest:
        return first
    found = first.collect()
    reach = np.pi
    if len(found) == k:
        reach = float(np.arccos(np.clip(found[-1].similarity, -1, 1)))
    more = [c for c in rest if angles[c] - index.radius[c] <= reach + ANGLE_SLACK]
    if not more:
        return index.spark.createDataFrame(found, first.schema)
    both = index.spark.createDataFrame(found, first.schema).unionByName(scan(more))
    return both.orderBy(*knn.best_first()).limit(k)


def search_by_id(
    index: Index, embeddings: DataFrame, arxiv_id: str, limit=None, nprobe=10, exact=False
) -> DataFrame:
    vector = knn.vector_of(embeddings, arxiv_id)
    if vector is None:
        return knn.no_hits(index.spark)
    return search(index, vector, limit, nprobe, arxiv_id, exact)
