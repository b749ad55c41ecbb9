"""Embedding and enrichment as batched maps over rows."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake import params
from paperlake.functions.analysis import tokens
from paperlake.functions.ids import request_id
from paperlake.functions.text import embedding_text
from paperlake.schemas import EMBEDDINGS, S2_PAPER

Embedder = Callable[[list[str]], list]


def checked(vectors, n_texts: int, dim: int) -> list[list[float]]:
    """The answer of an embedder, after checking count, presence and length."""
    if len(vectors) != n_texts:
        raise ValueError(f"expected {n_texts} embeddings, got {len(vectors)}")
    rows = []
    for vector in vectors:
        if vector is None or len(vector) != dim:
            raise ValueError(f"expected {dim} dimensions")
        rows.append(np.asarray(vector, dtype=np.float32))
    return rows


def _message(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def embed(
    rows: DataFrame, embedder: Embedder, dim: int = params.EMBED_DIM,
    batch_size: int = params.EMBED_BATCH,
) -> DataFrame:
    """Call `embedder` on (arxiv_id, text) rows, `batch_size` texts at a time.

    Gives (arxiv_id, embedding, failed, problem). A failing call marks its own rows only, leaves
    their vector NULL and its message as their problem.
    """
    marks = [T.StructField("failed", T.BooleanType()), T.StructField("problem", T.StringType())]
    schema = T.StructType([*EMBEDDINGS.fields, *marks])

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                texts = part.column("text").to_pylist()
                problem = None
                try:
                    vectors = checked(embedder(texts), len(texts), dim)
                except Exception as error:
                    vectors, problem = [None] * len(texts), _message(error)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("arxiv_id"),
                        pa.array(vectors, pa.list_(pa.float32())),
                        pa.array([v is None for v in vectors]),
                        pa.array([problem] * len(vectors), pa.string()),
                    ],
                    names=schema.fieldNames(),
                )

    return rows.select("arxiv_id", "text").mapInArrow(call, schema)


def embed_hashed(rows: DataFrame, dim: int = params.EMBED_DIM) -> DataFrame:
    """Embedding without a model: hashed token counts scaled to length one.

    Runs in the JVM. A text without tokens gets a zero vector.
    """
    counted = HashingTF(numFeatures=dim, inputCol="tokens", outputCol="counts").transform(
        rows.select("arxiv_id", tokens("text").alias("tokens"))
    )
    scaled = Normalizer(p=2.0, inputCol="counts", outputCol="scaled").transform(counted)
    return scaled.select(
        "arxiv_id",
        vector_to_array("scaled", "float32").alias("embedding"),
        F.lit(False).alias("failed"),
        F.lit(None).cast("string").alias("problem"),
    )


def embed_papers(papers: DataFrame, embedder=None, dim: int = params.EMBED_DIM) -> DataFrame:
    """Embed title and abstract with `embedder`, or with the hashed default."""
    rows = papers.select("arxiv_id", embedding_text().alias("text"))
    return embed(rows, embedder, dim) if embedder else embed_hashed(rows, dim)


def embed_query(spark, text: str, embedder=None, dim: int = params.EMBED_DIM):
    """Vector of one query text."""
    if not text:
        raise ValueError("missing query text")
    if embedder:
        return checked(embedder([text]), 1, dim)[0]
    row = spark.range(1).select(F.lit("query").alias("arxiv_id"), F.lit(text).alias("text"))
    return np.asarray(embed_hashed(row, dim).first().embedding)


def enrich(
    ids: DataFrame, fetch: Callable[[list[str]], list], batch_size: int = params.EMBED_BATCH
) -> DataFrame:
    """Call `fetch` with prefixed ids, `batch_size` at a time, and parse the documents it gives.

    `fetch` returns one JSON text (or None) per document found. Gives the parsed documents with
    the number of ids of failed calls in `failed`, and the call's message in `problem`, on rows
    without a document.
    """
    schema = "document string, failed int, problem string"

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                wanted = batch.column("id").slice(start, batch_size).to_pylist()
                problem = None
                try:
                    found, failed = list(fetch(wanted)), 0
                except Exception as error:
                    found, failed, problem = [None], len(wanted), _message(error)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found, pa.string()),
                        pa.array([failed] * len(found), pa.int32()),
                        pa.array([problem] * len(found), pa.string()),
                    ],
                    names=["document", "failed", "problem"],
                )

    answers = ids.select(request_id(F.col("arxiv_id")).alias("id")).mapInArrow(call, schema)
    parsed = F.from_json("document", S2_PAPER).alias("paper")
    return answers.select(parsed, "failed", "problem").select("paper.*", "failed", "problem")
