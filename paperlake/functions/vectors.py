"""Cosine similarity as a column expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a, b) -> Column:
    """One minus the cosine distance; NULL when a side is NULL or a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def vector_problem(vector, dim) -> Column:
    """What is wrong with a vector that should have `dim` numbers; NULL if nothing is."""
    wrong = F.format_string(f"expected {dim} dimensions, got %d", F.size(vector))
    return F.when(vector.isNull(), "no vector").when(F.size(vector) != dim, wrong)


def checked_vector(vector, dim) -> Column:
    """`vector` itself, failing the job when its length is not `dim`; NULL stays NULL."""
    fits = vector.isNull() | vector_problem(vector, dim).isNull()
    return F.when(fits, vector).otherwise(F.raise_error(vector_problem(vector, dim)))
