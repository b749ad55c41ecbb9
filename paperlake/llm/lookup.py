"""Rows of large texts without those of some ids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.session import counted_cut

MOST_IDS = 1_000_000
"""Ids that are sent to all tasks (8 MB); with more of them the texts are shuffled to meet them."""


def without(documents: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose key is not among the ids. A null key stays; the columns stay in order."""
    written, count = counted_cut(ids.select(key).distinct(), "dropped")
    if count <= MOST_IDS:
        written = F.broadcast(written)
    return documents.join(written, key, "left_anti").select(*documents.columns)
