"""Rows of a batch that are, or are not, in a table.

The table is first reduced to the batch's keys. Where adaptive execution finds the batch small
enough to broadcast, that only scans the table, which as the right side of a plain semi or anti
join would have to be shuffled; otherwise the reduction and the join share one partitioning.
"""

from pyspark.sql import DataFrame


def _select(batch: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    found = table.select(*keys).join(batch.select(*keys), keys, "left_semi")
    return batch.join(found, keys, how)


def known(batch: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    return _select(batch, table, list(keys), "left_semi")


def unknown(batch: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    return _select(batch, table, list(keys), "left_anti")
