"""The stored search index of an archive: a base, and the postings of the papers changed since.

A change writes the changed papers' postings and then their ids under its own number; nothing that
is stored is rewritten. Readers take each changed paper's postings from its newest change and leave
out its older ones, the base's among them. The changed ids are all that readers need for that: a
share of the papers that `compact` brings back to none. A change whose ids are not written (its
driver was lost) is not seen, and its number is used again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.operators import search
from paperlake.schemas import POSTINGS
from paperlake.session import child_names, path_exists


class Index:
    """Postings under `path`, partitioned by the hash bucket of the term."""

    def __init__(self, spark: SparkSession, path: str, analyzer: str, buckets: int):
        self.spark, self.path = spark, path.rstrip("/")
        self.analyzer, self.buckets = analyzer, buckets

    def build(self, papers: DataFrame) -> "Index":
        """Write the base from all papers."""
        postings = search.build_postings(papers, self.analyzer)
        search.write_postings(postings, f"{self.path}/base", self.buckets)
        return self

    def _changes(self) -> list[int]:
        """Numbers of the changes whose ids are there."""
        folder = f"{self.path}/changed"
        names = [n for n in child_names(self.spark, folder) if n.startswith("change=")]
        done = [n for n in names if path_exists(self.spark, f"{folder}/{n}/_SUCCESS")]
        return sorted(int(n.removeprefix("change=")) for n in done)

    def update(self, papers: DataFrame) -> None:
        """Replace the postings of `papers`, which are whole rows of new or changed papers."""
        number = max(self._changes(), default=0) + 1
        postings = search.build_postings(papers, self.analyzer)
        search.place_postings(postings, f"{self.path}/changes/change={number}", self.buckets)
        ids = papers.select("arxiv_id").distinct()
        ids.write.mode("overwrite").parquet(f"{self.path}/changed/change={number}")

    def _newest(self) -> DataFrame:
        """The newest change (arxiv_id, change) of each changed paper."""
        changed = self.spark.read.schema("arxiv_id string, change int")
        changed = changed.parquet(f"{self.path}/changed").where(F.col("change").isin(self._changes()))
        return changed.groupBy("arxiv_id").agg(F.max("change").alias("change"))

    def _added(self) -> DataFrame:
        """The postings of the changes (term, arxiv_id, positions, change, term_bucket)."""
        number = [T.StructField(n, T.IntegerType()) for n in ("change", "term_bucket")]
        rows = self.spark.read.schema(T.StructType([*POSTINGS.fields, *number]))
        return rows.parquet(f"{self.path}/changes").where(F.col("change").isin(self._changes()))

    def postings(self) -> DataFrame:
        """The postings of all papers as they are now."""
        base = search.read_postings(self.spark, f"{self.path}/base")
        if not self._changes():
            return base
        newest = self._newest()
        rows = self._added().join(newest, ["arxiv_id", "change"], "left_semi").drop("change")
        kept = base.join(newest.select("arxiv_id"), "arxiv_id", "left_anti")
        return kept.unionByName(rows)

    def terms(self) -> DataFrame:
        """Document frequencies: the base's and the changes', so at least those of the postings."""
        base = search.read_terms(self.spark, f"{self.path}/base")
        if not self._changes():
            return base
        added = self._added().groupBy("term_bucket", "term").agg(F.count("*").alias("df"))
        both = base.unionByName(added)
        return both.groupBy("term_bucket", "term").agg(F.sum("df").alias("df"))

    def compact(self, path: str) -> "Index":
        """Write the postings as the base of a new index under another path."""
        found = Index(self.spark, path, self.analyzer, self.buckets)
        search.write_postings(self.postings().drop("term_bucket"), f"{found.path}/base", self.buckets)
        return found

    def search(self, query: str, limit=None) -> DataFrame:
        """Top (arxiv_id, rank) for one query."""
        return search.search_index(
            self.postings(), query, limit, analyzer=self.analyzer, buckets=self.buckets
        )

    def search_batch(self, queries: DataFrame, limit=None) -> DataFrame:
        """Top papers of every row of `queries`, as `operators.search.search_batch`."""
        base, newest = search.read_postings(self.spark, f"{self.path}/base"), None
        if self._changes():
            newest = self._newest()
            base = base.withColumn("change", F.lit(0)).unionByName(self._added())
        return search.search_batch(
            base, queries, limit, self.analyzer, self.buckets, self.terms(), newest
        )
