"""The archive's tables: Parquet folders partitioned by the hash bucket of a key.

All writes are Spark's own. New edges are appended. Other changes replace the touched buckets by
dynamic partition overwrite: the merged rows are written next to the table first, as its planned
rows, and then put in place, so a task or executor lost meanwhile costs a retry, and a driver lost
while Spark moves the finished files costs nothing either: the next writer, or `create`, finds the
planned rows and puts them in place again. Changes are functions of the stored rows and the batch, and
repeating the last batch changes nothing. One writer at a time is expected.
"""

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.functions.vectors import checked_vector
from paperlake.operators import merge
from paperlake.operators.search import TERM_BUCKETS
from paperlake.schemas import EMBEDDINGS, PAPERS, PUBLISHED_DAY, REFS, SIMILAR, SYNC_STATE
from paperlake.session import counted_cut, cut, path_exists, remove
from paperlake.sources.index import Index


FEW_EDGES = 200_000
"""Edges of a batch that are sent to all tasks, so that only their equals are taken from a table."""
SHARES = 8
"""Shares of a bucket, at least, that new edges are dealt in."""


def bucket_of(key, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Table:
    """One stored table, partitioned by `bucket`, the hash of its `key` column.

    Within a bucket rows are sorted by `cluster`, so that filters on it skip most row groups.
    `derived` columns (name to SQL expression) are computed on write and returned by `read`.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema, key: str, buckets: int, cluster=None,
        derived=None,
    ):
        self.spark, self.path = spark, path
        self.key, self.buckets = key, buckets
        self.cluster, self.derived = cluster or key, derived or {}
        self.schema = T.StructType([*schema.fields, *(field for field, _ in self.derived.values())])
        self._stored = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.path}/_SUCCESS")

    def create(self) -> None:
        """Create the table if it is absent; finish a change that was left unfinished."""
        self._recover()
        if not self.exists():
            self._put(self.spark.createDataFrame([], self._stored), "append")

    def read(self, buckets=None) -> DataFrame:
        """The table, or only some of its buckets."""
        rows = self.spark.read.schema(self._stored).parquet(self.path)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.select(*self.schema.fieldNames())

    def lookup(self, value: str) -> DataFrame:
        """Rows of one key, read from its bucket only."""
        rows = self.spark.read.schema(self._stored).parquet(self.path)
        rows = rows.where(F.col("bucket") == bucket_of(F.lit(value), self.buckets))
        return rows.where(F.col(self.key) == value).select(*self.schema.fieldNames())

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets with a key in `rows`: at most `buckets` numbers."""
        found = rows.select(bucket_of(self.key, self.buckets).alias("bucket")).distinct()
        return [row.bucket for row in found.collect()]

    def write(self, rows: DataFrame, whole: bool = False) -> None:
        """Replace the buckets that `rows` has rows of, or the whole table, by `rows`."""
        self._recover()
        kind = "whole" if whole else "buckets"
        self._placed(rows).write.mode("overwrite").parquet(f"{self._planned}/{kind}")
        self._replace(kind)
        self._finish()

    def append(self, rows: DataFrame, dealt: bool = False) -> int:
        """Add rows; gives their number, counted while they are written. Rows that are `dealt` by
        `place` already are written where they are."""
        self._recover()
        seen = Observation()
        placed = self._placed(rows).observe(seen, F.count(F.lit(1)).alias("rows"))
        self._put(placed, "append", dealt=dealt)
        return seen.get["rows"]

    def place(self, *columns: str) -> Column:
        """A number that names a row's bucket and its share of it, by a hash of `columns`: some
        four places for each partition of a shuffle, so that a crowded bucket fills several."""
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shares = max(SHARES, -(-4 * partitions // self.buckets))
        share = F.pmod(F.xxhash64(F.lit("share"), *columns), F.lit(shares))
        return bucket_of(self.key, self.buckets).cast("long") * shares + share

    def compact(self) -> None:
        """Write the table anew, without the small files that appends leave."""
        self.write(self.read(), whole=True)

    def _placed(self, rows: DataFrame) -> DataFrame:
        derived = {name: F.expr(expression) for name, (_, expression) in self.derived.items()}
        placed = rows.withColumns(derived) if derived else rows
        placed = placed.withColumn("bucket", bucket_of(self.key, self.buckets))
        return placed.select(*self._stored.fieldNames())

    def _put(self, rows: DataFrame, mode: str, overwrite: str = "static", dealt=False) -> None:
        # The rebalance splits a crowded bucket over several tasks and merges small ones.
        rows = rows if dealt else rows.hint("rebalance", "bucket")
        rows = rows.sortWithinPartitions("bucket", self.cluster)
        writer = rows.write.partitionBy("bucket").mode(mode)
        writer.option("partitionOverwriteMode", overwrite).parquet(self.path)

    @property
    def _planned(self) -> str:
        return f"{self.path}_planned"

    def _replace(self, kind: str) -> None:
        rows = self.spark.read.schema(self._stored).parquet(f"{self._planned}/{kind}")
        self._put(rows, "overwrite", "static" if kind == "whole" else "dynamic")

    def _finish(self) -> None:
        remove(self.spark, self._planned)

    def _recover(self) -> None:
        """Put planned rows in place: once more, if they were already."""
        if not path_exists(self.spark, self._planned):
            return
        for kind in ("whole", "buckets"):
            if path_exists(self.spark, f"{self._planned}/{kind}/_SUCCESS"):
                self._replace(kind)
        self._finish()


def _numbered(name: str) -> tuple[str, int]:
    stream, _, number = name.rpartition("-")
    return (stream, int(number)) if stream and number.isdigit() else (name, 0)


class Archive:
    """All tables of one archive under a root folder."""

    def __init__(
        self, spark: SparkSession, root: str, buckets: int = 256, dim=None,
        term_buckets: int = TERM_BUCKETS,
    ):
        self.spark, self.root, self.dim = spark, root.rstrip("/"), dim
        self.term_buckets = term_buckets
        self.papers = self._table(
            "papers", PAPERS, "arxiv_id", buckets, PUBLISHED_DAY.name,
            {PUBLISHED_DAY.name: (PUBLISHED_DAY, "CAST(published AS DATE)")},
        )
        self.embeddings = self._table("embeddings", EMBEDDINGS, "arxiv_id", buckets)
        # Edges are kept twice, so that both directions prune to one bucket.
        self.refs = self._table("refs_by_source", REFS, "from_id", buckets)
        self.refs_by_target = self._table("refs_by_target", REFS, "to_id", buckets)
        self.state = self._table("sync_state", SYNC_STATE, "key", 1)
        self.similar = self._table("similar", SIMILAR, "arxiv_id", buckets)

    def _table(self, name, *layout) -> Table:
        return Table(self.spark, f"{self.root}/{name}", *layout)

    @property
    def fulltext_path(self) -> str:
        return f"{self.root}/fulltext"

    def create(self) -> "Archive":
        """Create the absent tables; the neighbour table appears when it is first built."""
        for table in (self.papers, self.embeddings, self.refs, self.refs_by_target, self.state):
            table.create()
        return self

    def _applied(self, name: str) -> bool:
        """Whether the batch is not newer than the last one of its stream.

        A name is a stream's name, and the batch's number after the last hyphen, if it has one.
        """
        stream, number = _numbered(name)
        last = self.get_state(f"batch_{stream}") if name else ""
        return bool(last) and number <= int(last)

    def _note_applied(self, name: str) -> None:
        if name:
            stream, number = _numbered(name)
            self.set_state(**{f"batch_{stream}": str(number)})

    def upsert_papers(self, batch: DataFrame, fetched_at, name: str = "", strict=False) -> int:
        """Fold a batch (with `seq`) and merge it. Gives the number of rows submitted."""
        if self._applied(name):
            return 0
        batch, submitted = counted_cut(batch)
        if not submitted:
            return 0
        folded = merge.fold_batch(batch, strict=strict)
        buckets = self.papers.touched(batch)
        merged = merge.merge_papers(self.papers.read(buckets), folded, fetched_at, strict)
        self.papers.write(merged)
        index = self.index()
        if index is not None:
            ids = folded.select("arxiv_id")
            index.update(self.papers.read(buckets).join(ids, "arxiv_id", "left_semi"))
        self._note_applied(name)
        return submitted

    def build_index(self, analyzer: str = "english") -> Index:
        """Build the search index of all papers; from now on upserts keep it up to date."""
        folder = f"index-{analyzer}-{uuid.uuid4().hex}"
        index = self._index(folder).build(self.papers.read())
        self.set_state(index=folder)
        return index

    def index(self) -> Index | None:
        """The search index, or None while it was never built."""
        folder = self.get_state("index")
        return self._index(folder) if folder else None

    def compact_index(self) -> None:
        """Bring the changes since the last build or compaction into the index's base."""
        old = self.index()
        folder = f"index-{old.analyzer}-{uuid.uuid4().hex}"
        old.compact(f"{self.root}/{folder}")
        self.set_state(index=folder)

    def _index(self, folder: str) -> Index:
        return Index(self.spark, f"{self.root}/{folder}", folder.split("-")[1], self.term_buckets)

    def mark_full_text(self, texts: DataFrame) -> None:
        """Mark papers (arxiv_id, full_text_path) as having full text."""
        texts = cut(texts.select("arxiv_id", "full_text_path"))
        buckets = self.papers.touched(texts)
        current = self.papers.read(buckets)
        # Rewrite only buckets that hold one of these papers.
        buckets = self.papers.touched(current.join(texts, "arxiv_id", "left_semi"))
        if buckets:
            self.papers.write(merge.mark_full_text(self.papers.read(buckets), texts))

    def insert_refs(self, edges: DataFrame) -> int:
        """Add edges, ignoring known ones. Gives the number of new edges.

        Only new rows are written. Each copy is compared with its own content, so a repeated call
        completes either one, and what an interrupted call has added is not added again.
        """
        edges, count = counted_cut(edges.select(*REFS.fieldNames()))
        tables = self.refs, self.refs_by_target
        return [self._insert_refs(table, edges, count <= FEW_EDGES) for table in tables][0]

    def _insert_refs(self, table: Table, edges: DataFrame, few: bool = False) -> int:
        ends = REFS.fieldNames()
        stored = table.read(table.touched(edges))
        if few:
            stored = stored.join(F.broadcast(edges.distinct()), ends, "left_semi")
        return table.append(merge.new_edges(edges, stored, table.place(*ends)), dealt=True)

    def update_embeddings(self, batch: DataFrame) -> int:
        """Set vectors (arxiv_id, embedding, seq); unknown ids are ignored.

        With the archive's `dim` set, a vector of another length fails the batch.
        """
        if self.dim:
            vector = checked_vector(F.col("embedding"), self.dim)
            batch = batch.withColumn("embedding", vector)
        batch = cut(batch)
        known = self.papers.read(self.papers.touched(batch))
        changed = merge.fold_embeddings(batch, known).select(*EMBEDDINGS.fieldNames())
        changed, count = counted_cut(changed)
        if count:
            current = self.embeddings.read(self.embeddings.touched(changed))
            self.embeddings.write(merge.replace_rows(current, changed, "arxiv_id"))
        return count

    def set_state(self, **values: str) -> None:
        """Set bookkeeping keys; the last value wins."""
        rows = self.spark.createDataFrame(list(values.items()), SYNC_STATE)
        merged = merge.replace_rows(self.state.read(), rows, "key")
        self.state.write(merged)

    def get_state(self, key: str) -> str:
        """Value of a key, empty when it was never set."""
        row = self.state.read().where(F.col("key") == key).first()
        return row.value or "" if row else ""

    def read_similar(self):
        """The neighbour table, or None while it was never built."""
        return self.similar.read() if self.similar.exists() else None

    def save_similar(self, rows: DataFrame) -> None:
        self.similar.create()
        self.similar.write(rows, whole=True)
