"""Time the headline operators and print one JSON line.

The archive's tables are derived from $BENCH_SF_DIR and written once; each operator is then run
over the written tables. The reported time of an operator is the median of its runs.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from paperlake import testviews as tv  # noqa: E402
from paperlake.operators import (  # noqa: E402
    catalog,
    graph,
    harvest,
    ivf,
    knn,
    merge,
    neighbours,
    search,
    stats,
)
from paperlake.plans import similar  # noqa: E402
from paperlake.session import cut, scratch_path, ship_package  # noqa: E402
from paperlake.sources.store import Archive  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
PAPER = "2306.00005"
TERM_BUCKETS = 16


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("paperlake-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # Tables are small here: let writes use all cores.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sink(rows) -> None:
    rows.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    ship_package(spark)
    papers = cut(tv.papers(spark, SF_DIR).repartition(int(CPUS)), "papers")
    vectors = cut(tv.embeddings(spark, SF_DIR).repartition(int(CPUS)), "vectors")
    refs = cut(tv.refs(spark, SF_DIR), "refs")
    state = cut(tv.sync_state(spark, SF_DIR), "state")
    records = cut(tv.harvest_records(spark, SF_DIR).repartition(int(CPUS)), "records")
    turns = cut(tv.upserts(spark, SF_DIR), "turns")
    questions = tv.table(spark, SF_DIR, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    postings_path = scratch_path(spark, "postings")
    stored = {}

    def build_postings():
        search.write_postings(search.build_postings(papers, "simple"), postings_path, TERM_BUCKETS)

    def postings():
        return search.read_postings(spark, postings_path)

    def build_index():
        stored["index"] = ivf.build(vectors, scratch_path(spark, "index"))

    def build_similar():
        archive.save_similar(neighbours.build(vectors))

    archive = Archive(spark, scratch_path(spark, "archive"), buckets=8).create()
    archive.papers.write(papers, whole=True)
    halves = F.pmod(F.xxhash64("from_id", "to_id"), F.lit(2)) == 0

    def upsert_stored():
        archive.upsert_papers(turns, tv.AS_OF)

    # Half of the edges are stored beforehand: each run adds the others to an archive of its own.
    filled = []
    for _ in range(RUNS + 1):
        target = Archive(spark, scratch_path(spark, "archive"), buckets=8).create()
        target.insert_refs(refs.where(halves))
        filled.append(target)

    def insert_refs():
        filled.pop().insert_refs(refs)

    def index_search():
        return ivf.search_by_id(stored["index"], vectors, PAPER)

    def similar_scan():
        return knn.similar_by_id(vectors, PAPER)

    folded = merge.fold_batch(turns)
    queries = {
        "harvest_papers": lambda: harvest.records_to_papers(records),
        "upsert_papers": lambda: merge.merge_papers(papers, folded, tv.AS_OF),
        "upsert_stored": upsert_stored,
        "insert_refs": insert_refs,
        "archive_stats": lambda: stats.archive_stats(papers, vectors, refs, state, tv.AS_OF),
        "recent": lambda: catalog.recent(papers, tv.AS_OF, days=365),
        "pending_embedding": lambda: catalog.pending_embedding(papers, vectors, 500),
        "degrees": lambda: graph.degrees(refs),
        "cited_by": lambda: graph.cited_by(refs, papers, PAPER),
        "missing_refs": lambda: graph.missing_references(papers, refs),
        "search_simple": lambda: search.search(papers, "thin than", analyzer="simple"),
        "search_english": lambda: search.search(papers, "thins eren", None, "english"),
        "build_postings": build_postings,
        "search_index": lambda: search.search_index(
            postings(), "thin than", analyzer="simple", buckets=TERM_BUCKETS
        ),
        "search_batch": lambda: search.search_batch(
            postings(), questions, analyzer="simple", buckets=TERM_BUCKETS,
            terms=search.read_terms(spark, postings_path),
        ),
        "similar_by_id": similar_scan,
        "build_ivf": build_index,
        "similar_ivf": index_search,
        "build_similar": build_similar,
        "similar_precomputed": lambda: similar.by_id(
            papers, vectors, PAPER, similar=archive.similar.lookup(PAPER)
        ),
    }
    seconds = {}
    for name, query in queries.items():
        times = []
        # The first run warms up code generation and Python workers.
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            rows = query()
            if rows is not None:
                sink(rows)
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
    line = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(SF_DIR).name.removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
