import datetime
import time
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperlake import schemas
from paperlake.operators import catalog, graph, membership, merge, stats
from paperlake.session import cut
from paperlake.sources.store import Archive

NOW = datetime.datetime(2024, 5, 1)
BATCH = (
    "arxiv_id string, title string, abstract string, authors string, categories string, "
    "published timestamp_ntz, updated timestamp_ntz, doi string, journal_ref string, "
    "has_full_text boolean, full_text_path string, seq int"
)


def row(arxiv_id, seq=0, title="t", **given_values):
    names = [part.split()[0] for part in BATCH.split(", ")]
    values = dict.fromkeys(names)
    values.update(arxiv_id=arxiv_id, seq=seq, title=title, has_full_text=False, **given_values)
    return tuple(values[name] for name in names)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), BATCH)


def paper(arxiv_id, **given_values):
    values = dict.fromkeys(schemas.PAPERS.fieldNames())
    values.update(arxiv_id=arxiv_id, title=f"title {arxiv_id}", has_full_text=False)
    values.update(given_values)
    return tuple(values[name] for name in schemas.PAPERS.fieldNames())


def papers(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.PAPERS)


def refs(spark, *edges):
    return spark.createDataFrame(list(edges), schemas.REFS)


def by_id(rows):
    return {r.arxiv_id: r for r in rows.collect()}


# --- merging -----------------------------------------------------------------------------------

VALUES = st.sampled_from([None, "", "a", "b"])
ROWS = st.lists(
    st.tuples(st.sampled_from(["p1", "p2", "p3"]), VALUES, VALUES, VALUES, st.booleans()),
    max_size=8,
)


def sequential_upsert(stored, rows, strict):
    """The same upserts one after the other."""
    table = {k: dict(v) for k, v in stored.items()}
    for arxiv_id, abstract, doi, path, mark in rows:
        new = {"abstract": abstract, "doi": doi, "full_text_path": path, "has_full_text": mark}
        if not strict:
            new["doi"], new["full_text_path"] = doi or None, path or None
        old = table.get(arxiv_id)
        if old:
            for name in ("doi", "full_text_path"):
                new[name] = old[name] if new[name] is None else new[name]
            new["has_full_text"] = mark or old["has_full_text"]
        table[arxiv_id] = new
    return table


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
@given(stored=ROWS, rows=ROWS, strict=st.booleans())
@settings(
    max_examples=6, deadline=None, derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
def test_upsert_equals_sequential(spark, broadcast, stored, rows, strict):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        start = sequential_upsert({}, stored, strict)
        current = papers(spark, *[paper(k, **v) for k, v in start.items()])
        incoming = batch(
            spark,
            *[
                row(i, n, abstract=a, doi=d, full_text_path=p)[:9] + (m, p, n)
                for n, (i, a, d, p, m) in enumerate(rows)
            ],
        )
        folded = merge.fold_batch(incoming, strict=strict)
        merged = by_id(merge.merge_papers(current, folded, NOW, strict))
        got = {
            k: {n: r[n] for n in ("abstract", "doi", "full_text_path", "has_full_text")}
            for k, r in merged.items()
        }
        assert got == sequential_upsert(start, rows, strict)
        touched = {r[0] for r in rows}
        assert all((r.fetched_at == NOW) == (k in touched) for k, r in merged.items())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_upsert_reads_the_table_once(spark, tmp_path):
    path = str(tmp_path / "papers")
    papers(spark, *[paper(f"p{n}") for n in range(50)]).write.parquet(path)
    stored = spark.read.schema(schemas.PAPERS).parquet(path)
    batch(spark, row("p1"), row("new")).write.parquet(str(tmp_path / "batch"))
    folded = merge.fold_batch(spark.read.schema(BATCH).parquet(str(tmp_path / "batch")))
    merged = merge.merge_papers(stored, folded, NOW)
    assert merged.count() == 51
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("FileScan") == 2


def test_mark_full_text(spark):
    current = papers(spark, paper("a"), paper("b", has_full_text=None), paper("c"))
    texts = spark.createDataFrame(
        [("a", "x/a.txt"), ("zz", "x/zz.txt")], "arxiv_id string, full_text_path string"
    )
    got = by_id(merge.mark_full_text(current, texts))
    assert (got["a"].has_full_text, got["a"].full_text_path) == (True, "x/a.txt")
    assert (got["b"].has_full_text, got["c"].has_full_text) == (None, False)
    assert len(got) == 3


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_membership(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "arxiv_id string, n int")
    table = spark.createDataFrame([("b",), ("c",), ("b",)], "arxiv_id string")
    assert sorted(r.n for r in membership.known(rows, table, "arxiv_id").collect()) == [2, 3]
    assert [r.n for r in membership.unknown(rows, table, "arxiv_id").collect()] == [1]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- stored tables -----------------------------------------------------------------------------


@pytest.fixture
def archive(spark, tmp_path):
    return Archive(spark, str(tmp_path / "archive"), buckets=4, dim=2).create()


def test_create_is_idempotent(archive):
    archive.papers.write(papers(archive.spark, paper("a")), whole=True)
    archive.create()
    assert archive.papers.read().count() == 1
    assert archive.refs.read().count() == 0


def test_upsert_batches(archive, spark):
    first = batch(spark, row("a", 0, "one", doi="10.1/a"), row("a", 1, "two"), row("b", 2))
    assert archive.upsert_papers(first, NOW, "first") == 3
    assert archive.upsert_papers(batch(spark), NOW) == 0
    later = NOW + datetime.timedelta(days=1)
    assert archive.upsert_papers(batch(spark, row("a", 0, "three", doi="")), later) == 1
    got = by_id(archive.papers.read())
    assert (got["a"].title, got["a"].doi, got["a"].fetched_at) == ("three", "10.1/a", later)
    assert got["b"].fetched_at == NOW
    # A repeated batch is recognised by its name.
    assert archive.upsert_papers(first, NOW, "first") == 0
    assert by_id(archive.papers.read())["a"].title == "three"
    assert archive.papers.lookup("a").count() == 1


def files(table):
    return {str(p) for p in Path(table.path).glob("bucket=*/*.parquet")}


def test_only_touched_buckets_are_rewritten(archive, spark):
    archive.upsert_papers(batch(spark, *[row(f"p{n}", n) for n in range(40)]), NOW)
    before = files(archive.papers)
    archive.upsert_papers(batch(spark, row("p3")), NOW)
    after = files(archive.papers)
    changed = {Path(f).parent.name for f in before ^ after}
    assert len(changed) == 1 and len({Path(f).parent.name for f in before}) == 4
    assert archive.papers.read().count() == 40


def test_failed_write_changes_nothing(archive, spark):
    archive.upsert_papers(batch(spark, row("a", 0, "one")), NOW)
    before = files(archive.papers)
    broken = archive.papers.read().withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        archive.papers.write(broken)
    assert files(archive.papers) == before
    assert by_id(archive.papers.read())["a"].title == "one"


def test_interrupted_change_is_finished(archive, spark, monkeypatch):
    archive.upsert_papers(batch(spark, row("a", 0, "one"), row("b", 1)), NOW)

    def die(*_):
        raise RuntimeError("lost")

    def dies_in(name, title):
        with monkeypatch.context() as patch:
            patch.setattr(archive.papers, name, die)
            with pytest.raises(RuntimeError, match="lost"):
                archive.upsert_papers(batch(spark, row("a", 0, title)), NOW, "dead")
        assert not archive._applied("dead")

    # Planned but not in place: whoever opens the archive next finishes it.
    dies_in("_replace", "two")
    assert by_id(archive.papers.read())["a"].title == "one"
    archive.create()
    assert by_id(archive.papers.read())["a"].title == "two"
    # The old files of the bucket are gone, its new ones not there yet.
    others = files(archive.papers)
    dies_in("_finish", "three")
    for file in files(archive.papers) - others:
        Path(file).unlink()
    archive.create()
    assert by_id(archive.papers.read())["a"].title == "three"
    assert archive.papers.read().count() == 2
    # Nothing is planned any more: an append is not undone.
    archive.papers.append(papers(spark, paper("new")))
    archive.create()
    assert archive.papers.read().count() == 3


def test_batches_of_a_stream_are_applied_in_order(archive, spark):
    assert archive.upsert_papers(batch(spark, row("a", 0, "one")), NOW, "s-1-4") == 1
    assert archive.upsert_papers(batch(spark, row("a", 0, "two")), NOW, "s-1-4") == 0
    assert archive.upsert_papers(batch(spark, row("a", 0, "two")), NOW, "s-1-10") == 1
    assert archive.upsert_papers(batch(spark, row("a", 0, "three")), NOW, "s-2-0") == 1
    assert by_id(archive.papers.read())["a"].title == "three"
    assert {r.key for r in archive.state.read().collect()} == {"batch_s-1", "batch_s-2"}


def test_insert_refs(archive, spark):
    edges = refs(spark, ("a", "b"), ("a", "b"), ("a", "c"), ("x", "x"))
    assert archive.insert_refs(edges) == 3
    assert archive.insert_refs(edges) == 0
    assert archive.insert_refs(refs(spark, ("a", "c"), ("d", "b"))) == 1
    assert archive.refs.read().count() == archive.refs_by_target.read().count() == 4
    assert archive.refs_by_target.lookup("b").count() == 2
    plan = archive.refs_by_target.lookup("b")._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_insert_writes_new_edges_only(archive, spark):
    archive.insert_refs(refs(spark, *[("a", f"t{n}") for n in range(20)]))
    before = {t: files(t) for t in (archive.refs, archive.refs_by_target)}
    assert archive.insert_refs(refs(spark, ("a", "t3"), ("a", "new"), ("a", "new"))) == 1
    for table, old in before.items():
        new = files(table) - old
        assert old < files(table) and len(new) == 1
        assert spark.read.parquet(*new).count() == 1
    archive.refs.compact()
    assert len(files(archive.refs)) == 1 and archive.refs.read().count() == 21


@pytest.mark.parametrize("few", [True, False])
def test_edges_are_shuffled_once(archive, spark, few):
    """Comparing with the stored edges and dealing the new ones to buckets is one shuffle."""
    archive.insert_refs(refs(spark, *[("a", f"t{n}") for n in range(20)]))
    edges = refs(spark, ("a", "t3"), ("a", "new"), ("a", "new"), ("b", "t3"))
    table = archive.refs
    new = merge.new_edges(edges, table.read(), table.place("from_id", "to_id"))
    assert sorted(map(str, new.collect())) == sorted(
        map(str, merge.new_edges(edges, table.read()).collect())
    )
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1
    assert "SortMergeJoin" not in plan and "rebalance" not in plan.lower()
    assert archive._insert_refs(table, edges, few) == 2
    assert archive._insert_refs(table, edges, few) == 0


def test_named_vectors_are_folded_like_held_ones(spark):
    names = spark.createDataFrame(
        [("a", 1, 1), ("a", 2, 2), ("a", 9, 3), ("b", 2, 1), ("zz", 1, 1), ("c", None, 1)],
        "arxiv_id string, vec_id int, seq int",
    )
    vectors = spark.createDataFrame(
        [(1, [1.0]), (2, [2.0]), (2, [2.0])], "vec_id int, embedding array<float>"
    )
    papers = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "arxiv_id string")
    found = merge.fold_embeddings(names, papers, vectors=vectors)
    held = merge.fold_embeddings(names.join(vectors, "vec_id"), papers)
    assert sorted(found.collect()) == sorted(held.collect()) == [("a", [2.0]), ("b", [2.0])]
    # Vectors are looked up for folded names only: they are read twice, and never meet the batch.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("embedding") < plan.index("max_by")


def test_interrupted_insert_is_completed(archive, spark):
    edges = refs(spark, ("a", "b"))
    archive._insert_refs(archive.refs, edges)
    assert archive.refs_by_target.read().count() == 0
    assert archive.insert_refs(edges) == 0
    assert archive.refs_by_target.read().count() == 1


def test_update_embeddings(archive, spark):
    archive.upsert_papers(batch(spark, row("a"), row("b", 1)), NOW)
    kind = "arxiv_id string, embedding array<float>, seq int"
    rows = [("a", [1.0, 0.0], 0), ("a", [0.0, 1.0], 1), ("zz", [1.0, 1.0], 2)]
    assert archive.update_embeddings(spark.createDataFrame(rows, kind)) == 1
    assert by_id(archive.embeddings.read())["a"].embedding == [0.0, 1.0]
    more = spark.createDataFrame([("a", [2.0, 2.0], 0), ("b", [3.0, 3.0], 0)], kind)
    assert archive.update_embeddings(more) == 2
    got = {k: r.embedding for k, r in by_id(archive.embeddings.read()).items()}
    assert got == {"a": [2.0, 2.0], "b": [3.0, 3.0]}
    with pytest.raises(Exception, match="expected 2 dimensions"):
        archive.update_embeddings(spark.createDataFrame([("a", [1.0], 0)], kind))


def test_mark_full_text_stored(archive, spark):
    archive.upsert_papers(batch(spark, row("a"), row("b", 1)), NOW)
    kind = "arxiv_id string, full_text_path string"
    archive.mark_full_text(spark.createDataFrame([("a", "x"), ("zz", "y")], kind))
    got = by_id(archive.papers.read())
    assert (got["a"].has_full_text, got["b"].has_full_text, len(got)) == (True, False, 2)
    archive.mark_full_text(spark.createDataFrame([("zz", "y")], kind))


def test_state(archive):
    assert archive.get_state("last_sync") == ""
    archive.set_state(a="1", b="2")
    archive.set_state(a="3")
    assert (archive.get_state("a"), archive.get_state("b")) == ("3", "2")


def test_neighbour_table_is_optional(archive, spark):
    assert archive.read_similar() is None
    archive.save_similar(spark.createDataFrame([("a", "b", 0.5, 1)], schemas.SIMILAR))
    archive.save_similar(spark.createDataFrame([("a", "c", 0.7, 1)], schemas.SIMILAR))
    assert [r.similar_id for r in archive.read_similar().collect()] == ["c"]


# --- catalog, graph, statistics ----------------------------------------------------------------


def day(number):
    return datetime.datetime(2024, 4, number)


def test_recent(spark):
    table = papers(
        spark,
        paper("a", published=day(24), categories="cs.AI,cs.LG"),
        paper("b", published=day(23), categories="cs.AI"),
        paper("c", published=day(25), categories="csXAI"),
        paper("d", categories="cs.AI"),
        paper("e", published=NOW + datetime.timedelta(days=3), categories=None),
    )
    found = [r.arxiv_id for r in catalog.recent(table, NOW).collect()]
    assert found == ["e", "c", "a"]
    found = [r.arxiv_id for r in catalog.recent(table, NOW, "cs.A", days=30).collect()]
    assert found == ["a", "b"]
    # Wildcards of the category are not escaped.
    found = [r.arxiv_id for r in catalog.recent(table, NOW, "cs_AI", 30).collect()]
    assert found == ["c", "a", "b"]
    assert catalog.recent(table, NOW, limit=1).count() == 1
    exact = table.where(catalog.in_category("cs.LG", exact=True))
    assert [r.arxiv_id for r in exact.collect()] == ["a"]


def test_recent_skips_older_days(archive, spark):
    rows = [paper(f"p{n:02d}", published=day(1 + n % 28)) for n in range(60)]
    archive.papers.write(papers(spark, *rows), whole=True)
    stored = archive.papers.read()
    found = catalog.recent(stored, NOW, days=5)
    assert found.collect() == catalog.recent(papers(spark, *rows), NOW, days=5).collect()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = catalog.recent(stored, NOW, days=5)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(published_day,2024-04-26)" in plan
    assert catalog.get_paper(stored, "p03").columns == schemas.PAPER_COLS


def test_queues(spark):
    table = papers(
        spark,
        paper("a", abstract="x", published=day(1)),
        paper("b", abstract="x", published=day(2), has_full_text=True),
        paper("c", abstract="", has_full_text=None),
        paper("d", abstract="x"),
        paper("e", abstract="x", published=day(3)),
    )
    vectors = spark.createDataFrame([("e", [1.0])], schemas.EMBEDDINGS)
    queue = catalog.pending_embedding(table, vectors)
    assert [r.arxiv_id for r in queue.collect()] == ["b", "a", "d"]
    assert [r.arxiv_id for r in catalog.pending_full_text(table, 2).collect()] == ["e", "a"]
    assert catalog.pending_full_text(table, "all").count() == 3


def test_details(spark):
    table = papers(
        spark,
        paper("a", has_full_text=True, full_text_path="x/a.txt"),
        paper("b", has_full_text=True, full_text_path=""),
        paper("c", has_full_text=True, full_text_path="x/c.txt"),
    )
    vectors = spark.createDataFrame([("a", [1.0])], schemas.EMBEDDINGS)
    edges = refs(spark, ("a", "b"), ("a", "gone"), ("a", "a"))
    texts = spark.createDataFrame([("a", "A", "x"), ("b", "B", "x")], schemas.FULLTEXT)
    got = by_id(catalog.paper_details(table, vectors, edges, texts))
    assert (got["a"].ref_count, got["a"].cited_by_count, got["a"].full_text) == (3, 1, "A")
    assert (got["b"].ref_count, got["b"].cited_by_count, got["b"].full_text) == (0, 1, None)
    assert (got["c"].cited_by_count, got["c"].full_text, got["c"].embedding) == (0, None, None)
    one = by_id(catalog.paper_detail(table, vectors, edges, texts, "a"))
    assert one == {"a": got["a"]}
    assert catalog.paper_detail(table, vectors, edges, texts, "gone").count() == 0


def test_graph_with_a_hub(spark):
    table = papers(spark, *[paper(f"p{n:02d}", has_full_text=True) for n in range(40)])
    edges = refs(spark, *[("p00", f"p{n:02d}") for n in range(30)], ("p01", "gone"))
    counts = by_id(graph.degrees(edges))
    assert (counts["p00"].ref_count, counts["p00"].cited_by_count) == (30, 1)
    assert (counts["gone"].ref_count, counts["gone"].cited_by_count) == (0, 1)
    assert graph.degree(edges, "none").first().ref_count == 0
    assert graph.references(edges, table, "p01").count() == 0
    assert [r.to_id for r in graph.reference_ids(edges, "p01").collect()] == ["gone"]
    assert graph.cited_by(edges, table, "p05").first().arxiv_id == "p00"
    assert graph.missing_references(table, edges).count() == 38
    assert graph.missing_reference_count(table, edges).first().papers == 38


def test_stats(spark):
    table = papers(
        spark,
        paper("a", categories="cs.AI, cs.CL", published=day(30), has_full_text=True),
        paper("b", categories="cs.AI,cs.CL", published=day(10)),
        paper("c", categories=""),
        paper("d", has_full_text=None),
    )
    vectors = spark.createDataFrame([("a", [1.0])], schemas.EMBEDDINGS)
    state = spark.createDataFrame([("last_sync", "x")], schemas.SYNC_STATE)
    got = stats.archive_stats(table, vectors, refs(spark, ("a", "b")), state, NOW).first()
    # Names are not trimmed: "cs.CL" and " cs.CL" differ.
    assert got.asDict() == {
        "total_papers": 4, "with_full_text": 1, "with_embedding": 1, "total_refs": 1,
        "categories_count": 3, "oldest_paper": day(10), "newest_paper": day(30),
        "last_sync": "x", "papers_last_7_days": 1, "papers_last_30_days": 2,
    }
    assert stats.category_names(table, r"[,\s]+").count() == 2
    empty = stats.archive_stats(
        papers(spark), vectors.limit(0), refs(spark), state.limit(0), NOW
    ).first()
    assert (empty.total_papers, empty.last_sync) == (0, "")
    assert empty.oldest_paper == datetime.datetime(1970, 1, 1)
    assert stats.progress(table, vectors).first().asDict() == {
        "total": 4, "with_text": 1, "with_embedding": 1,
    }


def test_listing(spark):
    table = papers(spark, paper("a", title="x" * 90, published=day(2), categories="c" * 31))
    got = catalog.listing(table).first()
    assert (got.title, got.date) == ("x" * 77 + "...", "2024-04-02")
    assert got.categories == "c" * 27 + "..."
    assert catalog.listing(papers(spark, paper("a"))).select(F.col("date")).first()[0] == ""


def test_a_cut_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle")}

    before = shuffles()
    counted = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before
    assert {r["count"] for r in counted.collect()} == {142, 143}
