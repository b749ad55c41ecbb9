import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.operators import cells, embed, ivf, knn, neighbours
from paperlake.plans import similar
from paperlake.schemas import EMBEDDINGS, PAPERS
from paperlake.session import cut


def frame(spark, vectors, parts=4):
    rows = [(f"p{n:05d}", None if v is None else [float(x) for x in v]) for n, v in vectors]
    return spark.createDataFrame(rows, EMBEDDINGS).repartition(parts)


def random_vectors(n, dim=8, seed=1):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


def brute(vectors, k):
    """Top k other rows of every row, ties by number."""
    unit = vectors.astype(np.float64)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    similarity = np.round(unit @ unit.T, 12)
    out = {}
    for n, line in enumerate(similarity):
        order = [m for m in np.lexsort((np.arange(len(line)), -line)) if m != n]
        out[f"p{n:05d}"] = [(f"p{m:05d}", round(line[m], 9)) for m in order[:k]]
    return out


def table(rows):
    out = {}
    for row in sorted(rows.collect(), key=lambda r: (r.arxiv_id, r["rank"])):
        out.setdefault(row.arxiv_id, []).append((row.similar_id, round(row.similarity, 9)))
    return out


def test_scan_by_id_and_vector(spark):
    vectors = random_vectors(300)
    data = frame(spark, enumerate(vectors))
    expected = brute(vectors, 10)["p00007"]
    found = knn.similar_by_id(data, "p00007").collect()
    assert [(r.arxiv_id, round(r.similarity, 9)) for r in found] == expected
    found = knn.similar_by_vector(data, vectors[7], 3).collect()
    assert [r.arxiv_id for r in found] == ["p00007", *[i for i, _ in expected[:2]]]


def test_scan_edge_cases(spark):
    data = frame(spark, enumerate([[1, 0], [2, 0], None, [0, 0], [0, 1], [3, 0]]))
    found = knn.similar_by_id(data, "p00000").collect()
    # Ties by id; the zero vector has no similarity and comes last.
    assert [(r.arxiv_id, r.similarity) for r in found] == [
        ("p00001", 1.0), ("p00005", 1.0), ("p00004", 0.0), ("p00003", None),
    ]
    assert knn.similar_by_id(data, "p00002").count() == 0
    assert knn.similar_by_id(data, "absent").count() == 0


def test_scan_many_queries(spark):
    vectors = random_vectors(200)
    data = frame(spark, enumerate(vectors))
    expected = brute(vectors, 4)
    own = [f"p{n:05d}" for n in range(5)]
    found = knn.scan(data, vectors[:5].astype(float), 4, own).collect()
    for n in range(5):
        mine = sorted((r for r in found if r.query == n), key=lambda r: -r.similarity)
        assert [r.arxiv_id for r in mine] == [i for i, _ in expected[own[n]]]


def test_index_size_rule():
    assert [ivf.n_lists(n) for n in (1, 100, 10_000, 1_000_000)] == [2, 10, 100, 1000]


def test_index_search(spark, tmp_path):
    vectors = random_vectors(1200)
    vectors[5] = 0
    data = frame(spark, enumerate(vectors))
    index = ivf.build(data, str(tmp_path / "index"), lists=30)
    # Zero vectors are not indexed, everything else is.
    assert index.cells().count() == 1199
    truth = [r.arxiv_id for r in knn.similar_by_id(data, "p00011").collect()]
    exact = ivf.search_by_id(index, data, "p00011", nprobe=1, exact=True).collect()
    assert [r.arxiv_id for r in exact] == truth
    probed = ivf.search_by_id(index, data, "p00011", nprobe=10).collect()
    assert len(set(truth) & {r.arxiv_id for r in probed}) >= 7
    assert ivf.search_by_id(index, data, "absent").count() == 0
    plan = ivf.search(index, vectors[11], nprobe=2)._jdf.queryExecution().executedPlan()
    filters = plan.toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "cell#" in filters and " IN (" in filters
    assert ivf.build(frame(spark, enumerate(vectors[5:6])), str(tmp_path / "none")) is None
    few = ivf.build(frame(spark, enumerate(vectors[:30])), str(tmp_path / "few"))
    assert few.cells().count() == 29


def test_index_is_kept_and_extended(spark, tmp_path):
    vectors = random_vectors(1100)
    path = str(tmp_path / "index")
    index = ivf.build(frame(spark, list(enumerate(vectors))[:1000]), path, lists=20)
    data = frame(spark, enumerate(vectors))
    assert ivf.build(data, path, lists=5).centroids.shape == (20, 8)
    more = frame(spark, list(enumerate(vectors))[1000:])
    for _ in range(2):
        index = ivf.add(index, more, "second")
    assert index.cells().count() == 1100
    truth = [r.arxiv_id for r in knn.similar_by_id(data, "p01050").collect()]
    exact = ivf.search_by_id(index, data, "p01050", nprobe=1, exact=True).collect()
    assert [r.arxiv_id for r in exact] == truth


def test_neighbours_one_block(spark):
    vectors = random_vectors(150)
    assert table(neighbours.build(frame(spark, enumerate(vectors)), 5)) == brute(vectors, 5)


def test_neighbours_many_blocks_are_exact(spark):
    vectors = random_vectors(400)
    got = neighbours.build(frame(spark, enumerate(vectors)), 5, max_block=32)
    assert table(got) == brute(vectors, 5)


def test_neighbours_with_crowded_cell_and_copies(spark):
    # A third of the rows are copies of one vector, a third lie close together.
    spread = random_vectors(100, 6, 2)
    copies = np.tile(random_vectors(1, 6, 3), (100, 1))
    close = (random_vectors(1, 6, 4) + 0.01 * random_vectors(100, 6, 5)).astype(np.float32)
    vectors = np.concatenate((spread, copies, close))
    got = neighbours.build(frame(spark, enumerate(vectors)), 4, max_block=16)
    assert table(got) == brute(vectors, 4)


def test_neighbours_few_rows(spark):
    vectors = random_vectors(3)
    rows = [*enumerate(vectors), (9, np.zeros(8))]
    assert table(neighbours.build(frame(spark, rows), 10)) == brute(vectors, 10)


def test_neighbours_probing(spark):
    vectors = random_vectors(400)
    truth = brute(vectors, 5)
    got = table(neighbours.build(frame(spark, enumerate(vectors)), 5, max_block=32, nprobe=12))
    hits = sum(len({i for i, _ in truth[p]} & {i for i, _ in got[p]}) for p in truth)
    assert hits / (5 * len(truth)) > 0.8


def test_probes_reach_the_recall_asked_for(spark):
    centres = random_vectors(30, 16)
    close = np.repeat(centres, 20, axis=0) + 0.1 * random_vectors(600, 16)
    for vectors, most in ((random_vectors(600, 16), 80), (close.astype(np.float32), 12)):
        truth = brute(vectors, 5)
        data = frame(spark, enumerate(vectors))
        rows = data.select(F.col("arxiv_id").alias("rep"), "embedding")
        found = cells.build(rows, 600, 40)
        assert found.rows.count() == 600 and found.fine.agg(F.sum("rows")).first()[0] == 600
        coarse, fine = neighbours.probes(found, 5, 0.95)
        assert 1 <= coarse <= len(found.centroids) and 1 <= fine <= min(most, found.fine.count())
        got = table(neighbours.build(data, 5, max_block=30, recall=0.95))
        hits = sum(len({i for i, _ in truth[p]} & {i for i, _ in got[p]}) for p in truth)
        assert hits >= 0.9 * 5 * 600


def test_training_takes_a_bounded_sample(spark, monkeypatch):
    seen = []
    kmeans = cells.kmeans
    monkeypatch.setattr(cells, "kmeans", lambda rows, k, seed: seen.append(len(rows)) or kmeans(rows, k, seed))
    monkeypatch.setattr(cells, "SAMPLE", 4)
    data = frame(spark, enumerate(random_vectors(2000)))
    rows = data.select(F.col("arxiv_id").alias("rep"), "embedding")
    found = cells.build(rows, 2000, 100)
    assert seen == [s for s in seen if s <= 40] and len(found.centroids) == 10
    assert found.rows.count() == 2000 and 90 <= found.fine.count() <= 100


def papers_for(spark, n):
    rows = [(f"p{i:05d}", f"title {i}", "text", *[None] * 9) for i in range(n)]
    return spark.createDataFrame(rows, PAPERS)


def test_stored_neighbours_then_fallback(spark):
    vectors = random_vectors(60)
    data, papers = frame(spark, enumerate(vectors)), papers_for(spark, 50)
    stored = neighbours.build(data.where("arxiv_id < 'p00030'"), 4)
    found = similar.by_id(papers, data, "p00003", 4, similar=stored).collect()
    assert [r.arxiv_id for r in found] == [i for i, _ in table(stored)["p00003"]]
    # No stored row: the scan answers; papers not in the archive are left out afterwards.
    found = similar.by_id(papers, data, "p00040", 4, similar=stored).collect()
    expected = [i for i, _ in brute(vectors, 4)["p00040"] if i < "p00050"]
    assert [r.arxiv_id for r in found] == expected



def test_neighbours_of_many_papers(spark):
    vectors = random_vectors(60)
    data, papers = frame(spark, enumerate(vectors)), papers_for(spark, 50)
    stored = cut(neighbours.build(data.where("arxiv_id < 'p00030'"), 6))
    # The first two stored neighbours of one paper leave the archive: the next ones move up.
    gone = [i for i, _ in table(stored)["p00003"][:2]]
    left = papers.where(~F.col("arxiv_id").isin(gone))
    asked = papers.where("arxiv_id IN ('p00003', 'p00040', 'p00045')").unionByName(
        papers_for(spark, 1).withColumn("arxiv_id", F.lit("no vector"))
    )
    got = table(similar.many(stored, left, data, asked, limit=3))
    assert set(got) == {"p00003", "p00040", "p00045"}
    assert [i for i, _ in got["p00003"]] == [i for i, _ in table(stored)["p00003"][2:5]]
    known = {f"p{n:05d}" for n in range(50)} - set(gone)
    for name in ("p00040", "p00045"):
        assert [i for i, _ in got[name]] == [
            i for i, _ in brute(vectors, 59)[name] if i in known
        ][:3]
    # Ids that are stored start no scan.
    plan = similar.many(stored, papers, data, papers.where("arxiv_id = 'p00003'"))
    assert "CoGroups" not in plan._jdf.queryExecution().executedPlan().toString()


def test_many_queries_are_scanned_in_blocks(spark, monkeypatch):
    vectors = random_vectors(40)
    data = frame(spark, enumerate(vectors))
    queries = vectors[:7].astype(float)
    own = [f"p{n:05d}" for n in range(7)]
    expected = sorted(knn.scan(data, queries, 3, own).collect())
    monkeypatch.setattr(knn, "QUERY_BYTES", 2 * queries[0].nbytes)
    assert sorted(knn.scan(data, queries, 3, own).collect()) == expected


def test_lookup_dispatch(spark):
    papers = papers_for(spark, 20)
    vectors = embed.embed_papers(papers, dim=16).drop("failed")
    by_text = similar.lookup(papers, vectors, "title 3", dim=16, limit=2).collect()
    assert len(by_text) == 2
    assert similar.lookup(papers, vectors, "none.00000", dim=16).count() == 0


def test_embed_batches(spark):
    rows = spark.createDataFrame(
        [(f"p{n:03d}", "bad" if n == 60 else f"t{n}") for n in range(120)],
        "arxiv_id string, text string",
    ).coalesce(1)

    def embedder(texts):
        assert len(texts) <= 50
        if "bad" in texts:
            raise RuntimeError("no service")
        return [[float(t[1:]), 1.0] for t in texts]

    done = {r.arxiv_id: r for r in embed.embed(rows, embedder, 2).collect()}
    assert len(done) == 120
    assert done["p007"].embedding == [7.0, 1.0]
    failed = [i for i, r in done.items() if r.failed]
    assert len(failed) == 50
    assert all(done[i].embedding is None for i in failed)
    assert {r.problem for r in done.values() if r.failed} == {"RuntimeError: no service"}


@pytest.mark.parametrize("answer", [[[1.0]], [[1.0], None], [[1.0], [1.0, 2.0]]])
def test_embedder_answers_are_checked(answer):
    with pytest.raises(ValueError):
        embed.checked(answer, 2, 1)


def test_hashed_embedding(spark):
    rows = spark.createDataFrame([("a", "Some words"), ("b", "?")], "arxiv_id string, text string")
    out = embed.embed_hashed(rows, 32).select("arxiv_id", F.size("embedding"), "embedding")
    found = {r.arxiv_id: np.array(r.embedding) for r in out.collect()}
    assert found["a"].shape == (32,)
    assert np.linalg.norm(found["a"]) == pytest.approx(1.0)
    assert not found["b"].any()


def test_a_task_holds_one_set_of_hits_however_many_blocks():
    import tracemalloc

    import pyarrow as pa

    k, queries, rows = 11, random_vectors(3000, 8, 1), random_vectors(4096, 8, 2)
    n = np.arange(len(rows))
    right = pa.table(
        {
            "other": pa.array([f"r{i:05d}" for i in n]), "fine": pa.array(n // 64, pa.int32()),
            "vector": pa.array(rows.tolist(), pa.list_(pa.float32())),
        }
    )
    left = pa.table(
        {
            "rep": pa.array([f"q{i:05d}" for i in range(len(queries))]),
            "embedding": pa.array(queries.tolist(), pa.list_(pa.float32())),
            "fines": pa.array([list(range(64))] * len(queries), pa.list_(pa.int32())),
            "floor": pa.nulls(len(queries), pa.float64()),
        }
    )
    compare = neighbours._compared(k, 16)
    tracemalloc.start()
    found = compare(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == k * len(queries) and peak < 60e6
    unit = [v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None] for v in (queries, rows)]
    truth = np.round(unit[0] @ unit[1].T, 12)
    got = found.to_pydict()
    hits = {}
    for rep, other in zip(got["rep"], got["arxiv_id"], strict=True):
        hits.setdefault(int(rep[1:]), set()).add(int(other[1:]))
    best = np.argsort(-truth, axis=1, kind="stable")[:, :k]
    assert all(hits[q] == set(best[q].tolist()) for q in hits)


def test_neighbours_of_close_cells_and_scaled_copies_are_exact(spark):
    # Clusters that single precision cannot tell apart, and equal directions of other lengths.
    centres = random_vectors(12, 6, 6)
    close = np.repeat(centres, 20, axis=0) + 1e-4 * random_vectors(240, 6, 7)
    scaled = (random_vectors(40, 6, 8)[:, None] * np.array([1, 2, 4])[:, None]).reshape(-1, 6)
    vectors = np.concatenate((close, scaled)).astype(np.float32)
    got = neighbours.build(frame(spark, enumerate(vectors)), 6, max_block=24)
    assert table(got) == brute(vectors, 6)


def test_a_task_keeps_its_vectors_in_single_precision_only():
    import tracemalloc

    import pyarrow as pa

    k, queries, rows = 5, random_vectors(64, 64, 1), random_vectors(32768, 64, 2)
    sizes = pa.array(np.arange(len(rows) + 1) * 64, pa.int32())
    right = pa.table(
        {
            "other": pa.array([f"r{i:05d}" for i in range(len(rows))]),
            "fine": pa.array(np.arange(len(rows)) % 7, pa.int32()),
            "vector": pa.ListArray.from_arrays(sizes, pa.array(rows.ravel())),
        }
    )
    left = pa.table(
        {
            "rep": pa.array([f"q{i:05d}" for i in range(len(queries))]),
            "embedding": pa.array(queries.tolist(), pa.list_(pa.float32())),
            "fines": pa.nulls(len(queries), pa.list_(pa.int32())),
            "floor": pa.nulls(len(queries), pa.float64()),
        }
    )
    tracemalloc.start()
    found = neighbours._compared(k, 4096)(left, right).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.2 * rows.nbytes
    unit = [v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None] for v in (queries, rows)]
    best = np.argsort(-np.round(unit[0] @ unit[1].T, 12), axis=1, kind="stable")[:, :k]
    hits = {}
    for rep, other in zip(found["rep"], found["arxiv_id"], strict=True):
        hits.setdefault(int(rep[1:]), set()).add(int(other[1:]))
    assert all(hits[q] == set(best[q].tolist()) for q in range(len(queries)))
