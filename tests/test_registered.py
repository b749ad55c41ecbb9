"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

SF_DIR = "/root/testdata/sf0.001"

if not Path(SF_DIR).exists():
    pytest.skip("no test tables", allow_module_level=True)
pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from check_oracles import compare, connect  # noqa: E402

# Smallest tables: every document has a vector, so nothing is pending.
EMPTY = {"pending_embedding", "pending_embedding_all", "embed_pending", "search_english"}


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    problem = compare(spark, connection, SF_DIR, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None or (name in EMPTY and problem == "no rows")


def test_oracles_are_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_similar_many_asks_for_every_paper(spark, tmp_path):
    import __spark_entry__ as entry

    n = 43
    tables = {
        "documents": (
            [(i, f"text {i}", "en", "web", 6) for i in range(n)],
            "doc_id long, text string, lang string, source string, n_chars long",
        ),
        "orders": ([(0, None)], "o_orderkey long, o_orderdate timestamp_ntz"),
        "labels": ([(i, 1, 0) for i in range(0, n, 2)], "doc_id long, quality int, toxic int"),
        "embeddings": (
            [(i, [float(i + 1), 1.0]) for i in range(n)], "vec_id long, embedding array<float>",
        ),
        "conversations": ([(i,) for i in range(0, n, 3)], "conv_id long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = entry.similar_many(spark, str(tmp_path)).groupBy("arxiv_id").count().collect()
    assert len(found) == n and all(1 <= r["count"] <= 3 for r in found)
