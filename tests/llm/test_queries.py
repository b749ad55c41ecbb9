"""The queries on the smallest tables, and the pipeline stage by stage."""

import hashlib
import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from test_packing import PATH

SF_DIR = "/root/testdata/sf0.001"
if not Path(SF_DIR).exists():
    pytest.skip("no test tables", allow_module_level=True)

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from paperlake.llm import queries  # noqa: E402
from test_jaccard import brute as near  # noqa: E402
from test_secrets import brute as secrets  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

COLUMNS = {
    "op1_ngram_jaccard_join": "doc_id n_shingles component_id",
    "op2_license_scans": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op3_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_benchmark_decontamination": "doc_id item_id",
    "op5_url_filters": "page_id host path rule verdict",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_html_extraction": "page_id url text n_chars",
    "op8_language_id": "doc_id held_out lang_pred score",
    "op9_secret_scans": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op11_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op12_filter_interactions": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13_tokenizer_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    table = entry.queries()[name](spark, SF_DIR)
    wanted = COLUMNS[name].split()
    assert table.columns[: len(wanted)] == wanted
    rows = table.count()
    if name == "op4_benchmark_decontamination":
        assert rows > 0
    elif name in ("op5_url_filters", "op7_html_extraction"):
        assert rows == spark.read.parquet(f"{SF_DIR}/pages.parquet").count()
    elif name == "op12_filter_interactions":
        assert rows == 600 * documents(spark).select("source").distinct().count()
    elif name != "op6_packing":
        assert rows == documents(spark).count()


def test_held_out_is_crc32(spark):
    import zlib

    got = documents(spark).select("doc_id", queries.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_pipeline_by_stages(spark):
    given = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "language_id", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "packing",
    ]
    docs = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == given.columns
        before = {r.doc_id: r.text for r in docs.collect()}
        out = spark.createDataFrame(out.collect(), given.schema)
        after = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
        elif name == "ngram_jaccard_join":
            expected = near(list(before.items()), 5, 80)
            assert set(after) == {d for d, (_, c, _) in expected.items() if d == c}
        elif name == "benchmark_decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
            whole = {d for d, t in before.items() if any(item in t for item in items)}
            assert whole and not whole & set(after)
        else:
            assert set(after) == set(before)
            for doc_id, text in before.items():
                if secrets(text):
                    assert "<secret>" in after[doc_id].text
                    assert not secrets(after[doc_id].text)
            assert all(r.n_chars == len(r.text) for r in after.values())
        docs = out
    tokenizer = Tokenizer.from_file(PATH)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    tokens = {
        r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
        for r in docs.collect()
    }
    assert {r.doc_id: r.doc_tokens for r in packed} == tokens
    assert sum(r.length for r in packed) == sum(tokens.values())


def test_secret_hash_of_a_document_without_any(spark):
    rows = entry.queries()["op9_secret_scans"](spark, SF_DIR).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.base_sha256 == empty) == (r.n_assign + r.n_access + r.n_hex == 0) for r in rows)


def test_oracles(spark):
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        found = entry.queries()[name](spark, SF_DIR)
        result = connection.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(found.columns)
        expected = sorted(map(str, result.fetchall()))
        assert sorted(str(tuple(r[c] for c in columns)) for r in found.collect()) == expected


def test_the_rest_imports_without_the_subpackage():
    code = (
        "import sys; sys.modules['paperlake.llm'] = None; import __spark_entry__ as e, json;"
        "print(json.dumps(sorted(e.queries())))"
    )
    root = Path(entry.__file__).parent
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    names = json.loads(out.stdout.splitlines()[-1])
    assert "recent_week" in names and "pipeline" not in names and not set(COLUMNS) & set(names)
