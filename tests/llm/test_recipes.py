import hashlib
import random
import re

from fixtures import documents, empty, frame, sentence
from pyspark.sql import functions as F

from paperlake.llm import recipes

ODD = [
    (2000, "a  b"), (2001, "a\tb"), (2002, "a b "), (2003, " a b"), (2004, "A b"),
    (2005, "a b"), (7, "a b"), (7, "a b"), (None, "a\nb"), (None, "alone"), (2006, " "),
    (2007, "\r\n\t"), (2008, "x" * 300_000), (2009, "x" * 300_000), (2010, "x" * 299_999),
    (2011, "語" * 5000 + "。" + "文" * 300), (2012, "語" * 5000 + "。" + "文" * 300),
    (2013, "no stop " * 40_000), (2014, "no  stop " * 40_000), (2015, "no stop " * 39_999),
]


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        key = re.sub("[\x20\x09-\x0d]+", " ", text or "")
        groups.setdefault(key, []).append(doc_id)
    found = []
    for key, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        digest = hashlib.sha256(key.encode()).hexdigest()
        found += [(str(d), str(ids[0]), len(ids), i == 0, digest) for i, d in enumerate(ids)]
    return sorted(found)


def found(table, **more):
    rows = recipes.groups(table, **more)
    assert rows.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((str(r[0]), str(r[1]), *r[2:]) for r in map(tuple, rows.collect()))


def test_matches_brute_force(spark):
    rows = documents() + ODD
    rows += [(3000 + i, "hot copy of a text") for i in range(400)]
    assert found(frame(spark, rows)) == brute(rows)


def test_identifiers_that_stand_for_two_contents_get_more_bits(spark):
    rows = documents() + ODD
    table = frame(spark, rows)
    text = recipes.normalised(F.col("text")).alias("t")
    chunks = recipes.chunked(table.select(text), "t").select(F.explode_outer("chunks").alias("chunk"))
    chunks = chunks.where("chunk IS NOT NULL")
    assert recipes.ambiguous(chunks, 2).count() == 4
    assert recipes.verified_bits(chunks, 2) >= 8
    assert found(table, bits=2) == brute(rows)


def test_chunks_are_the_text_and_bounded(spark):
    rows = [r for r in documents() + ODD if r[0] is not None]
    table = frame(spark, rows).withColumn("t", recipes.normalised(F.col("text")))
    for row in recipes.chunked(table, "t").select("t", "chunks").collect():
        assert "".join(row.chunks) == row.t and all(row.chunks)
        assert max(map(len, row.chunks), default=0) <= 128 * 2 * recipes.LONGEST


def test_a_shared_passage_shares_chunks_wherever_it_stands(spark):
    rng = random.Random(3)
    passage = sentence(rng, 3000)
    texts = [f"{sentence(rng, n)} {passage} {sentence(rng, n)}" for n in (1, 5, 17, 400)]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    chunks = [set(r.chunks) for r in recipes.chunked(table, "t").select("chunks").collect()]
    shared = sum(map(len, set.intersection(*chunks)))
    assert shared >= 0.8 * len(passage)


def test_no_rows_and_all_null(spark):
    assert found(empty(spark)) == []
    rows = [(None, None), (None, None), (4, None), (3, "")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_native_and_columns_kept(spark):
    table = frame(spark, documents())
    plan = recipes.recipes(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    kept = recipes.recipes(table).columns
    assert kept == [*(c for c in table.columns if c != "text"), "text_sha256", "recipe"]
