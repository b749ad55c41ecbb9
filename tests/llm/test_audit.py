import hashlib
import re
from collections import Counter
from itertools import permutations

from fixtures import documents, empty, sentence, words
from pyspark.sql import functions as F

from paperlake.llm import audit

SHAPE = "doc_id long, text string, source string, n long, part string, good string, pos int"


def failed(text, doc_id, least):
    own = words(text)
    return {
        name
        for name, fails in {
            "A": len(own) < 50,
            "B": 100 * len(set(own)) < 65 * len(own),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > least.get(text, doc_id),
        }.items()
        if fails
    }


def brute(rows, labels):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    labels = [r for r in labels if r[0] is not None]
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    counts, shares = Counter(), Counter()
    for doc_id, text, source in rows:
        part = source or ""
        fails = failed(text or "", doc_id, least)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                key = part, order, step
                counts[key, "rows"] += 1
                lost = f in fails and not gone
                counts[key, "redundant"] += f in fails and gone
                gone = gone or f in fails
                counts[key, "kept"] += not gone
                counts[key, "removed"] += lost
                counts[key, "unique_fails"] += fails == {f}
                counts[key, "good_lost"] += lost and doc_id in good
                counts[key, "toxic_lost"] += lost and doc_id in toxic
                shares[part, f] += lost
    keys = sorted({key for key, name in counts if name == "rows"})
    return [
        (*key, *(counts[key, c] for c in audit.COUNTS), shares[key[0], key[1][key[2] - 1]])
        for key in keys
    ]


def given():
    rows = []
    for i, (doc_id, text) in enumerate(documents()):
        rows.append((doc_id, text, ["a", "b", None, "", "ü"][i % 5]))
    long = sentence(__import__("random").Random(5), 30_000, 10**6)
    rows += [(5000 + i, long, "a") for i in range(3)]
    rows += [(6000, long + " #", "b"), (6001, "ONE Two " * 40, "b"), (6001, "ONE Two " * 40, "a")]
    rows += [(None, long, "b"), (None, None, "a"), (-3, "", "zero"), (5000, long, "a")]
    rows += [(7000 + i, "hot text of one source", "hot") for i in range(200)]
    rows += [(6500, "A" * 5 + "b" * 95, "edge"), (6501, "A" * 6 + "b" * 94, "edge")]
    rows += [(6502, " ".join(f"w{i % 65}" for i in range(100)), "edge")]
    rows += [(6503, " ".join(f"w{i % 64}" for i in range(100)), "edge")]
    labels = [(d, i % 3 and 1, i % 4 == 0 and 1 or 0) for i, (d, _, _) in enumerate(rows)]
    return rows, labels + [(6001, 1, 1), (None, 1, 1), (6502, None, None), (999_999, 1, 1)]


def found(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x", None, 2) for r in rows], SHAPE).repartition(3)
    marks = spark.createDataFrame(
        [(*r, 7, "y") for r in labels],
        "doc_id long, quality int, toxic int, n int, source string",
    )
    out = audit.interactions(docs, marks)
    assert out.columns == ["part", "filter_order", "step", *audit.COUNTS, "shapley"]
    return sorted(map(tuple, out.collect()))


def test_matches_brute_force(spark):
    rows, labels = given()
    assert found(spark, rows, labels) == brute(rows, labels)


def test_every_part_has_all_orders_and_steps_zeros_included(spark):
    out = found(spark, [(1, sentence(__import__("random").Random(1), 60, 10**6), None)], [])
    assert len(out) == 600 and {r[0] for r in out} == {""}
    assert all(r[3:] == (1, 0, 0, 0, 0, 0, 0) for r in out)


def test_shares_add_up(spark):
    rows, labels = given()
    out = found(spark, rows, labels)
    gone = {p: 0 for p, *_ in out}
    for part, _, _, _, removed, *_ in out:
        gone[part] += removed
    shares = {(r[0], r[1][r[2] - 1]): r[-1] for r in out}
    for part, total in gone.items():
        assert sum(v for (p, _), v in shares.items() if p == part) == total


def test_no_rows(spark):
    assert found(spark, [], [(1, 1, 1)]) == []
    docs = empty(spark, "doc_id long, text string, source string")
    assert audit.masks(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))).count() == 0


def test_texts_are_counted_not_moved(spark):
    rows, labels = given()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    digest = hashlib.sha256(b"hot text of one source").digest()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.labelled(docs, marks)
    assert got.columns == ["id", "part", "digest", "mask", "good", "toxic"]
    assert got.where(F.col("digest") == digest).count() == 200
