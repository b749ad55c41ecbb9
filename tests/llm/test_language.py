import random

import numpy as np
from fixtures import empty, frame

from paperlake.llm import language, queries

SYLLABLES = {
    "xa": "ba be bi bo bu da de di do du".split(),
    "xb": "sch ung ein heit lich ver ach pf tz ö".split(),
    "xc": "eau oux aient é è ç que tion elle ment".split(),
}
COLUMNS = "doc_id long, text string, lang string"


def texts(count, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        lang = sorted(SYLLABLES)[i % 3]
        words = (
            "".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4)))
            for _ in range(rng.randrange(3, 60))
        )
        rows.append((i, " ".join(words).capitalize(), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = texts(300) + [(900, None, "xa"), (901, "12 !?", "xb"), (902, "", None), (903, "ba be", None)]
    table = frame(spark, rows, COLUMNS).withColumn("held", queries.held_out())
    model = language.fit(table.where("NOT held"))
    assert model.languages == sorted(model.languages) and set(model.languages) == set(SYLLABLES)
    got = {r.doc_id: r for r in language.identify(table, model, ["doc_id", "lang", "held"]).collect()}
    tested = [r for r in got.values() if r.held and r.doc_id < 900]
    assert len(tested) > 50
    assert sum(r.lang == r.lang_pred for r in tested) >= 0.97 * len(tested)
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert not any(r.rejected for r in got.values() if r.doc_id < 900)


def test_foreign_text_is_rejected(spark):
    model = language.fit(frame(spark, texts(300), COLUMNS))
    rows = [(1, "жщы юяэ ъьы " * 20, None), (2, "ba be bi bo " * 20, None)]
    got = {r.doc_id: r.rejected for r in language.identify(frame(spark, rows, COLUMNS), model, ["doc_id"]).collect()}
    assert got == {1: True, 2: False}


def odd_rows(count=9):
    """Labelled rows that are no text of their language, and one-word rows."""
    rng = random.Random(3)
    rows = []
    for i in range(count):
        junk = "".join(rng.choices("QWXZJKVqwxzjkv0123456789+/=", k=40 + 60 * i))
        rows += [(2000 + i, junk, sorted(SYLLABLES)[i % 3])]
        rows += [(3000 + i, SYLLABLES["xa"][i], "xa")]
    return rows


def test_odd_labelled_rows_do_not_switch_rejection_off(spark):
    model = language.fit(frame(spark, texts(600) + odd_rows(), COLUMNS))
    rng = random.Random(5)
    foreign = [
        "Wczoraj wieczorem poszliśmy do kina, a potem długo rozmawialiśmy o filmie.",
        "Вчера вечером мы пошли в кино и долго говорили о фильме.",
        "昨天晚上我们去看电影，然后谈了很久。我们都很喜欢这部电影。",
        "for (int i = 0; i < n; ++i) { sum += a[i] * b[i]; } return sum;",
        "".join(rng.choices("QWXZJKVqwxzjkv0123456789+/=", k=300)),
    ]
    rows = [(i, text, None) for i, text in enumerate(foreign)]
    own = [(1000 + i, text, lang) for i, text, lang in texts(300, seed=7)]
    table = frame(spark, rows + own, COLUMNS)
    got = {r.doc_id: r.rejected for r in language.identify(table, model, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(foreign))] == [True] * len(foreign)
    assert sum(got[i] for i, _, _ in own) <= 0.01 * len(own)


def test_weights_count_all_labelled_rows(spark):
    rows = [(i, "zq", "xa") for i in range(300)] + [(1000 + i, "ba", "xb") for i in range(20)]
    few = language.fit(frame(spark, rows, COLUMNS), sample=20)
    assert (few.weights == language.fit(frame(spark, rows, COLUMNS), sample=1000).weights).all()


def test_rows_of_one_id_are_sampled_apart(spark):
    table = frame(spark, [(None, text, "xa") for _, text, _ in texts(600)], COLUMNS)
    assert 100 < language._sample(table, 200).count() < 300


def test_sample_is_bounded_and_columns_pass(spark):
    table = frame(spark, texts(600), COLUMNS)
    assert language._sample(table, 50).count() < 250
    model = language.fit(table, sample=50, centroids=2)
    out = language.identify(table, model, table.columns)
    assert out.columns == [*table.columns, "lang_pred", "score", "rejected"]
    assert out.count() == 600


def test_long_texts_count_like_short_slices(monkeypatch):
    import pyarrow as pa

    column = pa.array(["ab, cd  " * 500, "xyz", None])
    whole = np.concatenate([c for _, _, c in language._counts(column)])
    monkeypatch.setattr(language.hashing, "SLICE_BYTES", 64)
    assert (np.concatenate([c for _, _, c in language._counts(column)]) == whole).all()


def test_nothing_to_learn_from(spark):
    model = language.fit(empty(spark, COLUMNS))
    got = language.identify(frame(spark, texts(5), COLUMNS), model, ["doc_id"]).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert language.identify(empty(spark, COLUMNS), model, ["doc_id"]).count() == 0


def test_a_batch_is_lowered_in_bounded_parts(monkeypatch):
    import pyarrow as pa

    column = pa.array([text * 20 for _, text, _ in texts(3000)] + [None, "É" * 3000, "z"])
    whole = list(language._counts(column))
    assert [last for _, last, _ in whole][:-1] == [first for first, _, _ in whole][1:]
    assert whole[-1][1] == len(column)
    monkeypatch.setattr(language, "LOWERED_BYTES", 8 << 17)
    monkeypatch.setattr(language.hashing, "SLICE_BYTES", 1 << 17)
    before = pa.total_allocated_bytes()
    cut = []
    for first, last, counts in language._counts(column):
        # Not the lower-cased texts of the whole batch (some 15 MB).
        assert pa.total_allocated_bytes() - before < 4 << 20
        cut.append((first, last, counts))
    assert (np.concatenate([c for *_, c in cut]) == np.concatenate([c for *_, c in whole])).all()
    monkeypatch.setattr(language, "LOWERED_BYTES", 1 << 30)
    monkeypatch.setattr(language, "LOWERED_ROWS", 1 << 30)
    assert [s[:2] for s in cut] == [s[:2] for s in language._counts(column)]


def test_kept_columns_do_not_pass_through_python(spark):
    rows = [(None, "a b", "xa"), (None, "a b", "xa"), (1, None, None), (1, "", "xb")]
    table = frame(spark, [*texts(300), *rows], COLUMNS)
    model = language.fit(table, sample=100, centroids=2)
    out = language.identify(table, model, table.columns)
    plan = out.where("NOT rejected")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    key = ["doc_id", "text", "lang"]
    assert sorted(map(repr, out.select(key).collect())) == sorted(map(repr, table.select(key).collect()))


def test_sampled_rows_are_read_in_chunks():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    lists = [np.sort(rng.choice(language.DIMENSIONS, size, False)) for size in (3, 0, 5, 2, 7)]
    table = pa.table(
        {
            "key": pa.array([5, 4, 3, 2, 1]), "whole": pa.array([True] * 5),
            "cells": pa.array(lists, pa.list_(pa.int16())),
            "counts": pa.array([np.arange(1, len(x) + 1) for x in lists], pa.list_(pa.int32())),
        }
    )
    weights = np.ones(language.DIMENSIONS, np.float32)
    chunked = pa.concat_tables([table.slice(0, 2), table.slice(2)])
    vectors, sizes = language._Sparse(chunked, weights).dense(np.array([4, 1, 0, 3]))
    for row, at in enumerate((4, 1, 0, 3)):
        expected = np.zeros(language.DIMENSIONS)
        expected[lists[at]] = np.log1p(np.arange(1, len(lists[at]) + 1))
        expected /= max(np.linalg.norm(expected), 1e-12)
        assert np.allclose(vectors[row], expected, atol=1e-6)
    assert sizes.tolist() == [2, 0, 1, 1]
