import re
from collections import Counter

import pytest
from fixtures import documents, empty, frame, words

from paperlake.llm import quality

ODD = [
    (3000, " \n\n a a a a a a a\n\nb c d e f b c d e f\nb c\x0bx\nb c x"),
    (3001, "x y z\n" * 9 + "# $ % & | < >"),
    (3001, "x y z\n" * 9 + "# $ % & | < >"),
    (None, "only a few words"),
]


def brute(text):
    found = words(text)
    lines = [line for line in (text or "").split("\n") if words(line)]
    runs = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    places = set()
    for i in range(len(found) - 4):
        if runs[tuple(found[i : i + 5])] > 1:
            places.update(range(i, i + 5))
    return (
        len(found),
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(places),
    )


def test_counts_match_brute_force(spark):
    rows = documents() + ODD
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality.judge(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in got) == sorted(
        (str(doc_id), *brute(text)) for doc_id, text in rows
    )
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed
        assert r.kept == (not failed and r.quality >= 0.5)
        assert 0 <= r.quality <= 1


def test_estimate_tells_bad_texts_by_agreeing_rules():
    names = ["a", "b", "c"]
    patterns = [((1, 1, 1), 900), ((-1, -1, 1), 90), ((1, 1, -1), 30), ((0, 1, 1), 50)]
    rates, share = quality.estimate(patterns, names)
    assert 0.85 < share < 0.95
    assert rates["a"][1] > 0.8 and rates["a"][0] < 0.05
    odds = {
        votes: sum(quality.evidence(rates[n], v) for n, v in zip(names, votes, strict=True))
        for votes, _ in patterns
    }
    assert odds[(-1, -1, 1)] < -3 < 0 < odds[(0, 1, 1)] < odds[(1, 1, 1)]
    assert quality.evidence(rates["a"], 0) == 0


def test_estimate_without_votes():
    rates, share = quality.estimate([], ["a"])
    assert rates["a"] == pytest.approx((0.02, 0.5)) and share == pytest.approx(0.9)


def test_empty_table_and_plan(spark):
    assert quality.judge(empty(spark)).count() == 0
    plan = quality.features(frame(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_junk_is_rejected_and_clean_text_kept(spark):
    clean = "The plain words of this text go on for a while. They end in sentences, as usual."
    tail = " End of it all here. And one more thing that is said at the end of the text."
    rows = [
        (i, " ".join(word + chr(97 + i % 26) for word in clean.split()) + tail) for i in range(60)
    ]
    junk = [(100 + i, " ".join(f"word{i}and{j}###" for j in range(40 + i))) for i in range(12)]
    got = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows + junk)).collect()}
    assert not any(got[doc_id] for doc_id, _ in junk)
    assert all(got[doc_id] for doc_id, _ in rows)
