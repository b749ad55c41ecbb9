import hashlib

import numpy as np
from fixtures import documents, empty, frame, words

from paperlake.llm import repeats


def brute(rows, window):
    first = {}
    for doc_id, text in rows:
        found = words(text)
        for i in range(len(found) - window + 1):
            key = tuple(found[i : i + window])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        found = words(text)
        gone = [False] * len(found)
        for i in range(len(found) - window + 1):
            owner = first.get(tuple(found[i : i + window]))
            if doc_id is not None and owner is not None and owner < doc_id:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(found, gone, strict=True) if not g)
        out.append((str(doc_id), len(found), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(table):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.digest) for r in table.collect())


def test_matches_brute_force(spark):
    rows = documents()
    rows += [(None, rows[3][1]), (2000, rows[5][1]), (2000, rows[7][1]), (2000, rows[7][1])]
    report, cleaned = repeats.remove(frame(spark, rows))
    assert result(report) == brute(rows, 50)
    texts = {r.doc_id: r.kept_text for r in cleaned.collect()}
    digests = {r.doc_id: r.digest for r in report.collect()}
    assert texts
    for doc_id, text in texts.items():
        assert hashlib.sha256(text.encode()).hexdigest() == digests[doc_id] or doc_id == 2000


def test_shorter_windows_hot_anchors_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "SHARD_WINDOWS", 20)
    rows = documents(7)
    report, _ = repeats.remove(frame(spark, rows), window=20, phrase=4)
    assert result(report) == brute(rows, 20)


def test_empty_table(spark):
    report, cleaned = repeats.remove(empty(spark))
    assert report.count() == 0 and cleaned.count() == 0


def test_anchors_are_the_last_least_of_each_span():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 9, 200).astype(np.uint64)
    for span in (1, 2, 5, 16, 41):
        places, owner = repeats.anchors(hashes, span)
        for i in range(len(hashes) - span + 1):
            part = hashes[i : i + span]
            assert places[owner[i]] == i + np.flatnonzero(part == part.min())[-1]
