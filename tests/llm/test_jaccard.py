import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, edited, empty, frame, sentence, words

from paperlake.llm import jaccard, lookup, sketches


def shingles(text, size):
    found = words(text, lower=True)
    if not found:
        return frozenset()
    if len(found) < size:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def brute(rows, size, percent):
    sets = {doc_id: shingles(text, size) for doc_id, text in rows}
    parent = {doc_id: doc_id for doc_id in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = Counter()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                count[a] += 1
                count[b] += 1
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: (len(s), find(d), count[d]) for d, s in sets.items()}


def result(table):
    return {
        r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in table.collect()
    }


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_links_match_brute_force(spark, size, percent):
    rows = documents()
    assert result(jaccard.links(frame(spark, rows), size, percent)) == brute(rows, size, percent)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_FEATURES", 1500)
    rng = random.Random(5)
    base = sentence(rng, 90)
    rows = [(i, edited(rng, base, rng.randrange(0, 6))) for i in range(90)]
    assert result(jaccard.links(frame(spark, rows), 3, 90)) == brute(rows, 3, 90)


def test_common_features_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_COPIES", 0)
    monkeypatch.setattr(jaccard, "COUNTED", 500)
    rng = random.Random(8)
    line = sentence(rng, 14)
    rows = [(i, f"{sentence(rng, rng.randrange(2, 40))} {line}") for i in range(60)]
    rows += [(100 + i, f"{line} {line}") for i in range(5)] + [(200, line)]
    rows += [(300 + i, edited(rng, rows[1][1], 1)) for i in range(5)]
    common = jaccard._common(
        frame(spark, rows).select("doc_id", "text").coalesce(1).mapInArrow(
            jaccard._prints(5), "doc_id long, n_shingles long, high long, low long"
        )
    )
    assert len(common) == 10
    assert result(jaccard.links(frame(spark, rows))) == brute(rows, 5, 80)


def test_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None), (4, " ")]
    got = sorted(
        (r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.links(frame(spark, rows)).collect()
    )
    assert got == [(0, 1, None), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]
    assert jaccard.links(empty(spark)).count() == 0


def test_repeated_ids_are_one_node(spark):
    a, b, c, d = (sentence(random.Random(i), 30) for i in range(4))
    rows = [(2, a), (3, b), (5, a), (5, b), (6, c), (7, d), (7, d), (7, c), (8, d), (9, None), (9, c)]
    got = {(r.doc_id, r.component_id) for r in jaccard.links(frame(spark, rows)).collect()}
    assert got == {(2, 2), (3, 2), (5, 2), (6, 6), (7, 6), (8, 6), (9, 9), (9, 6)}


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_dropped_ids_by_either_join(spark, monkeypatch, most):
    monkeypatch.setattr(lookup, "MOST_IDS", most)
    table = frame(spark, [(1, "a"), (2, "b"), (2, "c"), (None, "d")])
    kept = lookup.without(table, spark.createDataFrame([(2,), (2,), (None,)], "doc_id long"))
    assert kept.columns == table.columns
    assert sorted(r.text for r in kept.collect()) == ["a", "d"]


def test_keep_one(spark):
    rows = documents()
    kept = jaccard.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    expected = {d for d, (_, component, _) in brute(rows, 5, 80).items() if d == component}
    assert {r.doc_id for r in kept.collect()} == expected


@pytest.mark.parametrize("percent", [80, 90, 95])
@pytest.mark.parametrize("size", [1, 2, 5, 9, 10, 14, 23, 60, 300])
def test_similar_sets_share_a_signature(size, percent):
    rng = np.random.default_rng(size * percent)
    for _ in range(40):
        left = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        added, dropped = 0, 0
        while True:
            a, d = added + rng.integers(0, 2), dropped + rng.integers(0, 2)
            if 100 * (size - d) < percent * (size + a) or (a, d) == (added, dropped):
                break
            added, dropped = a, d
        right = np.unique(
            np.concatenate([left[dropped:], rng.integers(0, 2**63, added, dtype=np.uint64)])
        )
        first, second = jaccard.signatures([left, right], percent)
        assert len(np.intersect1d(first, second)), (size, added, dropped)


def test_unlike_sets_share_none():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 40, dtype=np.uint64)) for _ in range(300)]
    seen = defaultdict(set)
    for i, found in enumerate(jaccard.signatures(sets, 80)):
        for signature in found.tolist():
            seen[signature].add(i)
    assert max(map(len, seen.values())) == 1


def near(rng, features, share):
    """A copy of a set in which a share of the features is replaced."""
    changed = features.copy()
    count = int(len(changed) * share)
    changed[:count] = rng.integers(0, 2**63, count, dtype=np.uint64)
    return np.unique(changed)


@pytest.mark.parametrize("percent", [80, 90])
def test_sketches_part_no_similar_sets(percent):
    rng = np.random.default_rng(7)
    sets = []
    for size in [1, 3, 20, 60, 64, 70, 130, 600, 5000]:
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        sets += [near(rng, base, share) for share in (0, 0, 0.03, 0.06, 0.1, 0.2, 0.5, 1)]
        sets.append(np.unique(base[: max(1, size * 85 // 100)]))
    sizes, found = [len(s) for s in sets], sketches.sketches(sets).to_pylist()
    few, many = (sorted(map(sorted, f(sizes, found, percent))) for f in (sketches._few, sketches._many))
    assert few == many
    part = {i: number for number, own in enumerate(few) for i in own}
    assert sorted(part) == list(range(len(sets))) and len(few) > 18
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert part[i] == part[j]


def passages(rng, count):
    """Texts of which each shares some words with the next one, and the last two are near copies."""
    own = [sentence(rng, 20) for _ in range(count)]
    rows = [(i, f"{own[i]} {own[i + 1]}") for i in range(count - 1)]
    return [*rows, (count, rows[-1][1] + " end")]


@pytest.mark.parametrize("most", [10_000, 1])
def test_shared_passages_do_not_join_clusters(spark, monkeypatch, most):
    seen = []

    def verify(texts, classes, clusters, *more):
        seen.append(clusters.count())
        return original(texts, classes, clusters, *more)

    original = jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", verify)
    monkeypatch.setattr(jaccard, "MOST_MEMBERS", most)
    rows = passages(random.Random(11), 60)
    assert result(jaccard.links(frame(spark, rows))) == brute(rows, 5, 80)
    assert seen[0] == 2 if most > 1 else seen[0] >= 2


def test_few_ids_of_classes_are_sent_instead_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_COPIES", 3)
    rng = random.Random(3)
    a, b = sentence(rng, 30), sentence(rng, 30)
    rows = [(i, (a, b)[i % 2]) for i in range(20)]
    assert result(jaccard.links(frame(spark, rows))) == brute(rows, 5, 80)


def test_ids_of_several_texts_are_compared_with_all(spark):
    rng = random.Random(4)
    a, b = sentence(rng, 30), sentence(rng, 40)
    rows = [(2, a), (2, b), (3, a + " x"), (5, b + " y"), (7, sentence(rng, 30))]
    found = {r.doc_id: r.component_id for r in jaccard.links(frame(spark, rows)).collect()}
    assert found == {2: 2, 3: 2, 5: 2, 7: 7}
