import math
import random
import re
from collections import Counter

import pytest
from fixtures import LOWER, documents, empty, frame

from paperlake.llm import licenses

MIT = licenses.TEMPLATES[0][2]
ODD = [
    (3000, "Cc...BY, mit licenSe x apache  license gnu General PUBLIC-license cc by"),
    (3001, f"# {MIT.capitalize().replace(' of ', ', of ')}!"),
    (3002, "éMIT license MIT licenses mitlicense acc by cc byx"),
    (3002, "éMIT license MIT licenses mitlicense acc by cc byx"),
    (None, "mit license"),
    (3003, "Licensed under CC BY-NC 4.0."),
    (3004, "_cc_by_ permission granted hereby is"),
    (3005, "permission is hereby granted free of charge"),
]


def brute(text):
    found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    hits = []
    for phrase, label in licenses.BASE.items():
        parts = phrase.split()
        hits += [(i, label) for i in range(len(found)) if found[i : i + len(parts)] == parts]
    places = [i for i, _ in hits]
    labels = ",".join(sorted({label for _, label in hits}))
    return len(found), len(hits), min(places, default=None), max(places, default=None), labels


def test_base_matches_brute_force(spark):
    rows = documents() + ODD
    got = licenses.scan(frame(spark, rows)).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(str((r.doc_id, *(r[n] for n in names))) for r in got) == sorted(
        str((doc_id, *brute(text))) for doc_id, text in rows
    )
    for r in got:
        assert 0 <= r.score <= 1
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute_notices(rows):
    """By row: labels of the notices found at any place, those with their key phrase, the share."""
    texts = [split(text) for _, text in rows]
    held = Counter(word for words in texts for word in set(words))
    out = []
    for words in texts:
        own, keyed, best = set(), set(), 0.0
        for label, key, notice in licenses.NOTICES:
            weight = [math.log((2 + len(rows)) / (1 + held[word])) for word in notice]
            first = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
            inside = range(first, first + len(key))
            places = {}
            for place, word in enumerate(words):
                for at, other in enumerate(notice):
                    if word == other:
                        places.setdefault(place - at, set()).add(at)
            for there in places.values():
                share = sum(weight[at] for at in there) / sum(weight)
                if share >= licenses.LEAST - 1e-9 and there - set(inside):
                    own.add(label)
                    best = max(best, share)
                    keyed |= {label} if there >= set(inside) else set()
        out.append((own, keyed, best))
    return out


def agrees(spark, rows):
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for (doc_id, text), (own, keyed, best) in zip(rows, brute_notices(rows), strict=True):
        base = set(brute(text)[4].split(",")) - {""}
        r = got[doc_id]
        assert set(r.candidates.split(",")) - {""} == own, doc_id
        assert set(r.labels.split(",")) - {""} == base | keyed, doc_id
        assert r.score == pytest.approx(max(best, licenses.NAMED if base else 0)), doc_id
    return got


def damaged(rng, words):
    """The words with some dropped, exchanged or put in, or a part of them."""
    out = list(words)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = rng.choice([[], ["w1"], ["the"], ["license"]])
        out = out or ["w2"]
    return out[rng.randrange(len(out)) // 2 :] if rng.random() < 0.5 else out


def test_places_match_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, text) for i, (_, text) in enumerate(documents())]
    for n, (_, _, words) in enumerate(licenses.NOTICES * 6):
        around = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(20))]
        extra = rng.choices(sorted(licenses._VOCABULARY), k=rng.randrange(40))
        text = [*around, *damaged(rng, words), *extra, *around]
        rows.append((2000 + n, rng.choice([" ", ", ", "\n# "]).join(text)))
    scattered = max((words for _, _, words in licenses.NOTICES), key=len) * 2
    for n in range(20):
        rng.shuffle(scattered)
        rows.append((4000 + n, " ".join(scattered)))
    got = agrees(spark, rows)
    found = [got[2000 + n].candidates != "" for n in range(6 * len(licenses.NOTICES))]
    assert sum(found) > len(found) / 2
    # All words and many key words stand in these, but at no common place.
    assert not any(got[4000 + n].candidates for n in range(20))


def test_places_match_brute_force_on_the_test_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = agrees(spark, [(r.doc_id, r.text) for r in table.collect()])
    assert any(r.candidates for r in got.values())


def test_notices_need_their_place_and_key(spark):
    rows = [(i, f"w{i} w{i + 1} the of and is to in for with this") for i in range(60)] + ODD[:3] + ODD[4:]
    rows += [(3100, MIT.replace("hereby", "now")), (3101, "redistribution and use in source and binary forms")]
    rows += [(3102, " ".join(reversed(MIT.split())) + ". permission is hereby granted free of charge")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[3001].labels == "mit" and got[3001].score == pytest.approx(1)
    assert got[3003].labels == "cc-by,cc-by-nc"
    assert got[3004].labels == "cc-by"
    assert got[3002].labels == ""
    # A damaged key phrase leaves a candidate; a bare key phrase is none.
    assert got[3100].candidates == "mit" and got[3100].labels == "" and got[3100].score > 0.8
    for bare in (3005, 3101, 3102):
        assert got[bare].labels == got[bare].candidates == "" and got[bare].score == 0


def test_key_phrases_stand_in_their_notices():
    for _, key, words in licenses.NOTICES:
        assert words[licenses._key_at(key, words) :][: len(key)] == key


def test_a_very_long_text(spark):
    notices = [" ".join(words) for _, _, words in licenses.NOTICES]
    long = "the license and this software " * 20_000
    rows = [(1, long + notices[0] + " " + long), (2, long), (3, "w1")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1].candidates == "mit" and got[2].candidates == got[3].candidates == ""


def test_notices_of_many_documents_are_found(spark):
    notices = {name: text for name, _, text in licenses.TEMPLATES[:12]}
    rows = [(i, f"w{i} w{i + 1} " * 5) for i in range(60)]
    rows += [(100 + i, f"w{i} {notices['cc-by-nc']}. w{i}") for i in range(30)]
    rows += [(200 + i, f"w{i} {notices['bsd']}. w{i}") for i in range(30)]
    rows += [(300, f"{notices['isc']}. w1 {notices['bsd']}"), (301, notices["unlicense"])]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert {got[100 + i].labels for i in range(30)} == {"cc-by,cc-by-nc"}
    assert {got[200 + i].labels for i in range(30)} == {"bsd"}
    assert all(got[200 + i].score == pytest.approx(1) for i in range(30))
    assert got[300].labels == "bsd,isc" and got[301].labels == "unlicense"
    assert not any(got[i].labels for i in range(60))


def test_each_notice_has_its_own_lookups(spark):
    texts = [text for _, _, text in licenses.TEMPLATES]
    rows = [(1, "\n\n".join(texts))] + [(2 + i, f"w{i}") for i in range(40)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    own = {name for name, _, _ in licenses.TEMPLATES}
    assert own <= set(got[1].labels.split(","))


def test_weights_count_all_documents(spark):
    rows = [(i, "the license" if i % 2 else "the charge") for i in range(10)] + [(11, None)]
    weights = licenses.weights(licenses._seen(frame(spark, rows)))
    assert weights["the"] < weights["license"] == weights["charge"] < weights["mozilla"]


def test_empty_table_and_plan(spark):
    assert licenses.scan(empty(spark)).count() == 0
    plan = licenses.scan(frame(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
