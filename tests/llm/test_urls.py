import math
import random
from collections import Counter

from fixtures import empty, frame

from paperlake.llm import urls

COLUMNS = "page_id long, url string"


def host_and_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((rest.index(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:end]


def rule(host, path):
    fits = [
        r for r in urls.RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.name), default=None)


ODD = [
    None, "", "nohost", "HTTP://A.Example.ORG/es/x?y#z", "x://Example.ORG#z", "x://a.com/de/1/://q",
    "x://org/", "x://borg/", "x://b.org", "x://É.org/É", "x://example.org/en/12", "x://?a/b", "://",
    "x://a.com/fr/", "x://com/de/", "x://a.net/\nq", "x://a.org\n/x",
]


def pages(count=300):
    rng = random.Random(2)
    rows = []
    for i in range(count):
        top, lang = rng.choice(["com", "net", "org"]), rng.choice(["en", "fr", "de", "es"])
        rows.append((i, f"https://h{rng.randrange(20)}.example.{top}/{lang}/{rng.randrange(300)}?p=1"))
    return rows + [(1000 + i, url) for i, url in enumerate(ODD)]


def test_rules(spark):
    got = {r.page_id: r for r in urls.judge(frame(spark, pages(), COLUMNS)).collect()}
    assert len(got) == len(pages())
    for page_id, url in pages():
        host, path = host_and_path(url)
        fit = rule(host, path)
        assert (got[page_id].host, got[page_id].path) == (host, path)
        assert got[page_id].rule == (fit.name if fit else None)
        assert got[page_id].verdict in ("allow", "block")
        if fit:
            assert got[page_id].verdict == fit.verdict


def test_model_tells_the_kinds_apart(spark):
    rng = random.Random(3)
    rows = [(i, f"x://site{rng.randrange(99)}.org/news/{rng.randrange(999)}") for i in range(300)]
    rows += [(1000 + i, f"x://win{rng.randrange(99)}.com/de/casino-pills-{rng.randrange(999)}") for i in range(300)]
    rows += [(2000 + i, f"x://win{i}.net/de/casino-pills-{i}") for i in range(20)]
    rows += [(3000 + i, f"x://site{i}.net/news/{i}") for i in range(20)]
    got = {r.page_id: r.verdict for r in urls.judge(frame(spark, rows, COLUMNS)).collect()}
    assert all(got[2000 + i] == "block" and got[3000 + i] == "allow" for i in range(20))


def brute_score(url, counted):
    """Accepted less rejected, by exact counts of byte strings, character by character."""
    data, total = url.encode(), 0.0
    for sign, own in ((1, counted["allow"]), (-1, counted["block"])):
        for i in range(len(data)):
            chance = 1 / 256
            for order in range(1, min(urls.ORDER, i + 1) + 1):
                gram, context = data[i - order + 1 : i + 1], data[i - order + 1 : i]
                seen = sum(own[context + bytes([c])] for c in range(256))
                chance = (own[gram] + urls.SMOOTHING * chance) / (seen + urls.SMOOTHING)
            total += sign * math.log(chance)
    return total / max(len(data), 1)


def test_counts_and_scores_are_exact(spark, monkeypatch):
    judged = [(u, "allow" if "org" in u else "block") for u in
              [f"x://a{i % 7}.org/é{i}" for i in range(40)] + [f"x://b{i}.com/de/" for i in range(30)]]
    counted = {"allow": Counter(), "block": Counter()}
    for url, verdict in judged:
        data = url.encode()
        for order in range(1, urls.ORDER + 1):
            counted[verdict].update(data[i : i + order] for i in range(len(data) - order + 1))
    table = spark.createDataFrame([*judged, (None, "allow")], "url string, verdict string")
    counts = urls.count_grams(table.repartition(3))
    monkeypatch.setattr(urls, "BLOCK_ROWS", 5)
    asked = ["x://a1.org/", "x://b.com/de/é", "", None, "q", "x://a1.org/" * 30, "x://a1.org/"]
    rows = spark.createDataFrame([(u, i) for i, u in enumerate(asked)], "url string, i int")
    got = {r.i: r.score for r in urls.scored(rows.coalesce(1), counts).collect()}
    assert len(got) == len(asked)
    for i, url in enumerate(asked):
        assert math.isclose(got[i], brute_score(url or "", counted), abs_tol=1e-9)


def test_verdicts_hold_as_the_corpus_grows(spark):
    # 100,000 judged URLs with slugs of their own class; those left to the model have new slugs.
    letters = {"org": "abcdefghijklm", "de": "nopqrstuvwxyz"}

    def slug(rng, kind):
        return "".join(rng.choice(letters[kind]) for _ in range(12))

    rng, rows = random.Random(4), []
    for i in range(100_000):
        kind = ("org", "de")[i % 2]
        rows.append((i, f"x://s.org/{slug(rng, kind)}" if i % 2 == 0 else f"x://s.com/de/{slug(rng, kind)}"))
    for i in range(2000):
        rows.append((200_000 + i, f"x://s.net/{slug(rng, ('org', 'de')[i % 2])}"))
    table = spark.createDataFrame(rows, COLUMNS).repartition(4)
    got = {r.page_id: r.verdict for r in urls.judge(table).where("page_id >= 200000").collect()}
    right = sum(got[200_000 + i] == ("allow", "block")[i % 2] for i in range(2000))
    assert right >= 0.95 * 2000


def test_one_class_or_no_rows(spark):
    rows = [(1, "x://a.org/"), (2, "x://a.net/"), (2, "x://a.net/"), (None, None)]
    assert {r.verdict for r in urls.judge(frame(spark, rows, COLUMNS)).collect()} == {"allow"}
    assert urls.judge(empty(spark, COLUMNS)).count() == 0
