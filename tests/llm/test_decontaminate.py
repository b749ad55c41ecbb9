import random

from fixtures import documents, empty, frame, sentence

from paperlake.llm import decontaminate

ITEMS = "item_id long, text string, doc_id long"


def items(spark, rows):
    return spark.createDataFrame([(*row, 5) for row in rows], ITEMS)


def found(spark, rows, benchmark):
    table = decontaminate.leaks(frame(spark, rows), items(spark, benchmark))
    return {(r.doc_id, r.item_id): r for r in table.collect()}


def brute(rows, benchmark, enough=6):
    """Exact copies of enough windows, for texts of plain lower-case words; whole short items."""
    out = set()
    for doc_id, text in rows:
        doc = (text or "").split()
        for item_id, item in benchmark:
            words = item.split()
            if 3 <= len(words) < 8:
                if any(doc[i : i + len(words)] == words for i in range(len(doc))):
                    out.add((doc_id, item_id))
                continue
            hits = {}
            for j in range(len(words) - 7):
                for i in range(len(doc) - 7):
                    if doc[i : i + 8] == words[j : j + 8]:
                        hits.setdefault(i - j, set()).add(j)
            if any(len(h) >= min(enough, len(words) - 7) for h in hits.values()):
                out.add((doc_id, item_id))
    return out


def test_copied_passages_match_brute_force(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    def text(n):
        return " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    benchmark = [(i, text(n)) for i, n in enumerate([8, 9, 12, 13, 20, 40, 2, 3, 4, 5, 6, 7])]
    rows = [(i, text(40)) for i in range(20)]
    for i, (_, item) in enumerate(benchmark):
        words = item.split()
        rows.append((100 + i, f"{text(5)} {item} {text(5)}"))
        rows.append((200 + i, f"{text(5)} {' '.join(words[2:])} {text(5)}"))
        rows.append((300 + i, f"{text(5)} {' '.join(words[: 13])}"))
        rows.append((400 + i, f"{' '.join(words[: 10])} {text(20)}"))
    assert set(found(spark, rows, benchmark)) == brute(rows, benchmark)


QUESTION = (
    "Now Ann buys 5 apples and 9 pears at the market for his friend and then Bob eats 5 of the "
    "apples every single day"
)


def test_reparameterised_questions_need_consistent_slots(spark):
    changed = QUESTION.replace("Ann", "Tom").replace("5", "30").replace("9", "4").replace("Bob", "Sue")
    rows = [
        (1, "Please. So " + changed[4:]),
        (2, "So " + changed[4:].replace("Sue", "Tom")),
        (3, "So " + changed[4:].replace("30 of", "31 of")),
        (4, QUESTION.upper()),
        (5, QUESTION.replace(" ", "%%% ")),
        (None, QUESTION),
        (7, None),
        (8, QUESTION + ". " + QUESTION),
    ]
    got = found(spark, rows, [(7, QUESTION), (8, None), (9, "")])
    assert {d for d, _ in got} >= {1, 2, 5, None, 8}
    assert not {3, 7} & {d for d, _ in got}
    assert got[(1, 7)].n_slots >= 3


SLOTTED = "Ann Lee ran 5 km in 20 minutes on Monday"
NUMBERS = "The 1 2 3 4 5 6 7 8 of 9 10 11 12 13 14 15 16 in 17 18 19 20"
OPENING = "Under old bridges grey herons wait for small fish"


def test_short_and_slot_heavy_items_are_found(spark):
    rows = [
        (1, f"some words before. {SLOTTED}. and after"),
        (2, f"some words before {SLOTTED} and after"),
        (3, "before. Ann Cox ran 7 km in 31 minutes on Friday"),
        (4, "before. Ann Cox ran 7 km in 31 minutes by Friday"),
        (5, f"so it is that {OPENING} all day"),
        (6, f"before {NUMBERS} after"),
        (7, " ".join(str(i) for i in range(60))),
        (8, "before. Ann Cox ran 7 km in 7 minutes on Friday"),
        (9, "so it is that Under old bridges grey herons wait for small birds"),
    ]
    got = found(spark, rows, [(1, SLOTTED), (2, OPENING), (3, NUMBERS)])
    assert set(got) == {(1, 1), (2, 1), (3, 1), (8, 1), (5, 2), (6, 3)}
    assert got[(3, 1)].n_slots > 0 and got[(1, 1)].share == 1


def test_items_shorter_than_a_window(spark):
    novel = "Who wrote the novel War and Peace"
    rows = [
        (1, f"It asks: {novel}? Nobody knew."),
        (2, f"so {novel.upper()}"),
        (3, "Who wrote the novel War of Peace"),
        (4, "who wrote the novel war and"),
        (5, "blue old door"),
        (6, "blue old"),
        (7, None),
    ]
    benchmark = [(1, novel), (2, "Blue old door."), (3, "blue old"), (4, "knew"), (5, None)]
    got = found(spark, rows, benchmark)
    assert set(got) == {(1, 1), (2, 1), (5, 2)}
    assert got[(1, 1)].n_windows == 1 and got[(1, 1)].share == 1 and got[(1, 1)].n_slots == 0


def reset(rng, number):
    """An item, the same question with other values (equal ones now and then), and an unlike one."""
    def text(names, numbers, words):
        return (
            f"In the {words[0]} {names[0]} buys {numbers[0]} apples and {numbers[1]} pears from "
            f"{names[1]} and later {words[1]} gives {numbers[2]} of them to a good old {words[2]}"
        )

    def values():
        names = rng.sample(["Ann", "Tom", "Sue", "Bob", "Eve", "Max", "Ida"], 2)
        return names, [rng.randrange(2, 9) for _ in range(3)]

    words = [f"word{number}{c}" for c in "abc"]
    names, numbers = values()
    while len(set(numbers)) < 3:
        names, numbers = values()
    return text(names, numbers, words), text(*values(), words), text(*values(), ["x", "y", "z"])


def test_recall_of_reset_questions(spark):
    rng = random.Random(6)
    cases = [reset(rng, i) for i in range(60)]
    rows = [(i, f"some text. {c[1]}. and more") for i, c in enumerate(cases)]
    rows += [(1000 + i, c[2]) for i, c in enumerate(cases)]
    got = set(found(spark, rows, [(i, c[0]) for i, c in enumerate(cases)]))
    assert sum((i, i) in got for i in range(60)) >= 54
    assert not [pair for pair in got if pair[0] >= 1000 or pair[0] != pair[1]]


def test_verbatim_windows_count_whatever_other_slots_say(spark):
    copied = QUESTION.replace("5 of the", "6 of the") + " and 6 more"
    assert set(found(spark, [(1, "It says. " + QUESTION + " or " + copied)], [(7, QUESTION)]))
    long = "every copied word of this plain old text is here and then some others follow it "
    item = long + "so 5 go home while 5 stay here"
    rows = [(1, long + "so 8 go home while 9 stay here")]
    assert set(found(spark, rows, [(7, item)])) == {(1, 7)}


def test_without_sifting_the_result_is_the_same(spark, monkeypatch):
    rows = [(1, QUESTION), (2, sentence(random.Random(1), 50))] + documents()
    first = set(found(spark, rows, [(7, QUESTION)]))
    monkeypatch.setattr(decontaminate, "MOST_KEYS", 1)
    assert set(found(spark, rows, [(7, QUESTION)])) == first == {(1, 7)}


def test_clean(spark):
    rows = [(1, QUESTION), (2, "other words"), (None, "no id"), (3, None), (2, "other words")]
    table = frame(spark, rows)
    kept = decontaminate.clean(table, items(spark, [(7, QUESTION)]))
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "3", "None"]
    assert decontaminate.clean(empty(spark), items(spark, [(7, QUESTION)])).count() == 0
    assert decontaminate.clean(table, items(spark, [])).count() == 5
