"""Small documents with copies, near copies and odd rows."""

import random
import re
import string

SPACE_RUN = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text, lower=False):
    text = text or ""
    return re.findall(SPACE_RUN, text.translate(LOWER) if lower else text)


def sentence(rng, count, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(count))


def edited(rng, text, edits):
    out = text.split(" ")
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def documents(seed=1):
    """(doc_id, text) rows: copies, near copies with 1 to 12 edits, shared passages, odd ones."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(1, 160)) for _ in range(25)]
    texts = list(base)
    texts += [base[i] for i in (3, 3, 4, 5)]
    family = sentence(rng, 120)
    texts += [edited(rng, family, rng.randrange(1, 12)) for _ in range(60)]
    texts += [family.upper().replace(" ", "\n"), family + "  "]
    passage = sentence(rng, 70)
    texts += [f"{sentence(rng, rng.randrange(0, 60))} {passage} {sentence(rng, 30)}" for _ in range(8)]
    texts += [passage, passage + " " + passage, sentence(rng, 49), ""]
    texts += ["one", "ONE", "one two", "one two three", " \t\n", "é x \x0b y"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    return [*rows, (1000, None), (1001, "")]


def frame(spark, rows, columns="doc_id long, text string"):
    """The rows with further columns whose names clash with those of the operators."""
    extra = "n_words string, label string, component_id string, digest string, spans string"
    odd = [(*row, None, "x", "7", None, "?") for row in rows]
    return spark.createDataFrame(odd, f"{columns}, {extra}").repartition(3)


def empty(spark, columns="doc_id long, text string"):
    return spark.createDataFrame([], columns)
