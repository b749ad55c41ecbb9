import datetime
import random

import pytest
from pyspark.sql import functions as F

from paperlake import params
from paperlake.functions import ids, text
from paperlake.functions.vectors import checked_vector, cosine_similarity


def apply(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"n int, x {kind}")
    out = rows.select("n", expression(F.col("x")).alias("y")).orderBy("n")
    return [row.y for row in out.collect()]


def check(spark, cases, expression, kind="string"):
    inputs = [given for given, _ in cases]
    assert apply(spark, inputs, expression, kind) == [expected for _, expected in cases]


PREFIX = "oai:arXiv.org:"
SPACES = text.SPACES
LETTERS = "abMZéß7"


def made_ids(count=150, seed=11):
    """Random strings of the pieces that ids are made of, in any order."""
    rng = random.Random(seed)
    pieces = [PREFIX, "v", "v0", "v12", "/", ".", "0", "987", "x-y", " ", "\n", "é", "V3", "oai:"]
    return ["".join(rng.choices(pieces, k=rng.randrange(6))) for _ in range(count)]


def without_version(bare):
    """The text before a final `v` and digits, unless nothing stands before."""
    digits = len(bare) - len(bare.rstrip("0123456789"))
    head = bare[: len(bare) - digits]
    return head[:-1] if digits and head.endswith("v") and len(head) > 1 else bare


def test_normalize_id_drops_one_prefix_and_one_version(spark):
    given = made_ids() + [PREFIX * 2 + "q", PREFIX, "٣v٣"]
    expected = [without_version(g.removeprefix(PREFIX)) for g in given]
    assert apply(spark, [*given, None], ids.normalize_id) == [*expected, None]


def id_shaped(value):
    value = value.strip(SPACES)
    data = value.encode()
    if " " in value:
        return False
    return (len(data) >= 9 and data[4:5] == b".") or "/" in value


def test_id_shape_is_the_fifth_byte_or_a_slash(spark):
    rng = random.Random(12)
    # Around the boundaries: the dot at each place, of strings of each length.
    given = ["x" * dot + "." + "y" * (size - dot - 1) for size in range(7, 12) for dot in range(size)]
    given += ["ü" * n + "." + "k" * m for n in range(1, 5) for m in range(3, 8)]
    given += made_ids(seed=13) + ["", "/", " / ", "a /b"]
    given += [rng.choice(SPACES) + g + rng.choice(SPACES) for g in given[::3]]
    assert apply(spark, given, ids.looks_like_id) == [id_shaped(g) for g in given]


def cleaned(value):
    """A second implementation, character by character."""
    out, gap = [], False
    for char in value.strip(SPACES):
        if char in " \n\r\t":
            gap = True
            continue
        out.append(" " * gap + char)
        gap = False
    return "".join(out)


def test_clean_text(spark):
    rng = random.Random(14)
    given = ["".join(rng.choices(LETTERS + SPACES + "    \n\t", k=rng.randrange(25))) for _ in range(200)]
    given += [space * n + "w" + space * n for space in SPACES for n in (1, 2)]
    assert apply(spark, [*given, None], text.clean_text) == [*map(cleaned, given), None]


def test_parse_date_reads_what_it_should(spark):
    rng = random.Random(15)
    cases = []
    for _ in range(60):
        moment = datetime.datetime(1990, 1, 1) + datetime.timedelta(seconds=rng.randrange(10**9))
        cases.append((f"{moment:%Y-%m-%d}", moment.replace(hour=0, minute=0, second=0)))
        fraction = "".join(rng.choices("0123456789", k=rng.randrange(10)))
        zone = rng.choice(["Z", "+05:30", "-11:00"])
        written = f"{moment:%Y-%m-%dT%H:%M:%S}" + (rng.choice(".,") + fraction if fraction else "")
        micros = int((fraction + "000000")[:6])
        cases.append((written + zone, moment.replace(microsecond=micros)))
    check(spark, [*cases, (None, None)], text.parse_date)


def test_parse_date_takes_nothing_else(spark):
    good = ["1999-12-31", "1999-12-31T23:59:58Z", "1999-12-31T23:59:58.25-08:00"]
    broken = [g[:i] + g[i + 1 :] for g in good for i in range(len(g)) if g[:i] + g[i + 1 :] not in good]
    # Leaving out one digit of the fraction leaves a shorter fraction.
    broken = [b for b in broken if not b.startswith(good[2][:20]) or b[20:] not in ("2-08:00", "5-08:00")]
    broken += [" " + g for g in good] + [g + "\n" for g in good] + [g.replace("T", " ") for g in good[1:]]
    broken += ["1999-13-31", "1999-11-31", "1900-02-29", "1999-12-31T24:00:00Z", "1999-12-31T23:60:00Z"]
    assert apply(spark, broken, text.parse_date) == [None] * len(broken)


def test_harvest_set_repeats_what_stands_before_the_first_dot(spark):
    given = ["q-bio.NC", "stat", "one.two.three", ".x", "y.", ""]
    expected = [
        f"{g.split('.')[0]}:{g.split('.')[0]}:{g.split('.', 1)[1]}" if "." in g else g for g in given
    ]
    assert apply(spark, given, ids.harvest_set) == expected


def test_primary_category_is_the_first_of_the_list(spark):
    rng = random.Random(17)
    lists = [rng.sample(["q-bio.NC", "stat.ME", "math.CO", "eess.AS"], rng.randrange(1, 4)) for _ in range(20)]
    for joint, separator in ((",", ","), (" ,", ","), (" ", r"[,\s]+"), (", ", r"[,\s]+")):
        given = [f" {joint.join(names)}\n" for names in lists]
        found = apply(spark, given, lambda c, s=separator: ids.primary_category(c, s))
        assert found == [names[0] for names in lists]
    unknown = ["", "  ", ",x", None]
    assert apply(spark, unknown, ids.primary_category) == ["unknown"] * 4
    assert apply(spark, ["a b"], ids.primary_category) == ["a b"]


def test_paths_and_requests(spark):
    check(
        spark,
        [("2301.1", "/srv/cs/AI/2301.1.txt")],
        lambda c: ids.full_text_path("/srv", F.lit("cs.AI"), c),
    )
    check(spark, [("1", "arXiv:1"), ("arXiv:1", "arXiv:1")], ids.request_id)


def test_bodies(spark):
    check(
        spark,
        [(("a", "b"), "a\n\nTL;DR: b"), (("a", ""), "a"), (("a", None), "a"),
         ((None, "b"), "\n\nTL;DR: b"), ((None, None), "")],
        lambda c: text.full_text_body(c["abstract"], c["tldr"]),
        "struct<abstract:string,tldr:string>",
    )


def test_authors(spark):
    rng = random.Random(16)
    names = [None, "", " ", "Ada", "Bo  C.", "de la Ñ", "\u00a0Li"]
    lists = [
        [(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(5))] for _ in range(80)
    ]

    def written(authors):
        full = [f"{first or ''} {last or ''}".strip(SPACES) for first, last in authors]
        return ", ".join(name for name in full if name)

    kind = "array<struct<forenames:string,keyname:string>>"
    found = apply(spark, [*lists, None], text.format_authors, kind)
    assert found == [*map(written, lists), ""]


def test_shortened(spark):
    check(
        spark,
        [("x" * 30, "x" * 30), ("x" * 31, "x" * 27 + "..."), (None, "")],
        lambda c: text.shortened(c, 30),
    )


def test_positive_numbers_count_and_nothing_else():
    for n in range(-4, 5):
        assert params.positive(n, 9) == params.positive(str(n), 9) == (n if n > 0 else 9)
    assert [params.positive(x, 9) for x in (None, "", " ", "1.5", "x1", "1x")] == [9] * 6


def test_category_list():
    names = [*params.categories()]
    assert len(set(names)) == 6
    assert params.categories(" ,".join(names[::-1])) == names[::-1]


def test_cosine(spark):
    kind = "struct<a:array<float>,b:array<float>>"
    check(
        spark,
        [
            (([1.0, 0.0], [2.0, 0.0]), 1.0),
            (([1.0, 0.0], [0.0, 3.0]), 0.0),
            (([1.0, 0.0], [-1.0, 0.0]), -1.0),
            (([0.0, 0.0], [1.0, 0.0]), None),
            ((None, [1.0, 0.0]), None),
        ],
        lambda c: cosine_similarity(c["a"], c["b"]),
        kind,
    )


def test_checked_vector(spark):
    assert apply(spark, [[1.0, 2.0], None], lambda c: checked_vector(c, 2), "array<float>") == [
        [1.0, 2.0],
        None,
    ]
    with pytest.raises(Exception, match="expected 3 dimensions, got 2"):
        apply(spark, [[1.0, 2.0]], lambda c: checked_vector(c, 3), "array<float>")
