"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words inside a sentence) and units (after a
number) are typed placeholders, other words are lower-cased, outer punctuation is dropped. Windows
of `WINDOW` template tokens of documents and benchmark items are joined by hash. A document leaks
an item when enough windows agree on one alignment and the slots are consistent: each number, name
or unit of the item stands for one value of the document (two may stand for the same one).
Windows of the lower-cased words themselves are joined besides, and enough of them on one alignment
are a leak whatever the slots. An item with fewer than enough windows of `LITERALS` plain words,
short or full of slots, is compared by the template of the whole item: all its windows must agree.
An item shorter than a window is one window of its own length, compared by its words.

Defined cases: null and empty texts have no windows; items of less than `SHORTEST` words cannot be
told from chance and are not searched; items with fewer than `LITERALS` plain words are found by their
own words only; an item's first word, if capitalised, may be a name of the document;
rows that repeat a `doc_id` count as one document; rows without `doc_id` are reported with a null
id, and `clean` keeps them; repeated windows of one text count once per alignment; further columns
are ignored by `leaks`; empty tables give no rows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, lookup
from .held import trimmed

WINDOW = 8
LITERALS = 4
ENOUGH = 6
"""Windows on one alignment that make a leak (13 tokens in a row); or all of a shorter item's."""
SHORTEST = 3
"""Words of the shortest items that are searched."""
MOST_KEYS = 1 << 20
"""Benchmark windows that are sent to all tasks (8 MB); more are joined by shuffling."""
# Unit words.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce "
    "ounces pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min "
    "minute minutes h hr hour hours day days week weeks month months year years percent dollar "
    "dollars euro euros cent cents degree degrees mph kph watt watts volt volts"
).split()

_INNER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LOWER = np.array([b >= 128 or 0x61 <= b <= 0x7A for b in range(256)])
_STOP = np.array([chr(b) in ".!?" for b in range(256)])
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1111, 0x2222, 0x3333))
_RAW = np.uint64(0x4444)
_PLAIN, _SLOTTED, _WORDS = range(3)


def _unit_hashes():
    hashes, _ = hashing.words(pa.array(UNITS))
    return np.unique(hashes)


_UNIT_HASHES = _unit_hashes()


def templates(column):
    """(template tokens, their values, whether they are slots, whether they are capitalised words,
    row offsets) of a text column."""
    data, offsets = hashing.text_bytes(column)
    lowered, low_offsets = hashing.text_bytes(
        pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    )
    starts, ends, rows = hashing.word_spans(data, offsets)
    low_starts, low_ends, _ = hashing.word_spans(lowered, low_offsets)
    first, _ = _stripped(data, starts, ends)
    low_first, low_last = _stripped(lowered, low_starts, low_ends)
    kept = low_last > low_first
    values = hashing.hash_spans(lowered, low_first[kept], low_last[kept])
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    opening = np.ones(len(starts), bool)
    opening[1:] = _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    opening[rows[:-1][rows[:-1] < len(starts)]] = True
    first, opening = first[kept], opening[kept]
    padded = np.append(data, [0x20, 0x20])
    head, second = padded[first], padded[first + 1]
    # Latin capitals of two bytes: À to Þ.
    latin = (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    third = padded[np.minimum(first + 2, len(padded) - 1)]
    capital = (_UPPER[head] & _LOWER[second]) | (latin & _LOWER[third])
    number = _DIGIT[head]
    name = capital & ~opening
    after = np.zeros(len(values), bool)
    after[1:] = number[:-1]
    unit = after & np.isin(values, _UNIT_HASHES) & ~number
    tokens = np.where(number, _NUMBER, np.where(name, _NAME, np.where(unit, _UNIT, values)))
    rows = np.concatenate([[0], np.cumsum(kept)])[rows]
    return tokens, values, number | name | unit, capital, rows


def _stripped(data, starts, ends):
    """The spans without bytes at either end that are no letters or digits."""
    inner = np.flatnonzero(_INNER[data])
    if not len(inner):
        return starts, starts
    at = np.searchsorted(inner, starts)
    first = inner[np.minimum(at, len(inner) - 1)]
    last = inner[np.maximum(np.searchsorted(inner, ends) - 1, 0)] + 1
    empty = (at == len(inner)) | (first >= ends)
    return np.where(empty, starts, first), np.where(empty, starts, last)


def _windows(keys=None, items=False, short=range(SHORTEST, WINDOW)):
    """Rows (id, text): the windows, with `keys` only those among them.

    A window's kind tells templates with enough plain words, other templates and the words
    themselves. Items have templates of the second kind only if they lack those of the first.
    Kinds beyond `_WORDS` are windows of as many words more, of the lengths `short`; items have
    one if that is their own length.
    """

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                yield of_part(batch.slice(begin, 256))

    def of_part(part):
        tokens, values, slots, capital, rows = templates(part.column(1))
        plain = np.concatenate([[0], np.cumsum(~slots)])
        window = hashing.shingles(tokens, WINDOW)
        count = len(window)
        row_of = np.repeat(np.arange(part.num_rows), np.diff(rows))
        row = row_of[:count]
        there = np.arange(count) + WINDOW <= rows[1:][row]
        enough = there & (plain[WINDOW:][:count] - plain[:count] >= LITERALS)
        comparable = np.bincount(row[enough], minlength=part.num_rows)
        total = np.maximum(np.diff(rows) - WINDOW + 1, 0)
        template = there
        if items:
            heavy = comparable < np.minimum(total, ENOUGH)
            heavy &= plain[rows[1:]] - plain[rows[:-1]] >= LITERALS
            template = enough | (there & heavy[row])
        at = np.flatnonzero(template)
        found = [(at, window[at], np.where(enough[at], _PLAIN, _SLOTTED), slots)]
        if items:
            # The first word is at no sentence's start where the document has words before it.
            starts = rows[:-1][(total > 0)]
            starts = starts[template[starts] & capital[starts] & ~slots[starts]]
            named, named_slots = tokens.copy(), slots.copy()
            named[starts], named_slots[starts] = _NAME, True
            again = hashing.shingles(named, WINDOW)
            found.append((starts, again[starts], np.where(enough[starts], _PLAIN, _SLOTTED), named_slots))
        at = np.flatnonzero(there)
        words = hashing.mix(hashing.shingles(values, WINDOW) + _RAW)
        found.append((at, words[at], np.full(len(at), _WORDS), None))
        for length in short:
            words = hashing.mix(hashing.shingles(values, length) + _RAW + np.uint64(length))
            owner = row_of[: len(words)]
            inside = np.arange(len(words)) + length <= rows[1:][owner]
            if items:
                inside &= np.diff(rows)[owner] == length
            at = np.flatnonzero(inside)
            found.append((at, words[at], np.full(len(at), _WORDS + length), None))
        if keys is not None:
            found = [_among(keys, *group) for group in found]
        lists = [
            values[i : i + WINDOW][slot[i : i + WINDOW]] if slot is not None else values[:0]
            for at, _, _, slot in found
            for i in at.tolist()
        ]
        at, window, kind = (np.concatenate([group[i] for group in found]) for i in range(3))
        owner = row_of[at]
        return pa.RecordBatch.from_arrays(
            [
                part.column(0).take(pa.array(owner)),
                pa.array(at - rows[owner], pa.int64()),
                pa.array(np.maximum(total, 1)[owner], pa.int64()),
                pa.array(comparable[owner], pa.int64()),
                pa.array(kind, pa.int32()),
                hashing.as_long(window),
                hashing.long_lists(lists),
            ],
            names=["id", "place", "windows", "comparable", "kind", "hash", "slots"],
        )

    return run


def _among(keys, at, window, kind, slots):
    near = np.minimum(np.searchsorted(keys, window), max(len(keys) - 1, 0))
    there = keys[near] == window if len(keys) else np.zeros(len(window), bool)
    return at[there], window[there], kind[there], slots


_SHAPE = (
    "id long, place long, windows long, comparable long, kind int, hash long, slots array<long>"
)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leak: doc_id, item_id, n_windows (compared on the best alignment), share (of
    the item's windows), n_slots (none if only the words agree).

    The documents are read once. If the benchmark has at most `MOST_KEYS` distinct windows they go
    to all tasks and sift the documents' windows before the join; the result is the same without.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(
        _windows(items=True), _SHAPE
    )
    keys = [row["hash"] for row in items.select("hash").distinct().limit(MOST_KEYS + 1).collect()]
    sifted = np.unique(np.array(keys, np.int64).view(np.uint64)) if len(keys) <= MOST_KEYS else None
    kinds = items.where(F.col("kind") > _WORDS).select("kind").distinct().collect()
    short = sorted(row["kind"] - _WORDS for row in kinds)
    texts = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        trimmed(_windows(sifted, short=short)), _SHAPE
    )
    found = texts.alias("d").join(items.alias("i"), F.col("d.hash") == F.col("i.hash"))
    aligned = (
        found.groupBy(
            F.col("d.id").alias("doc_id"),
            F.col("i.id").alias("item_id"),
            (F.col("d.place") - F.col("i.place")).alias("shift"),
        )
        .agg(
            *(
                F.collect_set(F.when(kind, F.col("i.place"))).alias(name)
                for kind, name in (
                    (F.col("i.kind") == _PLAIN, "plain"),
                    (F.col("i.kind") == _SLOTTED, "slotted"),
                    (F.col("i.kind") >= _WORDS, "words"),
                )
            ),
            F.max("i.windows").alias("windows"),
            F.max("i.comparable").alias("comparable"),
            F.collect_set(
                F.when(
                    F.size("d.slots") > 0, F.arrays_zip(F.col("i.slots").alias("item"), F.col("d.slots").alias("doc"))
                )
            ).alias("slots"),
        )
        .withColumn("slots", F.array_distinct(F.flatten("slots")))
    )
    number = F.size("slots")
    consistent = number == F.size(F.array_distinct(F.transform("slots", lambda s: s["item"])))
    enough = F.least(F.lit(ENOUGH), F.col("windows"))
    templated = F.array_union("plain", "slotted")
    alike = consistent & F.when(
        F.col("comparable") >= enough, F.size("plain") >= enough
    ).otherwise(F.size(templated) == F.col("windows"))
    compared = F.when(F.col("alike"), F.size(F.array_union(templated, "words"))).otherwise(F.size("words"))
    return (
        aligned.withColumn("alike", alike)
        .where(F.col("alike") | (F.size("words") >= enough))
        .withColumn("n_windows", compared.cast("long"))
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("n_windows").alias("n_windows"),
            F.max(F.col("n_windows") / F.col("windows")).alias("share"),
            F.max(F.when(F.col("alike"), number).otherwise(0)).cast("long").alias("n_slots"),
        )
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that leak a benchmark item."""
    return lookup.without(documents, leaks(documents, benchmark))
