"""Substring deduplication by repeated-phrase automata.

A window of `window` words is removed where its word sequence also starts in a document with a
smaller `doc_id`. Three steps find these windows without moving all of them:

1. Anchors. Each document's phrases of `PHRASE` words are winnowed: of the phrases inside each
   window the one with the least hash is an anchor, so equal windows have equal anchors at equal
   places. A window can recur only if its anchor occurs in two documents.
2. Confirmation. The windows of recurring anchors are grouped by their content, pre-aggregated:
   those found in two documents are the recurring passages, owned by their smallest document.
3. Automata. The passages are spelt as `window` / `PHRASE` phrases, each a short letter, and
   sharded by their anchor; each shard is compiled into an Aho-Corasick automaton, and all text
   around recurring anchors is streamed through the automaton of the anchor's shard, which
   locates every occurrence. Anchors that many documents hold are salted: their passages go to
   several tasks.

Equal texts are folded first: a copy of a smaller document loses all its windows.

Defined cases: null and empty texts have no words and keep nothing; a text shorter than a window
stays whole; windows that recur within one document only stay; rows that repeat a `doc_id` are
judged one by one against documents with smaller ids; rows without `doc_id` stay whole and remove
nothing; further columns are ignored; an empty table gives no rows.
"""

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.session import cut

from . import hashing

WINDOW = 50
PHRASE = 10
LETTER_BITS = 12
"""Bits of a phrase's letter in the automata; hits are verified by the 64-bit window hash."""
SHARD_WINDOWS = 10_000
"""Passages a shard's automaton holds on average."""
HOT = 5_000
"""Segments a shard reads on average, and occurrences of an anchor that one task reads; more are
spread over several tasks. A family of copies has few passages but many segments."""


def anchors(phrases: np.ndarray, span: int):
    """Places of the least of each `span` consecutive hashes (the last of equal ones), and for
    each start of a span the index of its place."""
    count = len(phrases) - span + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Running minima by doubling; equal hashes are told apart by place.
    place = np.arange(len(phrases))
    width = 1
    while width * 2 <= span:
        place = _later_least(phrases, place[:-width], place[width:])
        width *= 2
    if width < span:
        rest = span - width
        place = _later_least(phrases, place[:-rest], place[rest:])
    return np.unique(place[:count], return_inverse=True)


def _later_least(phrases, left, right):
    return np.where(phrases[right] <= phrases[left], right, left)


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _documents(batch):
    """(row, bytes, word starts, word ends, word hashes) of each row of a batch (.., text)."""
    for first in range(0, batch.num_rows, 256):
        part = batch.slice(first, 256)
        data, offsets = hashing.text_bytes(part.column(part.num_columns - 1))
        starts, ends, rows = hashing.word_spans(data, offsets)
        hashes = hashing.hash_spans(data, starts, ends)
        for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
            yield first + i, data, starts[a:b], ends[a:b], hashes[a:b]


def _joined(data, starts, ends) -> bytes:
    return b" ".join(
        data[a:b].tobytes() for a, b in _runs(data, starts.tolist(), ends.tolist())
    )


def _runs(data, starts, ends):
    """Byte ranges of words, those with one blank between them as one range."""
    begin = None
    for start, end in zip(starts, ends, strict=True):
        if begin is None:
            begin, stop = start, end
        elif start == stop + 1 and data[stop] == 0x20:
            stop = end
        else:
            yield begin, stop
            begin, stop = start, end
    if begin is not None:
        yield begin, stop


def _marks(window, phrase):
    def run(batches):
        for batch in batches:
            sizes, digests, lists = [], [], []
            for _, data, starts, ends, hashes in _documents(batch):
                sizes.append(len(starts))
                digests.append(_digest(_joined(data, starts, ends)))
                phrases = hashing.shingles(hashes, phrase)
                lists.append(np.unique(phrases[anchors(phrases, window - phrase + 1)[0]]))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    hashing.long_lists(lists),
                ],
                names=["doc_id", "text_id", "n_words", "digest", "anchors"],
            )

    return run


_MARKS = "doc_id long, text_id long, n_words long, digest binary, anchors array<long>"


def _segments(window, phrase):
    """The windows around each occurrence of a text's recurring anchors, from rows (doc_id,
    text_id, anchors, text): their hashes, their spellings, and the phrases they are made of."""
    steps = window // phrase

    def run(batches):
        for batch in batches:
            columns = [], [], [], []
            windows, letters, spelled = [], [], []
            wanted = batch.column(2)
            for row, _, _, _, hashes in _documents(batch):
                phrases = hashing.shingles(hashes, phrase)
                places, owner = anchors(phrases, window - phrase + 1)
                if not len(owner):
                    continue
                known = np.isin(phrases[places].view(np.int64), wanted[row].values.to_numpy())
                whole = hashing.shingles(hashes, window)
                letter = phrases >> np.uint64(64 - LETTER_BITS)
                spelling = np.zeros(len(whole), np.uint64)
                for i in range(steps):
                    spelling <<= np.uint64(LETTER_BITS)
                    spelling |= letter[i * phrase : i * phrase + len(whole)]
                edges = np.searchsorted(owner, np.arange(len(places) + 1))
                for i in np.flatnonzero(known).tolist():
                    a, b = int(edges[i]), int(edges[i + 1])
                    own = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                    anchor = int(phrases[places[i]].view(np.int64))
                    for column, value in zip(columns, (*own, anchor, a), strict=True):
                        column.append(value)
                    windows.append(whole[a:b])
                    spelled.append(spelling[a:b])
                    letters.append(letter[a : b + window - phrase].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(column, pa.int64()) for column in columns),
                    hashing.long_lists(windows),
                    hashing.long_lists(spelled),
                    pa.array(letters, pa.binary()),
                ],
                names=["doc_id", "text_id", "anchor", "first", "windows", "spelled", "letters"],
            )

    return run


_SEGMENTS = (
    "doc_id long, text_id long, anchor long, first long, windows array<long>, "
    "spelled array<long>, letters binary"
)


def _letters(spelling: int, steps: int) -> tuple[int, ...]:
    mask = (1 << LETTER_BITS) - 1
    return tuple((spelling >> (LETTER_BITS * i)) & mask for i in reversed(range(steps)))


def _located(window, phrase):
    """Reads each shard's passages (kind 0), then streams its segments (kind 1) through them."""
    steps = window // phrase

    def run(batches):
        shard = automaton = None
        compiled = False
        for batch in batches:
            out = [], [], [], []
            shards, kinds, passages, spellings, ids, texts, firsts = (
                batch.column(i).to_pylist() for i in range(7)
            )
            windows, letters = batch.column(7), batch.column(8)
            flat = windows.flatten().to_numpy()
            bounds = np.cumsum([0, *windows.value_lengths().fill_null(0).to_pylist()]).tolist()
            for i, (own, kind) in enumerate(zip(shards, kinds, strict=True)):
                if own != shard:
                    shard, compiled = own, False
                    automaton = ahocorasick.Automaton(
                        ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE
                    )
                if kind == 0:
                    spelt = _letters(spellings[i], steps)
                    known = automaton.get(spelt, ())
                    automaton.add_word(spelt, (*known, (passages[i], ids[i])))
                    continue
                if not len(automaton):
                    continue
                if not compiled:
                    automaton.make_automaton()
                    compiled = True
                own_windows = flat[bounds[i] : bounds[i + 1]]
                spelt = np.frombuffer(letters[i].as_py(), "<u2").tolist()
                places = _hits(automaton, spelt, own_windows, ids[i], phrase, steps)
                for begin, end in _consecutive(places):
                    values = ids[i], texts[i], firsts[i] + begin, firsts[i] + end + window
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.int64()) for values in out],
                names=["doc_id", "text_id", "begin", "end"],
            )

    return run


def _hits(automaton, letters, windows, doc_id, phrase, steps):
    """The windows, by number, whose passage belongs to a smaller document."""
    found = []
    for phase in range(min(phrase, len(windows))):
        # Every `phrase`-th letter: a window is `steps` of them in a row.
        for last, owners in automaton.iter(tuple(letters[phase::phrase])):
            at = phase + (last - steps + 1) * phrase
            if at < len(windows):
                for passage, owner in owners:
                    if owner < doc_id and passage == windows[at]:
                        found.append(at)
    return sorted(found)


def _consecutive(places):
    begin = before = None
    for place in places:
        if begin is not None and place > before + 1:
            yield begin, before
            begin = None
        if begin is None:
            begin = place
        before = place
    if begin is not None:
        yield begin, before


def _cleaned(batches):
    """Rows (doc_id, text_id, begins, ends, text): the texts without the words of the ranges."""
    for batch in batches:
        removed, texts = [], []
        for row, data, starts, stops, _ in _documents(batch):
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, batch.column(2)[row].values.to_numpy(), 1)
            np.add.at(change, batch.column(3)[row].values.to_numpy(), -1)
            keep = np.cumsum(change[:-1]) == 0
            removed.append(int((~keep).sum()))
            texts.append(_joined(data, starts[keep], stops[keep]).decode())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
            names=["doc_id", "text_id", "n_removed", "kept_text"],
        )


def remove(documents: DataFrame, window: int = WINDOW, phrase: int = PHRASE):
    """Two tables. The first has a row per document: doc_id, n_words, n_removed and digest, the
    SHA-256 of the kept words joined by blanks. The second has the kept texts, (doc_id, text_id,
    n_removed, kept_text), of the documents that lose some words but are no copies; `text_id` is
    the XXH64 hash of the text.

    `window` must be a multiple of `phrase`. The text is shuffled once, to join it with its
    recurring anchors; after that only documents with recurring anchors take part.
    """
    if window % phrase or LETTER_BITS * (window // phrase) > 64:
        raise ValueError("window must be some five times phrase")
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text"
    )
    all_marks = cut(texts.mapInArrow(_marks(window, phrase), _MARKS), "marks")
    narrow = all_marks.drop("anchors")
    classes = narrow.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    marks = cut(narrow.join(classes, "digest"), "classes")
    key = ["doc_id", "text_id"]
    firsts = marks.where(f"doc_id = class_id AND n_words >= {window}").select(key).distinct()
    held = cut(
        all_marks.join(firsts, key, "left_semi").select(*key, F.explode("anchors").alias("anchor")),
        "held",
    )
    counted = held.groupBy("anchor").agg(
        F.min("doc_id").alias("least"),
        F.max("doc_id").alias("most"),
        F.count(F.lit(1)).alias("holders"),
    )
    recurring = cut(counted.where("least < most").select("anchor", "holders"), "anchors")
    wanted = held.join(recurring, "anchor").groupBy(key).agg(
        F.collect_set("anchor").alias("anchors")
    )
    involved = cut(texts.join(wanted, key).select(*key, "anchors", "text"), "involved")
    segments = cut(involved.mapInArrow(_segments(window, phrase), _SEGMENTS), "segments")
    passages = cut(_passages(segments), "passages")
    ranges = _ranges(segments, passages, recurring, window, phrase)
    cleaned = cut(
        involved.drop("anchors")
        .join(ranges, key)
        .select(*key, "begins", "ends", "text")
        .mapInArrow(_cleaned, "doc_id long, text_id long, n_removed long, kept_text string")
        .dropDuplicates(key),
        "cleaned",
    )
    kept = cleaned.select(*key, "n_removed", F.sha2("kept_text", 256).alias("kept"))
    copy = (F.col("doc_id") > F.col("class_id")) & (F.col("n_words") >= window)
    report = marks.join(kept, key, "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias(
            "n_removed"
        ),
        F.when(copy, F.sha2(F.lit(""), 256))
        .otherwise(F.coalesce("kept", F.lower(F.hex("digest"))))
        .alias("digest"),
    )
    return report, cleaned


def _passages(segments: DataFrame) -> DataFrame:
    """Windows found in two documents, with their smallest one."""
    window = F.explode(F.arrays_zip("windows", "spelled")).alias("w")
    return (
        segments.select("doc_id", "anchor", window)
        .groupBy(F.col("w.windows").alias("passage"), "anchor", F.col("w.spelled").alias("spelling"))
        .agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most"))
        .where("doc_id < most")
        .drop("most")
    )


def _ranges(segments, passages, recurring, window, phrase):
    """(doc_id, text_id, begins, ends): word ranges covered by passages of smaller documents."""
    shards = max(passages.count() // SHARD_WINDOWS, segments.count() // HOT) + 1
    hot = recurring.where(F.col("holders") > HOT).select(
        "anchor", F.ceil(F.col("holders") / HOT).alias("tasks")
    )
    tasks = F.coalesce("tasks", F.lit(1))
    copies = passages.join(hot, "anchor", "left").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("salt")
    )
    base = F.pmod("anchor", F.lit(shards))
    known = copies.select(
        (base + F.lit(shards) * F.col("salt")).alias("shard"),
        F.lit(0).alias("kind"),
        "passage",
        "spelling",
        "doc_id",
        F.lit(None).cast("long").alias("text_id"),
        F.lit(None).cast("long").alias("first"),
        F.lit(None).cast("array<long>").alias("windows"),
        F.lit(None).cast("binary").alias("letters"),
    )
    streamed = segments.join(hot, "anchor", "left").select(
        (base + F.lit(shards) * F.pmod("doc_id", tasks)).alias("shard"),
        F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("passage"),
        F.lit(None).cast("long").alias("spelling"),
        "doc_id",
        "text_id",
        "first",
        "windows",
        "letters",
    )
    return (
        known.union(streamed)
        .repartition("shard")
        .sortWithinPartitions("shard", "kind")
        .mapInArrow(_located(window, phrase), "doc_id long, text_id long, begin long, end long")
        .groupBy("doc_id", "text_id")
        .agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    )
