"""Packing documents into token windows by non-negative least squares.

A document is cut into full windows and a rest. The histogram of the rests' lengths is all that
is planned on: shallow combinations of lengths that fill a window exactly are enumerated, their
repeat counts are the non-negative least squares solution against the histogram, rounded down,
and what is left is packed greedily, largest length first. The plan gives each length ranges of
ranks; a piece's rank among the pieces of its length then names its sequence and place.

Only the histogram comes to the driver, and its shares by salt, whose number grows with the square
root of the pieces (some 25,000 numbers for ten thousand million full windows). Defined cases: a null or empty text is its end token alone; pieces of repeated rows are
packed like any others; a null `doc_id` is kept; further columns are ignored; an empty table
gives no rows.
"""

import os
import re
import zlib
from array import array
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.session import cut

from . import hashing
from .held import held, trimmed

WINDOW = 2048
END = 1
GRID = 32
"""Combinations of three lengths have one that is a multiple of this."""
SALTED = 16
"""A length of n pieces has sqrt(n / SALTED) salts, so groups and their number grow alike."""
SLICE_BYTES = 1 << 19
"""Bytes of texts whose words are looked up together: memory beside the remembered words."""
CACHE = 500_000
"""Words and parts of words, together, whose token ids a worker keeps."""


class _Pool:
    """Id lists by key, as ranges of one array."""

    def __init__(self):
        self.place, self.count = {}, 0
        self.ids, self.starts, self.sizes = array("I"), array("q"), array("q")

    def add(self, keys, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.place.update(zip(keys, range(self.count, self.count + len(sizes)), strict=True))
        self.count += len(sizes)
        sizes = np.ascontiguousarray(sizes, np.int64)
        self.starts.frombytes((np.cumsum(sizes) - sizes + len(self.ids)).tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.ids.frombytes(np.ascontiguousarray(ids, np.uint32).tobytes())

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the places in a row, and each place's number of ids."""
        if not len(places):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # Views: copies of whole pools would be made for each slice of texts.
        sizes = np.frombuffer(self.sizes, np.int64)[places]
        starts = np.frombuffer(self.starts, np.int64)[places]
        total = int(sizes.sum())
        if not total:
            return np.zeros(0, np.uint32), sizes
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(total)
        return np.frombuffer(self.ids, np.uint32)[at], sizes


class WordTokenizer:
    """Token ids by a tokenizer that drops white space, word by word, with a bounded cache.

    Words of ASCII and Latin-1 letters are split by the tokenizer's own rule and each part is
    given to its model; any others go through the whole tokenizer, one word at a time.
    """

    # The split pattern of the vocabulary file, for the plain characters.
    _PLAIN = re.compile("[ -~À-ÖØ-öø-ÿ]+")
    _SPLIT = re.compile(" |'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words = _Pool()

    def _learn(self, words: list[bytes]) -> None:
        words = list(set(words))
        joined = b" ".join(words)
        if b"<|" in joined or not self._PLAIN.fullmatch(joined.decode()):
            odd = [w for w in words if b"<|" in w or not self._PLAIN.fullmatch(w.decode())]
            lists = [
                self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in odd
            ]
            flat = np.array([i for ids in lists for i in ids], np.uint32)
            self.words.add(odd, flat, np.array([len(ids) for ids in lists], np.int64))
            words = [w for w in words if w not in self.words.place]
            joined = b" ".join(words)
        if not words:
            return
        parts = self._SPLIT.findall(joined.decode().lower())
        # A part is a word as well, with the same ids, so both are kept once.
        known = self.words.place
        keys = {part: part.encode() for part in set(parts) if part != " "}
        new = [part for part, key in keys.items() if key not in known]
        for first in range(0, len(new), 2000):
            some = new[first : first + 2000]
            coded = self.bare.encode(" ".join(map(self._spelt, some)), add_special_tokens=False)
            sizes = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(some))
            self.words.add([keys[p] for p in some], np.array(coded.ids, np.uint32), sizes)
        found = {part: known[key] for part, key in keys.items()}
        places = np.fromiter(map(found.get, parts, repeat(-1)), np.int64, len(parts))
        blank = places < 0
        ids, sizes = self.words.gather(places[~blank])
        owner = np.cumsum(blank)[~blank]
        sizes = np.bincount(owner, sizes, len(words)).astype(np.int64)
        left = np.fromiter((word not in known for word in words), bool, len(words))
        self.words.add(
            [word for word in words if word not in known], ids[np.repeat(left, sizes)], sizes[left]
        )

    def _spelt(self, part: str) -> str:
        return part if part.isascii() else "".join([self.letters[b] for b in part.encode()])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.words.count > CACHE:
            self.words = _Pool()
        split = [text.split() for text in texts]
        words = list(chain.from_iterable(split))
        find = self.words.place.get
        places = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            self._learn(new)
            places[missing] = np.fromiter(map(find, new), np.int64, len(new))
        ids, sizes = self.words.gather(places)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _pieces(path, window, with_ids):
    def run(batches):
        tokenizer = held((WordTokenizer, path), lambda: WordTokenizer(path))
        for batch in batches:
            first = 0
            data, offsets = hashing.text_bytes(batch.column(1))
            while first < batch.num_rows:
                last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
                last = max(last, first + 1)
                texts = [
                    data[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)
                ]
                rows = [], [], [], [], []
                pieces = []
                for i, ids in enumerate(tokenizer.encode(texts)):
                    ids = np.append(ids, np.uint32(END))
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window].astype("<u4")
                        values = (
                            first + i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)
                        )
                        for column, value in zip(rows, values, strict=True):
                            column.append(value)
                        if with_ids:
                            pieces.append(piece.astype(np.int32))
                columns = [
                    batch.column(0).take(pa.array(rows[0], pa.int64())),
                    *(pa.array(column, pa.int64()) for column in rows[1:]),
                ]
                if with_ids:
                    columns.append(pa.array(pieces, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=_PIECE_NAMES[: len(columns)])
                first = last

    return run


_PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]


def combinations(window: int, lengths: np.ndarray, grid: int = GRID) -> np.ndarray:
    """Pairs and triples of the given lengths that fill the window; pairs end with a zero."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    first = np.arange(1, window // 2 + 1)
    pairs = np.stack([first, window - first, np.zeros_like(first)], axis=1)
    second = np.arange(1, window)
    triples = [
        np.stack([np.full_like(second, a), second, window - a - second], axis=1)
        for a in range(grid, window, grid)
    ]
    triples = np.sort(np.concatenate(triples or [np.zeros((0, 3), int)]), axis=1)[:, ::-1]
    triples = np.unique(triples[triples[:, 2] > 0], axis=0)
    found = np.concatenate([pairs, triples])
    return found[there[found[:, 0]] & there[found[:, 1]] & (there[found[:, 2]] | (found[:, 2] == 0))]


def solve(columns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations with the least squared distance of the lengths
    used from the histogram, by accelerated projected gradients."""
    if not len(columns):
        return np.zeros(0)
    used = histogram.astype(float).copy()
    used[0] = 0

    def lengths_of(x):
        flat = np.bincount(columns.ravel(), np.repeat(x, columns.shape[1]), len(histogram))
        flat[0] = 0
        return flat

    def back(r):
        return r[columns].sum(axis=1)

    probe = np.ones(len(columns))
    for _ in range(20):
        probe = back(lengths_of(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(lengths_of(y) - used) / (1.01 * norm), 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / later * (new - x)
        x, t = new, later
    return x


def plan(histogram: np.ndarray) -> list[tuple[list[int], int]]:
    """Windows as (lengths, repeats): every counted length is used exactly as often as counted."""
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    windows = [([window], int(left[window]))] if left[window] else []
    left[window] = 0
    columns = combinations(window, np.flatnonzero(left))
    counts = solve(columns, left)
    for i in np.argsort(-counts, kind="stable").tolist():
        repeats = int(counts[i])
        if not repeats:
            break
        lengths = [x for x in columns[i].tolist() if x]
        repeats = min(repeats, *(int(left[x]) // lengths.count(x) for x in lengths))
        if repeats:
            windows.append((lengths, repeats))
            for x in lengths:
                left[x] -= repeats
    return windows + _greedy(left, window)


def _greedy(left, window):
    """Largest length first, filled up with the largest that still fit; one step uses up at
    least one length."""
    windows = []
    while left.any():
        lengths, room = [], window
        free = left.copy()
        while room > 0:
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits):
                break
            lengths.append(int(fits[-1]))
            free[lengths[-1]] -= 1
            room -= lengths[-1]
        repeats = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        for x in lengths:
            left[x] -= repeats
        windows.append((lengths, repeats))
    return windows


def places(windows) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, first offset), sorted."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, repeats in windows:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            several = lengths.count(length)
            rank = ranks.get(length, 0)
            rows.append((length, rank, sequence, several, offset))
            ranks[length] = rank + repeats * several
            offset += several * length
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(table, first, bases, names, ids):
    order = table[:, 0] * (1 << 48) + table[:, 1] if len(table) else np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            salt = batch.column(batch.schema.get_field_index("salt")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            rank = rank - 1 + bases[first[length] + salt]
            row = table[np.searchsorted(order, length * (1 << 48) + rank, "right") - 1]
            place = rank - row[:, 1]
            sequence = row[:, 2] + place // row[:, 3]
            offset = row[:, 4] + place % row[:, 3] * length
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def _salted(pieces: DataFrame, salts: np.ndarray) -> DataFrame:
    """The pieces with a salt below their length's number of salts."""
    numbers = pieces.sparkSession.createDataFrame(
        list(enumerate(salts.tolist())), "length long, salts long"
    )
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts"))
    return pieces.join(F.broadcast(numbers), "length").withColumn("salt", salt).drop("salts")


def pack(
    documents: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with `with_ids` the token ids.

    `tokenizer` is the path of a tokenizer file that all executors can read. Texts are tokenized
    once; the pieces are a written table. Pieces of one length, which copies and full windows share,
    are ranked by salt and the salts' sizes are added, so no task gets all of them.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shape = ", ".join(f"{name} long" for name in _PIECE_NAMES[:5])
    if with_ids:
        shape += ", ids array<int>"
    pieces = cut(rows.mapInArrow(trimmed(_pieces(tokenizer, window, with_ids)), shape), "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    salts = np.maximum(np.ceil(np.sqrt(histogram / SALTED)).astype(np.int64), 1)
    salted = _salted(pieces, salts)
    first = np.cumsum(salts) - salts
    sizes = np.zeros(int(salts.sum()), np.int64)
    for row in salted.groupBy("length", "salt").count().collect():
        sizes[first[row["length"]] + row["salt"]] = row["count"]
    bases = np.cumsum(sizes) - sizes
    bases -= np.repeat(bases[first], salts)
    table = places(plan(histogram))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order).cast("long"))
    names = _PIECE_NAMES[: 6 if with_ids else 5]
    return ranked.mapInArrow(
        trimmed(_placed(table, first, bases, names, with_ids)), shape + ", sequence_id long, offset long"
    )
