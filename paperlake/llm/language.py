"""Language identification by nearest centroids.

A text is the TF-IDF vector of its hashed byte n-grams (lower-cased; runs of ASCII non-letters
count as one blank), at length one; document frequencies are counted over all labelled rows. Each
language has several centroids, found by spherical k-means over a bounded sample of labelled rows;
a text gets the language of the nearest centroid by cosine. Similarity grows with the number of
different n-grams, so each language has one cut-off per size: a share of a low quantile of the
similarities of sampled texts, whole and cut short, to centroids of the sample's other half. A few
odd rows move neither quantiles nor centroids.

Defined cases: a null text or one without letters is `und` with score 0 and rejected; with no
labelled row at all every text is `und`; rows without language are not learned from; a size with
too few labelled texts has the cut-off of the next smaller one, or none; repeated rows are
predicted alike; equal similarities go to the language first in alphabetical order.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, held

ORDERS = (1, 2, 3, 4)
SHARE = 16
"""A slice of texts is counted in this many parts, of one text at least, so that its places take less memory."""
SLICE_ROWS = 256
"""Texts in a slice, at most."""
LOWERED_ROWS = 4 * SLICE_ROWS
LOWERED_BYTES = 8 * hashing.SLICE_BYTES
"""Texts that are lower-cased at a time, both at most: always a slice's, as none shrinks to an eighth."""
DIMENSIONS = 4096
SAMPLE = 2000
"""Labelled rows per language that a model is fitted on, as expected from a hash of the row."""
CENTROIDS = 4
QUANTILE = 0.05
MARGIN = 0.6
"""A text is rejected below this share of its language's and size's quantile of similarities."""
PIECES = (8, 16, 32, 64, 128, 256)
"""Characters that sampled texts are cut to besides, for the cut-offs of short texts."""
LEAST = 20
"""Left-out texts of one size that make a quantile."""
SIZES = DIMENSIONS.bit_length()
UNKNOWN = "und"
_VERDICT = "_language_verdict"
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray


def _counts(column):
    """Slices of rows: (first row, last row, counts of rows x dimensions)."""
    column = column.cast(pa.large_string())
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(column):
        # Texts are lower-cased some slices at a time; the last slice may go on beyond them.
        size = (sizes[row - 1] if row else 0) + LOWERED_BYTES
        rows = min(int(np.searchsorted(sizes, size, "right")) - row, LOWERED_ROWS)
        texts = pc.utf8_lower(pc.fill_null(column.slice(row, max(rows, 1)), ""))
        data, offsets = hashing.text_bytes(texts)
        first, whole = 0, row + len(texts) == len(column)
        while first < len(texts):
            last = min(_until(offsets, first, hashing.SLICE_BYTES), first + SLICE_ROWS)
            if last == len(texts) and first and not whole:
                break
            counts = np.empty((last - first, DIMENSIONS), np.int64)
            begin = first
            while begin < last:
                end = min(_until(offsets, begin, hashing.SLICE_BYTES // SHARE), last)
                counts[begin - first : end - first] = _slice_counts(data, offsets, begin, end)
                begin = end
            yield row + first, row + last, counts
            first = last
        row += first


def _until(offsets, first, size):
    return max(int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1, first + 1)


def _slice_counts(data, offsets, first, last):
    """Long texts are counted in pieces that overlap by the longest n-gram."""
    counts = np.zeros((last - first) * DIMENSIONS, np.int64)
    overlap = max(ORDERS) - 1
    begin, end = int(offsets[first]), int(offsets[last])
    for start in range(begin, end, 4 * hashing.SLICE_BYTES):
        stop = min(start + 4 * hashing.SLICE_BYTES, end)
        piece = _BLANK[data[start : min(stop + overlap, end)]]
        if not len(piece):
            continue
        row = np.searchsorted(offsets[first : last + 1], np.arange(start, start + len(piece)), "right") - 1
        keep = np.ones(len(piece), bool)
        keep[1:] = (piece[1:] != 0x20) | (piece[:-1] != 0x20) | (row[1:] != row[:-1])
        at = np.flatnonzero(keep[: stop - start])
        piece, row, limit = piece[keep], row[keep], len(at)
        gram = np.zeros(len(piece), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            length = len(piece) - order + 1
            if length <= 0:
                break
            gram = gram[:length] * np.uint32(0x01000193) + piece[order - 1 :] + np.uint32(order)
            same = row[:length] == row[order - 1 :]
            same[limit:] = False
            spread = gram * np.uint32(0x9E3779B1)
            cell = (spread >> np.uint32(20)).astype(np.int64) % DIMENSIONS
            counts += np.bincount((row[:length] * DIMENSIONS + cell)[same], minlength=len(counts))
    return counts.reshape(-1, DIMENSIONS)


def _sizes(counts):
    """The binary logarithm of each row's number of different n-grams, rounded down."""
    return np.log2(np.maximum((counts > 0).sum(axis=1), 1)).astype(np.int64)


def _vectors(counts, weights):
    vectors = np.log1p(counts.astype(np.float32)) * weights
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.maximum(norms, 1e-12)


def _lettered(column):
    return pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}"), False)


def _sample(labelled: DataFrame, sample: int) -> DataFrame:
    """About `sample` rows of each language, chosen by a hash of the text and its id."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1 << 30)) / (1 << 30)
    return (
        labelled.join(F.broadcast(sizes), "lang")
        .where(share < sample / F.col("size"))
        .select("lang", "text", F.xxhash64("text").alias("key"))
    )


def _weights(rows: DataFrame) -> np.ndarray:
    """The inverse document frequency of each dimension over all rows.

    Each task hands on one number per dimension, and one comes to the driver.
    """

    def present(batches):
        held.release()
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for first, last, counts in _counts(batch.column(0)):
                total[:-1] += (counts > 0).sum(axis=0)
                total[-1] += last - first
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    frequency = np.zeros(DIMENSIONS + 1)
    counted = rows.select("text").mapInArrow(held.trimmed(present), "cell long, n long").groupBy("cell")
    for row in counted.agg(F.sum("n").alias("n")).collect():
        frequency[row["cell"]] = row["n"]
    return (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 0.1).astype(np.float32)


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Fit a model on rows (doc_id, text, lang); rows without text or language are left out.

    The sample is bounded per language, so is what comes to the driver: document frequencies
    (one number per dimension), the centroids and cut-offs.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")

    def sparse(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            yield from described(batch, texts, True)
            for length in PIECES:
                longer = pc.greater(pc.utf8_length(texts), length)
                yield from described(
                    batch.filter(longer),
                    pc.utf8_slice_codeunits(texts.filter(longer), 0, length),
                    False,
                )

    def described(batch, texts, whole):
        for first, last, counts in _counts(texts):
            cells = [np.flatnonzero(row) for row in counts]
            ends = np.cumsum([0] + [len(c) for c in cells])
            flat = np.concatenate([row[c] for row, c in zip(counts, cells, strict=True)])
            lists = [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
                for values, kind in ((np.concatenate(cells), pa.int16()), (flat, pa.int32()))
            ]
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([whole] * (last - first)), *lists],
                names=["lang", "key", "whole", "cells", "counts"],
            )

    weights = _weights(rows)

    def cluster(key, table):
        # Without an object per row: a worker's memory would keep the holes that they leave.
        held.release()
        rows = _Sparse(table, weights)
        whole = rows.order[rows.whole[rows.order]]
        points = rows.dense(whole)[0]
        half = rows.key[whole] & 1
        similar, sizes = [], []
        for side in (0, 1):
            left_out = rows.order[(rows.key[rows.order] & 1) != side]
            if not (half == side).any():
                continue
            centres = _spherical_means(points[half == side], centroids)
            for begin in range(0, len(left_out), 512):
                vectors, size = rows.dense(left_out[begin : begin + 512])
                similar.append((vectors @ centres.T).max(axis=1))
                sizes.append(size)
        floors = _floors(np.concatenate([[], *similar]), np.concatenate([[], *sizes]))
        centres = _spherical_means(points, centroids)
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * len(centres), pa.string()),
                "centroid": pa.array(list(centres), pa.list_(pa.float32())),
                "floors": pa.array([floors] * len(centres), pa.list_(pa.float64())),
            }
        )

    shape = "lang string, key long, whole boolean, cells array<short>, counts array<int>"
    fitted = (
        _sample(rows, sample)
        .mapInArrow(held.trimmed(sparse), shape)
        .groupBy("lang")
        .applyInArrow(cluster, "lang string, centroid array<float>, floors array<double>")
        .orderBy("lang", "centroid")
        .collect()
    )
    return Model(
        [row["lang"] for row in fitted],
        weights,
        np.array([row["centroid"] for row in fitted], np.float32).reshape(-1, DIMENSIONS),
        np.array([row["floors"] for row in fitted]).reshape(-1, SIZES),
    )


class _Sparse:
    """Sampled rows as lists of cells and counts, with their order by key."""

    def __init__(self, table: pa.Table, weights: np.ndarray):
        self.weights = weights
        self.key = table["key"].to_numpy()
        self.whole = table["whole"].to_numpy()
        self.order = np.argsort(self.key, kind="stable")
        # Views of the table's chunks: (first row, lengths, starts, cells, counts).
        self.chunks, first = [], 0
        for cells, counts in zip(table["cells"].chunks, table["counts"].chunks, strict=True):
            lengths = cells.value_lengths().to_numpy()
            starts = np.cumsum(lengths) - lengths
            flat = cells.flatten().to_numpy(), counts.flatten().to_numpy()
            self.chunks.append((first, lengths, starts, *flat))
            first += len(lengths)

    def dense(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors and sizes of the rows `at`; only slices of them have counts besides."""
        vectors = np.empty((len(at), DIMENSIONS), np.float32)
        sizes = np.empty(len(at), np.int64)
        for begin in range(0, len(at), 128):
            part = at[begin : begin + 128]
            counts = np.zeros((len(part), DIMENSIONS), np.float32)
            for first, all_lengths, starts, cells, values in self.chunks:
                here = np.flatnonzero((part >= first) & (part < first + len(all_lengths)))
                rows = part[here] - first
                lengths = all_lengths[rows]
                index = np.arange(lengths.sum())
                index += np.repeat(starts[rows] - (np.cumsum(lengths) - lengths), lengths)
                counts[np.repeat(here, lengths), cells[index]] = values[index]
            vectors[begin : begin + 128] = _vectors(counts, self.weights)
            sizes[begin : begin + 128] = _sizes(counts)
        return vectors, sizes


def _floors(similar, sizes):
    """The cut-off of each size."""
    floors = [0.0] * SIZES
    for size in range(SIZES):
        own = similar[sizes == size]
        if len(own) >= LEAST:
            floors[size] = float(np.quantile(own, QUANTILE)) * MARGIN
        elif size:
            floors[size] = floors[size - 1]
    return floors


def _spherical_means(points, count, rounds=15):
    """Centroids of unit length, started from equal groups by similarity to the mean; those with
    under a hundredth of the points are left out."""
    order = np.argsort(points @ points.sum(axis=0), kind="stable")
    groups = [points[at].sum(axis=0) for at in np.array_split(order, min(count, len(points)))]
    centres = np.array([c / max(np.linalg.norm(c), 1e-12) for c in groups], np.float32)
    for _ in range(rounds):
        owner = (points @ centres.T).argmax(axis=1)
        for i in range(len(centres)):
            total = (owner == i).astype(np.float32) @ points
            if np.linalg.norm(total) > 0:
                centres[i] = total / np.linalg.norm(total)
    members = np.bincount((points @ centres.T).argmax(axis=1), minlength=len(centres))
    return centres[members * 100 >= len(points)]


def identify(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of rows with a column `text`, with `lang_pred`, `score` (cosine, 0 to 1) and `rejected`.

    Columns of these names in the input are replaced. One pass without a shuffle.
    """
    added = ["lang_pred", "score", "rejected"]
    kept = [c for c in keep if c not in added]
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    # Only verdicts come back from Python; the kept columns stay where they are.
    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def verdict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held.release()
        for column in columns:
            best = np.full(len(column), len(names) - 1)
            score = np.zeros(len(column))
            floor = np.full(len(column), 2.0)
            if len(model.languages):
                for first, last, counts in _counts(column):
                    similar = _vectors(counts, model.weights) @ model.centroids.T
                    best[first:last] = similar.argmax(axis=1)
                    score[first:last] = similar.max(axis=1)
                    floor[first:last] = model.floors[best[first:last], _sizes(counts)]
                lettered = _lettered(column).to_numpy(zero_copy_only=False)
                best[~lettered] = len(names) - 1
                score[~lettered] = 0
                floor[~lettered] = 2.0
            found = [pa.array(names[best].tolist(), pa.string())]
            found += [pa.array(np.clip(score, 0, 1)), pa.array(score < floor)]
            yield pa.StructArray.from_arrays(found, added)
        held.trim()

    # A filter on the verdict would else be pushed below it and repeat it.
    found = documents.withColumn(_VERDICT, verdict.asNondeterministic()("text"))
    return found.select(*kept, *(F.col(_VERDICT)[name].alias(name) for name in added))
