"""Words, shingles and windows of Arrow text columns as 64-bit hashes, computed in numpy.

Words are runs of bytes other than ASCII white space. A word's hash is a polynomial over random
byte values modulo 2**64, mixed; equal words have equal hashes, and unequal ones collide with a
probability of about 2**-64.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_ORDER = _random.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _power(base: int, count: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; kept and grown between calls."""
    known = _powers.get(base)
    if known is None or len(known) < count:
        steps = np.full(max(count, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:count]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and each row's offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Byte starts and ends of all words, and the rows' offsets among the words."""
    filled = ~_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = filled
    before[offsets] = False
    starts = np.flatnonzero(filled & ~before[:-1])
    after = np.empty(len(data) + 1, bool)
    after[:-1] = filled
    after[-1] = False
    after[offsets] = False
    ends = np.flatnonzero(filled & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span; spans are in order and do not overlap. Memory is bounded by slices."""
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + SLICE_BYTES, "right")))
        begin, end = starts[first:last] - origin, ends[first:last] - origin
        size = int(end[-1])
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data[origin : origin + size]] * _power(_BASE, size), out=sums[1:])
        hashes[first:last] = (sums[end] - sums[begin]) * _power(_INVERSE, size)[begin]
        first = last
    return mix(hashes)


def words(column, lower=False):
    """Word hashes of a text column and the rows' offsets among them."""
    data, offsets = text_bytes(column)
    if lower:
        data = lower_ascii(data)
    starts, ends, rows = word_spans(data, offsets)
    return hash_spans(data, starts, ends), rows


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words; order counts."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    if size <= 10:
        total = np.zeros(count, np.uint64)
        for i in range(size):
            total += hashes[i : i + count] * _ORDER[i]
        return mix(total)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * _power(_BASE, len(hashes)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _power(_INVERSE, count))


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The hash of a whole word sequence."""
    return shingles(hashes, len(hashes))[0]


def shingle_sets(column, size: int, lower=True) -> list[np.ndarray]:
    """Per row, the sorted distinct shingles; a shorter text is one shingle, no words are none."""
    hashes, rows = words(column, lower)
    sets = []
    for begin, end in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        own = hashes[begin:end]
        if not len(own):
            sets.append(own)
        elif len(own) < size:
            # The length keeps a short sequence apart from a full shingle.
            sets.append(mix(shingles(own, len(own)) + np.uint64(len(own))))
        else:
            sets.append(np.unique(shingles(own, size)))
    return sets


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), as_long(flat))
