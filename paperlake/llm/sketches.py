"""Parity sketches of feature sets: which members of a bucket can be similar at all.

A sketch has a bit for each cell of a power of two of cells, near the set's size: whether an odd
number of features falls into the cell. A bit in which two sketches differ stands for a feature
that one set has alone, so more such bits than similar sets may differ in features rule a pair
out, without the texts. No similar pair is lost. A sketch is folded to half its cells by xor, so
sets of neighbouring sizes are compared in the smaller number of cells.
"""

import numpy as np
import pyarrow as pa

LEAST_CELLS, MOST_CELLS = 64, 4096
FEW = 48
"""Members that are compared one by one; more of them are compared in numpy."""


def sketches(sets: list[np.ndarray]) -> pa.Array:
    """The sketch of each set of hashed features; an empty set has none of its bits."""
    sizes = np.array([len(s) for s in sets], np.int64)
    cells = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    cells = np.where(sizes > 0, np.clip(cells, LEAST_CELLS, MOST_CELLS), 0)
    features = np.concatenate(sets).astype(np.uint64) if len(sets) else np.zeros(0, np.uint64)
    place = (features & np.repeat(cells - 1, sizes).astype(np.uint64)).astype(np.int64)
    place += np.repeat(np.cumsum(cells) - cells, sizes)
    odd = (np.bincount(place, minlength=int(cells.sum())) & 1).astype(np.uint8)
    ends = np.concatenate(([0], np.cumsum(cells // 8))).astype(np.int32)
    packed = np.packbits(odd, bitorder="little")
    return pa.Array.from_buffers(
        pa.binary(), len(sets), [None, pa.py_buffer(ends), pa.py_buffer(packed)]
    )


def parts(sizes: list[int], found: list[bytes], percent: int) -> list[list[int]]:
    """The members of a bucket in parts, so that no pair of two parts is similar."""
    return (_few if len(sizes) <= FEW else _many)(sizes, found, percent)


def _few(sizes, found, percent):
    bits = [8 * len(x) for x in found]
    numbers = [int.from_bytes(x, "little") for x in found]

    def near(i, j):
        a, b = sizes[i], sizes[j]
        if 100 * min(a, b) < percent * max(a, b):
            return False
        i, j = (i, j) if bits[i] >= bits[j] else (j, i)
        x, cells = numbers[i], bits[i]
        while cells > bits[j]:
            cells //= 2
            x = (x >> cells) ^ (x & ((1 << cells) - 1))
        return (x ^ numbers[j]).bit_count() * (100 + percent) <= (a + b) * (100 - percent)

    left, done = list(range(len(sizes))), []
    while left:
        part = [left.pop(0)]
        for i in part:
            hits = [j for j in left if near(i, j)]
            if hits:
                part += hits
                left = [j for j in left if j not in hits]
        done.append(part)
    return done


def _many(sizes, found, percent):
    sizes = np.array(sizes, np.int64)
    cells = np.array([8 * len(x) for x in found])
    words = {}
    left = {}
    for c in np.unique(cells).tolist():
        left[c] = np.flatnonzero(cells == c)
        flat = b"".join(found[i] for i in left[c].tolist())
        words[c] = np.frombuffer(flat, np.uint64).reshape(len(left[c]), -1)

    def fold(rows):
        half = rows.shape[-1] // 2
        return rows[..., :half] ^ rows[..., half:]

    folded = {c: fold(rows) for c, rows in words.items() if c > LEAST_CELLS}
    row_of = np.zeros(len(sizes), np.int64)
    for at in left.values():
        row_of[at] = np.arange(len(at))
    all_words, rows_left = dict(words), {c: np.arange(len(at)) for c, at in left.items()}

    def hits(i):
        """Members left that member `i` can be similar to; they are no longer left."""
        own = int(cells[i])
        mine = all_words[own][row_of[i]]
        for c in (own // 2, own, own * 2):
            if c not in left or not len(left[c]):
                continue
            rows = folded[c][rows_left[c]] if c > own else words[c][rows_left[c]]
            differ = np.bitwise_count(rows ^ (fold(mine) if c < own else mine))
            differ = differ.sum(axis=1, dtype=np.int64)
            both = sizes[i] + sizes[left[c]]
            near = differ * (100 + percent) <= both * (100 - percent)
            near &= 100 * np.minimum(sizes[i], sizes[left[c]]) >= percent * np.maximum(
                sizes[i], sizes[left[c]]
            )
            if near.any():
                yield from left[c][near].tolist()
                left[c], rows_left[c] = left[c][~near], rows_left[c][~near]

    done = []
    for c in left:
        while len(left[c]):
            part = [int(left[c][0])]
            left[c], rows_left[c] = left[c][1:], rows_left[c][1:]
            for i in part:
                part += list(hits(i))
            done.append(part)
    return done


def bucket_edges(percent: int):
    """Edges (a, b) from the other members of a part to its smallest one, for rows (signature,
    doc_id, size, sketch) in order of the signature. A member without a sketch can be similar to
    any other."""

    def of(ids, sizes, found):
        whole = any(x is None for x in found)
        for part in [range(len(ids))] if whole else parts(sizes, found, percent):
            own = [ids[i] for i in part]
            least = min(own)
            yield from ((x, least) for x in own if x != least)

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            signature = rows["signature"].to_numpy()
            starts = np.flatnonzero(signature[1:] != signature[:-1]) + 1
            last = int(starts[-1]) if len(starts) else 0
            held = rows.slice(last)
            yield from edges(rows.slice(0, last), [0, *starts.tolist()])
        if held is not None:
            yield from edges(held, [0, held.num_rows])

    def edges(rows, bounds):
        ids, sizes, found = (rows[c].to_pylist() for c in ("doc_id", "size", "sketch"))
        out = [
            edge
            for a, b in zip(bounds[:-1], bounds[1:], strict=True)
            for edge in of(ids[a:b], sizes[a:b], found[a:b])
        ]
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return run
