"""Alignment of two tokenizers' tokens, and how usual each linked pair of ids is in the corpus.

Both tokenizers cut the same bytes, a space and the text. Tokens are intervals of bytes: all of
them are sorted by start, the largest end so far is accumulated, and a group of tokens ends where a
start reaches it (interval coalescing). Tokens of a group whose intervals overlap are linked. All
texts of a slice are aligned at once in numpy, one after another on one axis of bytes.

A pair's count is the number of documents that hold it linked. Giving each document's pairs their
counts by a join would move several times the text, so documents are taken in blocks of some
`BLOCK` bytes: a block names each of its pairs once, links refer to them by number, and only the
blocks' pairs are joined with the counts. Texts are tokenized once; the links are a written table,
moved once to meet their block's counts. A pair that every document holds is one row per block.

Tokenizers are asked for words only: A cuts texts before any space that a letter, digit or sign
follows, and B has no piece with a space inside or at its end (checked when it is loaded), so what
stands between such cuts is encoded on its own, once per worker as long as it is remembered. New words
go to A joined, as it cuts them again: their bytes tell which ids are whose. Where all spaces of a text
are such cuts, both have the same words, and it is split once.

Defined cases: a text that is null or empty, or that either tokenizer does not give back byte by
byte (B turns U+2581 into a space), has no tokens: zeros and an empty digest, and it is in no
count. Each row is a document of its own, also where rows repeat; a null `doc_id` is kept; further
columns are ignored; an empty table gives no rows. A text of any length is one row of one block.
"""

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.session import cut

from . import hashing
from .held import held
from .packing import _Pool as Pool

BLOCK = 4 << 20
SLICE_BYTES = 1 << 18
"""Bytes of texts that are aligned together."""
KEPT = 4 << 20
"""Characters of the words whose ids a worker remembers, per tokenizer."""
MARKS = b" ,|;"
"""What stands before a token's id: nothing at the start of a text, else one of the others."""

_CUT = re.compile("(?= [!-~À-ÖØ-öø-ÿ])")
_SPACES = re.compile(" +[^ ]*")


class Words:
    """Token ids of texts, word by word, with the words' ids remembered.

    `split` cuts a text into words that the tokenizer never joins, `encode` gives a list of words
    all their ids and each word's number of them, and `pieces` has each id's bytes. A word that its
    tokens do not give back is remembered as such.
    """

    def __init__(self, split, encode, pieces):
        self.split, self.encode, self.pieces = split, encode, pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known, self.wrong, self.length = Pool(), set(), 0

    def _learn(self, words: list[str]) -> None:
        ids, sizes = self.encode(words)
        first = self.known.count
        self.wrong.update(first + i for i in self._not_given_back(words, ids, sizes))
        self.known.add(words, ids, sizes)
        self.length += sum(map(len, words))

    def _not_given_back(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> list[int]:
        """The words that are not the bytes of their ids."""
        given = [self.pieces[i] for i in ids.tolist()]
        ends = np.cumsum(sizes)
        lengths = np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends]
        if b"".join(given) == "".join(words).encode() and (lengths == byte_ends(words)).all():
            return []
        bounds = [0, *ends.tolist()]
        return [
            i for i, word in enumerate(words)
            if b"".join(given[bounds[i] : bounds[i + 1]]) != word.encode()
        ]

    def tokens(self, texts: list[str], split: list[list[str]] | None = None):
        """All ids of the texts, the texts' offsets among them, and whether each text is given
        back. `split` has the texts' words, if they are known."""
        if self.length > KEPT:
            self._forget()
        split = split or [self.split(text) for text in texts]
        words = list(chain.from_iterable(split))
        find = self.known.place.get
        places = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            places[missing] = np.fromiter(map(find, new), np.int64, len(new))
        ids, sizes = self.known.gather(places)
        rows = np.cumsum([0, *map(len, split)])
        offsets = np.concatenate([[0], np.cumsum(sizes)])[rows]
        if not self.wrong:
            return ids.astype(np.int64), offsets, np.ones(len(texts), bool)
        bad = np.isin(places, np.fromiter(self.wrong, np.int64, len(self.wrong)))
        before = np.concatenate([[0], np.cumsum(bad)])[rows]
        return ids.astype(np.int64), offsets, np.diff(before) == 0


def byte_ends(words: list[str]) -> np.ndarray:
    """Where each word ends in the bytes of all of them."""
    plain = "".join(words).isascii()
    lengths = map(len, words if plain else map(str.encode, words))
    return np.cumsum(np.fromiter(lengths, np.int64, len(words)))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the lists, and each list's number of them."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: those that can be shown
    stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level(path: str) -> Words:
    """Tokenizer A, of a byte-level vocabulary file; special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    value = _byte_values()
    pieces = [
        bytes(value[c] for c in piece) if all(c in value for c in piece) else piece.encode()
        for piece in map(tokenizer.id_to_token, range(tokenizer.get_vocab_size()))
    ]

    lengths = np.array([len(p) for p in pieces], np.int64)

    def alone(words):
        return _flat(
            [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        )

    def encode(words):
        # What follows a word that is not a cut's, such as a text's first, could belong to it.
        if not all(map(_CUT.match, words)):
            cut_off = np.fromiter((bool(_CUT.match(w)) for w in words), bool, len(words))
            odd = np.flatnonzero(~cut_off)
            odd_ids, odd_sizes = alone([words[i] for i in odd.tolist()])
            ids, some = encode([words[i] for i in np.flatnonzero(cut_off).tolist()])
            sizes = np.zeros(len(words), np.int64)
            sizes[odd], sizes[cut_off] = odd_sizes, some
            all_ids = np.empty(int(sizes.sum()), np.uint32)
            of_odd = np.repeat(~cut_off, sizes)
            all_ids[of_odd], all_ids[~of_odd] = odd_ids, ids
            return all_ids, sizes
        ids, _ = alone(["".join(words)])
        ends, wanted = np.cumsum(lengths[ids]), byte_ends(words)
        last = np.searchsorted(ends, wanted)
        if len(ends) and last[-1] == len(ends) - 1 and (ends[last] == wanted).all():
            return ids, np.diff(last, prepend=-1)
        return alone(words)

    return Words(_CUT.split, encode, pieces)


def sentence_pieces(path: str) -> Words:
    """Tokenizer B, of a sentence-piece model that puts a space before each text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    shown = [model.id_to_piece(i) for i in range(model.vocab_size())]
    if any("▁" in piece.lstrip("▁") for piece in shown):
        raise ValueError("a piece holds a space after another character")
    alone = model.piece_to_id("▁")
    pieces = [
        bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        for i, piece in enumerate(shown)
    ]

    def encode(words):
        lists = model.encode([word[1:] for word in words], num_threads=1)
        return _flat(
            [ids if word != " " else [alone] for word, ids in zip(words, lists, strict=True)]
        )

    return Words(_SPACES.findall, encode, pieces)


def words_of(a: Words, b: Words, texts: list[str]):
    """The texts' words for A and for B. Where A cuts at each space, B cuts at the same places."""
    of_a = [a.split(text) for text in texts]
    of_b = [
        words if len(words) == text.count(" ") + 1 else b.split(text)
        for words, text in zip(of_a, texts, strict=True)
    ]
    return of_a, of_b


def coalesce(starts_a, ends_a, starts_b, ends_b):
    """The tokens of both sides in order of their starts, as indexes into A followed by B, and the
    number of each token's group."""
    starts = np.concatenate([starts_a, starts_b])
    ends = np.concatenate([ends_a, ends_b])
    side = np.repeat(np.array([0, 1], np.int8), [len(starts_a), len(starts_b)])
    order = np.lexsort((side, starts))
    reached = np.maximum.accumulate(ends[order])
    new = np.ones(len(order), bool)
    new[1:] = starts[order][1:] >= reached[:-1]
    return order, np.cumsum(new) - 1


def overlaps(starts_a, ends_a, starts_b, ends_b):
    """All pairs of tokens (index into A, index into B) whose intervals overlap, by A."""
    first = np.searchsorted(ends_b, starts_a, "right")
    count = np.searchsorted(starts_b, ends_a, "left") - first
    a = np.repeat(np.arange(len(starts_a)), count)
    return a, np.arange(len(a)) + np.repeat(first - (np.cumsum(count) - count), count)


def _selected(ids, offsets, kept):
    """The ids of the kept texts, and the number of ids of every text."""
    counts = np.where(kept, np.diff(offsets), 0)
    return ids[np.repeat(kept, np.diff(offsets))], counts


class Aligned:
    """The aligned tokens of some texts, as arrays over all of them."""

    def __init__(self, a: Words, b: Words, texts: list[str]):
        spaced = [" " + text if text else "" for text in texts]
        of_a, of_b = words_of(a, b, spaced)
        ids_a, rows_a, right_a = a.tokens(spaced, of_a)
        ids_b, rows_b, right_b = b.tokens(spaced, of_b)
        kept = right_a & right_b
        self.ids_a, self.n_a = _selected(ids_a, rows_a, kept)
        self.ids_b, self.n_b = _selected(ids_b, rows_b, kept)
        ends_a, ends_b = np.cumsum(a.sizes[self.ids_a]), np.cumsum(b.sizes[self.ids_b])
        spans = ends_a - a.sizes[self.ids_a], ends_a, ends_b - b.sizes[self.ids_b], ends_b
        self.order, self.group = coalesce(*spans)
        self.link_a, self.link_b = overlaps(*spans)
        self.width = len(b.pieces)
        self.pair_span = len(a.pieces) * self.width
        self.pair_type = np.uint32 if self.pair_span <= 1 << 32 else np.int64
        self.ids = max(len(a.pieces), len(b.pieces))
        self.count = len(texts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each link's pair of ids as one number, and its text."""
        text = np.repeat(np.arange(self.count), self.n_a)[self.link_a]
        pairs = self.ids_a[self.link_a] * self.width + self.ids_b[self.link_b]
        return pairs.astype(self.pair_type), text

    def groups(self) -> tuple[np.ndarray, list[str]]:
        """Each text's number of groups, and the SHA-256 of its groups; empty without tokens."""
        order, group = self.order, self.group
        tokens = self.n_a + self.n_b
        ends = np.cumsum(tokens)
        second = order >= len(self.ids_a)
        first_of_group = np.ones(len(order), bool)
        first_of_group[1:] = group[1:] != group[:-1]
        text = np.repeat(np.arange(self.count), tokens)
        n_groups = np.bincount(text[first_of_group], minlength=self.count)
        # Within a group A's tokens come first.
        shown = np.lexsort((second, group))
        ids = np.concatenate([self.ids_a, self.ids_b])[order[shown]]
        second, group = second[shown], group[shown]
        mark = np.zeros(len(ids), np.int64)
        mark[1:] = np.where(group[1:] != group[:-1], 3, np.where(second[1:] != second[:-1], 2, 1))
        mark[(ends - tokens)[tokens > 0]] = 0
        written, at = _written(mark, ids, self.ids)
        bounds = at[np.concatenate([[0], ends])].tolist()
        digests = [
            hashlib.sha256(written[i:j]).hexdigest() if j > i else ""
            for i, j in zip(bounds[:-1], bounds[1:], strict=True)
        ]
        return n_groups, digests


@lru_cache(1)
def _decimals(count: int) -> pa.Array:
    """Each mark followed by each number below `count`; the first mark is nothing."""
    marks = ["", *(chr(mark) for mark in MARKS[1:])]
    return pa.array([f"{mark}{i}".encode() for mark in marks for i in range(count)], pa.large_binary())


def _written(mark: np.ndarray, ids: np.ndarray, count: int) -> tuple[memoryview, np.ndarray]:
    """The marks and decimal ids, all below `count`, one after the other, and where each starts, with
    the end; no mark for 0."""
    taken = _decimals(count).take(pa.array(mark * count + ids))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    return memoryview(data if data is not None else b""), at


_COLUMNS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, pairs array<long>, docs array<int>"
_FIELDS = pa.schema(
    [
        *((c, pa.int64()) for c in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links")),
        ("groups_sha256", pa.string()),
        ("links", pa.list_(pa.int32())),
        ("pairs", pa.list_(pa.int64())),
        ("docs", pa.list_(pa.int32())),
    ]
)


class _Block:
    """The documents of one block, until it is full."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.rows, self.links, self.counts = [], [], []
        self.pairs = []

    def add(self, doc_ids, aligned: Aligned, size: int) -> None:
        pairs, text = aligned.pairs()
        n_links = np.bincount(text, minlength=aligned.count)
        n_groups, digests = aligned.groups()
        self.rows.append((doc_ids, aligned.n_a, aligned.n_b, n_groups, n_links, digests))
        self.links.append(pairs)
        each = np.sort(text * aligned.pair_span + pairs)
        new = np.ones(len(each), bool)
        new[1:] = each[1:] != each[:-1]
        self.pairs.append((each[new] % aligned.pair_span).astype(pairs.dtype))
        self.size += size

    def batches(self):
        """Rows of documents, then one row that names the block's pairs and their documents."""
        pairs, docs = np.unique(np.concatenate(self.pairs), return_counts=True)
        for (doc_ids, n_a, n_b, n_groups, n_links, digests), links in zip(
            self.rows, self.links, strict=True
        ):
            numbers = np.searchsorted(pairs, links).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)
            columns = [np.full(len(n_a), self.number), n_a, n_b, n_groups, n_links]
            block, *counts = (pa.array(c.astype(np.int64)) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [
                    block, doc_ids, *counts, pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers)),
                    pa.nulls(len(n_a), pa.list_(pa.int64())),
                    pa.nulls(len(n_a), pa.list_(pa.int32())),
                ],
                schema=_FIELDS,
            )
        row = {c: [None] for c in _FIELDS.names}
        row |= {"block": [self.number], "pairs": [pairs.astype(np.int64)], "docs": [docs.astype(np.int32)]}
        yield pa.RecordBatch.from_pydict(row, schema=_FIELDS)


def _linked(path_a, path_b, block_size):
    def run(batches):
        a, b = held((path_a, path_b), lambda: (byte_level(path_a), sentence_pieces(path_b)))
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            data, offsets = hashing.text_bytes(batch.column(1))
            first = 0
            while first < batch.num_rows:
                last = np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right") - 1
                last = max(int(last), first + 1)
                bounds = offsets[first : last + 1].tolist()
                texts = [
                    data[i:j].tobytes().decode() for i, j in zip(bounds[:-1], bounds[1:], strict=True)
                ]
                ids = batch.column(0).slice(first, last - first)
                block.add(ids, Aligned(a, b, texts), bounds[-1] - bounds[0])
                first = last
                if block.size >= block_size:
                    yield from block.batches()
                    number += 1
                    block = _Block(number)
        if block.rows:
            yield from block.batches()

    return run


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _weighed(rows: pa.Table, weights: pa.Table) -> pa.Table:
    """The rows of one block with the sums of their links' counts."""
    at = weights["number"].to_numpy()
    counts = np.zeros(len(at) + 1, np.int64)
    counts[at] = weights["n"].to_numpy()
    best = np.zeros(len(at) + 1, np.int64)
    best[at] = weights["best"].to_numpy()
    sums = {"n_best": [], "count_sum": []}
    for batch in rows.to_batches():
        links = batch.column("links")
        numbers = links.flatten().to_numpy()
        ends = np.cumsum(links.value_lengths().to_numpy())
        for name, values in (("n_best", best), ("count_sum", counts)):
            total = np.concatenate([[0], np.cumsum(values[numbers])])
            sums[name].append(np.diff(total[ends], prepend=0))
    out = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for name, parts in sums.items():
        out = out.append_column(name, pa.array(np.concatenate(parts)))
    return out.append_column("groups_sha256", rows["groups_sha256"])


def links(documents: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """The written table of links: a row per document, with its links as numbers of its block's
    pairs, and a row per block, with its pairs and how many documents hold each."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(rows.mapInArrow(_linked(path_a, path_b, block), _COLUMNS), "links")


def pair_counts(linked: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Each block's pairs (block, number, pair), and the corpus's (pair, n, best); `width` is the
    number of B's ids. Both are bounded by the vocabularies, whatever the corpus."""
    named = linked.where("pairs IS NOT NULL").select(
        "block", F.posexplode_outer(F.arrays_zip("pairs", "docs")).alias("number", "x")
    )
    named = named.select("block", "number", "x.pairs", "x.docs").where("pairs IS NOT NULL")
    named = named.withColumnRenamed("pairs", "pair")
    counts = named.groupBy("pair").agg(F.sum("docs").alias("n"))
    counts = counts.withColumn("a", F.floor(F.col("pair") / width))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    counts = counts.join(highest, "a").select(
        "pair", "n", (F.col("n") == F.col("highest")).cast("int").alias("best")
    )
    return named.drop("docs"), counts


def align(documents: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256. The paths name tokenizer files that all executors can read."""
    linked = links(documents, path_a, path_b, block)
    named, counts = pair_counts(linked, vocabulary_size(path_b))
    weights = named.join(counts, "pair").select(
        F.col("block").alias("of_block"), "number", "n", "best"
    )
    rows = linked.where("pairs IS NULL").drop("pairs", "docs")
    both = rows.groupBy("block").cogroup(weights.groupBy("of_block"))
    return both.applyInArrow(_weighed, _RESULT)


def vocabulary_size(path: str) -> int:
    """The number of ids of a sentence-piece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
