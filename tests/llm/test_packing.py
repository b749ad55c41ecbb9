import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import documents, empty, frame
from tokenizers import Tokenizer

from paperlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "it's DON'T we'll 'S 'LLx", "İstanbul ß ẞ ﬁ", "<|endoftext|> a<|startoftext|>b", "Σας ΣΑΣ",
    "x\xa0y 　z", "é é 1²³ ½ ́abc", "\x1c\x85a b", "日本語 тест", "@@@!!! a_b 12ab",
    "ªº µ×÷", "a" * 3000,
]


def rows():
    found = documents() + [(5000 + i, text) for i, text in enumerate(ODD)]
    rng = random.Random(3)
    found += [(6000 + i, "word " * rng.randrange(1, 5000)) for i in range(30)]
    return found + [(7000, "same text"), (7000, "same text"), (None, "no id")]


def test_ids_equal_the_tokenizers(spark):
    plain = Tokenizer.from_file(PATH)
    own = packing.WordTokenizer(PATH)
    texts = [text or "" for _, text in rows()]
    for _ in range(2):
        for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_pieces_make_up_the_documents(spark):
    plain = Tokenizer.from_file(PATH)
    given = rows()
    out = packing.pack(frame(spark, given), PATH, with_ids=True).collect()
    expected = sorted(
        (str(d), plain.encode(t or "", add_special_tokens=False).ids + [packing.END])
        for d, t in given
    )
    pieces = {}
    for r in out:
        assert r.length == len(r.ids) and r.start % 2048 == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.ids))
    for (doc_id, tokens), parts in pieces.items():
        whole = [ids for d, ids in expected if d == doc_id and len(ids) == tokens]
        flat = [i for _, ids in sorted(parts) for i in ids]
        assert sorted(flat) == sorted(i for ids in whole for i in ids)
    assert sum(r.length for r in out) == sum(len(ids) for _, ids in expected)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))


def test_plan_uses_each_length_as_often_as_counted():
    rng = np.random.default_rng(4)
    histogram = np.zeros(2049, np.int64)
    for length in rng.integers(1, 2049, 20000):
        histogram[length] += 1
    windows = packing.plan(histogram)
    used = np.zeros_like(histogram)
    for lengths, repeats in windows:
        assert sum(lengths) <= 2048 and repeats > 0
        for length in lengths:
            used[length] += repeats
    assert (used == histogram).all()
    tokens = (histogram * np.arange(2049)).sum()
    assert tokens / (2048 * sum(repeats for _, repeats in windows)) > 0.995


@pytest.mark.parametrize("counts", [{}, {1: 5}, {2048: 3}, {1000: 7, 1048: 2}, {1500: 4}])
def test_plan_of_few_lengths(counts):
    histogram = np.zeros(2049, np.int64)
    for length, count in counts.items():
        histogram[length] = count
    windows = packing.plan(histogram)
    assert sum(sum(lengths) * n for lengths, n in windows) == (histogram * np.arange(2049)).sum()


def test_solution_is_near_the_histogram():
    columns = np.array([[6, 4, 0], [5, 5, 0], [8, 2, 0]])
    histogram = np.array([0, 0, 3, 0, 9, 8, 9, 0, 3, 0, 0])
    assert packing.solve(columns, histogram, 2000) == pytest.approx([9, 4, 3], abs=0.01)


def test_empty_table(spark):
    assert packing.pack(empty(spark), PATH).count() == 0


def test_looking_up_a_few_words_copies_no_whole_pool():
    import tracemalloc

    pool = packing._Pool()
    pool.add(range(300_000), np.arange(600_000), np.full(300_000, 2))
    tracemalloc.start()
    ids, sizes = pool.gather(np.array([299_999, 0, 7]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.tolist() == [599_998, 599_999, 0, 1, 14, 15] and sizes.tolist() == [2, 2, 2]
    assert peak < 100_000
    assert [len(x) for x in packing._Pool().gather(np.zeros(0, np.int64))] == [0, 0]
    # A pool grows again after a look-up.
    pool.add(["more"], np.array([5]), np.array([1]))
    assert pool.gather(np.array([300_000]))[0].tolist() == [5]


def test_texts_are_tokenized_in_small_slices(monkeypatch):
    """Besides its words' ids a worker holds the words of some texts only."""
    import pyarrow as pa

    most = []
    encode = packing.WordTokenizer.encode
    monkeypatch.setattr(
        packing.WordTokenizer, "encode",
        lambda self, texts: most.append(sum(map(len, texts))) or encode(self, texts),
    )
    batch = pa.record_batch({"doc_id": list(range(40)), "text": ["some words " * 2000] * 40})
    list(packing._pieces(PATH, 2048, False)(iter([batch])))
    assert sum(most) == 40 * 22000 and max(most) <= packing.SLICE_BYTES < sum(most)


def test_a_worker_keeps_one_thing():
    from paperlake.llm.held import held, release

    release()
    first = held("a", list)
    assert held("a", list) is first
    held("b", dict)
    assert held("a", list) is not first
    release()
