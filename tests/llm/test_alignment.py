import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import documents, empty, frame
from tokenizers import Tokenizer

from paperlake.llm import alignment

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  x", "x  ", "\t\nx \r\n ", "don't we'll 'sorry", "a  b   c    d", "ﬁ Ａ １２", "▁x", "a ▁ b",
    "<s>hi</s> <|endoftext|> <unk> <0x41>", "é日本語😀 русский текст, ελληνικά", "\x00 \x01a\x85b\x1cc　d\xa0e",
    "#tag @name $5.00 100% (a) [b] {c}", "é" * 300, "ab" * 5000, "long " * 8000, "​ x́y",
    "  #x  1  é  ж", "x 　 y", "word  word", "a \t b\t c", "٣٤٥ ५६ Ⅷ ²",
]


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    value = {v: k for k, v in alignment._byte_values().items()}
    of = {c: k for k, c in value.items()}
    documents_of, found = Counter(), []
    for doc_id, text in rows:
        whole = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = []
        for i in ids_b:
            p = b.id_to_piece(i)
            bytes_b.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        owner = []
        for i, p in enumerate(bytes_b):
            owner += [i] * len(p)
        linked, at = [], 0
        for i, p in enumerate(bytes_a):
            linked += [(ids_a[i], ids_b[j]) for j in sorted(set(owner[at : at + len(p)]))]
            at += len(p)
        documents_of.update(set(linked))
        cuts_a = np.cumsum([0, *map(len, bytes_a)]).tolist()
        cuts_b = np.cumsum([0, *map(len, bytes_b)]).tolist()
        both = sorted(set(cuts_a) & set(cuts_b))
        groups = []
        for start, end in zip(both[:-1], both[1:], strict=True):
            parts = []
            for ids, cuts in ((ids_a, cuts_a), (ids_b, cuts_b)):
                parts.append(",".join(str(ids[i]) for i in range(cuts.index(start), cuts.index(end))))
            groups.append("|".join(parts))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((doc_id, len(ids_a), len(ids_b), len(groups), linked, digest))
    highest = defaultdict(int)
    for (i, _), n in documents_of.items():
        highest[i] = max(highest[i], n)
    return sorted(
        str((d, n_a, n_b, n_groups, len(linked),
             sum(documents_of[p] == highest[p[0]] for p in linked),
             sum(documents_of[p] for p in linked), digest))
        for d, n_a, n_b, n_groups, linked, digest in found
    )


def found(table, **more):
    out = alignment.align(table, A, B, **more)
    assert out.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted(str(tuple(r)) for r in out.collect())


def given():
    rows = documents() + [(4000 + i, text) for i, text in enumerate(ODD)]
    return rows + [(4000, "hot copy of some words"), (None, "no id"), (None, None)] + [
        (5000 + i, "hot copy of some words") for i in range(50)
    ]


@pytest.mark.parametrize("block", [1, 3000, alignment.BLOCK])
def test_matches_brute_force_at_any_size_of_blocks(spark, block):
    rows = given()
    assert found(frame(spark, rows), block=block) == brute(rows)


def test_no_rows_and_no_tokens(spark):
    assert found(empty(spark)) == []
    rows = [(1, None), (2, ""), (3, "▁"), (None, None)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == sorted(str((d, 0, 0, 0, 0, 0, 0, "")) for d, _ in rows)


def test_words_give_the_tokenizers_own_ids(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 300)
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    texts = [text for _, text in given() if text and "▁" not in text]
    for words, whole in (
        (alignment.byte_level(A), lambda t: a.encode(" " + t, add_special_tokens=False).ids),
        (alignment.sentence_pieces(B), b.encode),
    ):
        for some in (texts, texts[::-1], texts[::7]):
            ids, offsets, right = words.tokens([" " + text for text in some])
            assert right.all()
            for text, i, j in zip(some, offsets[:-1], offsets[1:], strict=True):
                assert ids[i:j].tolist() == whole(text)


def test_new_words_are_given_to_a_together_and_texts_split_once():
    a, b = alignment.byte_level(A), alignment.sentence_pieces(B)
    texts = [" plain words, here", " two  spaces", " русский текст", " end ", " x"]
    of_a, of_b = alignment.words_of(a, b, texts)
    assert [x is y for x, y in zip(of_a, of_b, strict=True)] == [True, False, False, False, True]
    assert of_b[1:4] == [b.split(text) for text in texts[1:4]]
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    words = [" plain", "no space", " é\n", "", " русский", " <s>", " x" * 3, "  two", " a  "]
    ids, sizes = a.encode(words)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for word, i, j in zip(words, bounds[:-1], bounds[1:], strict=True):
        assert ids[i:j].tolist() == whole.encode(word, add_special_tokens=False).ids
    assert a._not_given_back(words, ids, sizes) == []
    assert b._not_given_back([" a", " ▁", " c"], *b.encode([" a", " ▁", " c"])) == [1]


def test_marks_and_ids_are_written_one_after_the_other():
    written, at = alignment._written(np.array([0, 1, 2, 3, 0]), np.array([7, 40, 0, 999, 12]), 1000)
    assert [bytes(written[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)] == [
        b"7", b",40", b"|0", b";999", b"12"
    ]
    assert alignment._written(np.array([], int), np.array([], int), 10)[1].tolist() == [0]


def test_intervals_coalesce_where_a_start_reaches_the_largest_end():
    a, b = np.array([0, 2, 5, 6, 9]), np.array([0, 1, 5, 8, 9])
    order, group = alignment.coalesce(a[:-1], a[1:], b[:-1], b[1:])
    assert order.tolist() == [0, 4, 5, 1, 2, 6, 3, 7]
    assert group.tolist() == [0, 0, 0, 0, 1, 1, 1, 1]
    pairs = alignment.overlaps(a[:-1], a[1:], b[:-1], b[1:])
    assert list(zip(*(p.tolist() for p in pairs), strict=True)) == [
        (0, 0), (0, 1), (1, 1), (2, 2), (3, 2), (3, 3)
    ]
