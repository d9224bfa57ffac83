"""Packing and piece coding against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import packing, piece_codec
from harrow.llm.catalog import vocabulary

ALPHABET = " ▁\n\t ab<s>é漢😀​ Σ'1.,!|<>SÀÿ×\x0b\x1c"


@pytest.fixture(scope="module")
def pieces():
    return piece_codec.ChunkTable(vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(vocabulary("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=30))
def test_pieces_are_the_librarys(pieces, text):
    want = pieces.model.encode(text)
    [(ids, decoded)] = pieces.code([text])
    assert ids == ",".join(map(str, want)) and decoded == pieces.model.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=30))
def test_words_are_the_librarys(words, text):
    assert words.of([text]) == [np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_digest_of_odd_documents(spark, odd_docs, no_docs, pieces):
    got = piece_codec.encoding_digest(odd_docs, vocabulary("piece_bpe_32k.model")).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got}
    for row in odd_docs.collect():
        ids = pieces.model.encode(row.text or "")
        if row.doc_id is not None and row.doc_id != 3:
            assert by_id[row.doc_id].n_tokens == len(ids)
            assert by_id[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert piece_codec.encoding_digest(no_docs, vocabulary("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_is_gapless_and_whole(odd_docs, words, capacity):
    rows = packing.pack_documents(odd_docs, vocabulary("word_bpe_49k.json"), capacity).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= capacity
    want = []
    for d in odd_docs.collect():
        ids = words.tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            want.append((d.doc_id, k // capacity, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs, vocabulary("word_bpe_49k.json")).count() == 0


def _least(sizes, capacity):
    """Fewest sequences, by trying all first fits of the longest piece."""
    best = [len(sizes)]

    def place(left, rooms):
        if len(rooms) >= best[0]:
            return
        if not left:
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= left[0] and rooms[k] not in rooms[:k]:
                place(left[1:], rooms[:k] + [rooms[k] - left[0]] + rooms[k + 1 :])
        place(left[1:], rooms + [capacity - left[0]])

    place(sorted(sizes, reverse=True), [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rnd = random.Random(3)
    for _ in range(150):
        sizes = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
        counts = {s: sizes.count(s) for s in sizes}
        fixed, rest = packing.reduce_dominated(counts, 20)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (_least(left, 20) if left else 0) == _least(sizes, 20)
        assert sum(sum(p) * n for p, n in fixed) + sum(left) == sum(sizes)
