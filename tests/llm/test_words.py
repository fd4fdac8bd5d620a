"""Vectorised words against a plain regular expression."""

import re

import numpy as np
import pyarrow as pa
import pytest

from cordon.llm import words as w


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


TEXTS = ["", None, "a", " a  B\tc\n", "Écrit À la main", "x" * 50, "one two", "ONE two", "\x1cx y", "end\n\n", "ß ẞ 漢字 漢字"]


def test_words_are_those_of_the_pattern():
    got = {row: h for row, h in w.word_hashes(pa.array(TEXTS, pa.string()))}
    seen = {}
    for row, text in enumerate(TEXTS):
        expected = plain(text)
        assert len(got[row]) == len(expected)
        for word, h in zip(expected, got[row].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("piece", [7, 64])
def test_pieces_change_nothing(monkeypatch, piece):
    texts = [" ".join(f"word{k}" for k in range(40)), "y" * 200 + " z", None, "tail "]
    whole = [h.tolist() for _, h in w.word_hashes(pa.array(texts))]
    monkeypatch.setattr(w, "PIECE", piece)
    assert [h.tolist() for _, h in w.word_hashes(pa.array(texts))] == whole


def test_sliced_column():
    column = pa.array(["skip me", "a b", None, "c"])[1:]
    assert [len(h) for _, h in w.word_hashes(column)] == [2, 0, 1]


def test_shingles_depend_on_order_and_length():
    h = [x for _, x in w.word_hashes(pa.array(["a b c d e", "b a c d e", "a b"]))]
    assert len(w.shingles(h[0], 4)) == 2 and len(w.shingles(h[2], 4)) == 1
    assert not np.intersect1d(w.shingles(h[0], 5), w.shingles(h[1], 5)).size
    assert w.shingles(h[2], 2)[0] == w.shingles(h[0], 2)[0]
