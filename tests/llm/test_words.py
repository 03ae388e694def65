"""Words hashed in pieces and texts in blocks, whatever their sizes."""

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import common

TEXTS = ["one two  three", "", None, "x" * 5000 + " y", " \t\n", "naïve ONE", "a" * 300]


def hashes(most: int) -> list[list[int]]:
    found = []
    for _, _, data, offsets in common.text_blocks(pa.array(TEXTS), most):
        w = common.Words(data, offsets)
        found += [w.hash[a:b].tolist() for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    return found


@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 17])
@pytest.mark.parametrize("most", [1, 20, 1 << 20])
def test_words_do_not_depend_on_pieces_or_blocks(monkeypatch, piece, most):
    whole = hashes(1 << 30)
    monkeypatch.setattr(common, "PIECE", piece)
    assert hashes(most) == whole
    assert [len(w) for w in whole] == [3, 0, 0, 2, 0, 2, 1]
    assert whole[0][0] == whole[5][1]  # A-Z count as a-z


def test_blocks_cover_every_row_once():
    at = 0
    for a, b, data, offsets in common.text_blocks(pa.array(TEXTS).slice(1), 10):
        assert a == at and len(offsets) == b - a + 1 and offsets[0] == 0
        assert [bytes(data[x:y]).decode() for x, y in zip(offsets[:-1], offsets[1:], strict=True)] == [t or "" for t in TEXTS[1:][a:b]]
        at = b
    assert at == len(TEXTS) - 1
    assert list(common.text_blocks(pa.array([], pa.string()))) == []
    assert np.array_equal(common.row_bounds(pa.array([], pa.string()), 5), [0])
