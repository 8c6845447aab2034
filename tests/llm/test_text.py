import numpy as np
import pyarrow as pa
import pytest

from wardlens.llm.text import BLANK, gram_hashes, parts, range_hashes, runs, slices, utf8


def test_null_sliced_and_wide_columns():
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["skipped", "ab", None, "", "é"], kind).slice(1)
        data, starts = utf8(column)
        assert data.tobytes() == "abé".encode() and starts.tolist() == [0, 2, 2, 2, 4]
    assert utf8(pa.array([], pa.string()))[1].tolist() == [0]
    assert utf8(pa.array([None, None], pa.string()))[1].tolist() == [0, 0, 0]


def test_slices_cover_all_rows_once():
    starts = np.array([0, 5, 5, 30, 31, 31])
    assert list(slices(starts, 6)) == [(0, 2), (2, 3), (3, 5)]


def test_equal_ranges_hash_alike_wherever_they_stand():
    texts = ["one two  one", "", "two\none two", "x" * (1 << 20) + " one two"]
    seen = {}
    for low, _, data, starts in parts(pa.array(texts)):
        begin, end, row = runs(~BLANK[data], starts)
        raw = data.tobytes()
        for a, b, r, h in zip(begin, end, row, range_hashes(data, begin, end), strict=True):
            assert raw[a:b].decode() in texts[low + r].split()
            assert seen.setdefault(raw[a:b], h) == h
    assert len(set(seen.values())) == len(seen) == 3


@pytest.mark.parametrize("n", [1, 2, 5])
def test_grams_stay_inside_rows(n):
    word, row = np.arange(9, dtype=np.uint64), np.array([0, 0, 0, 1, 3, 3, 3, 3, 3])
    _, at = gram_hashes(word, row, n)
    assert at.tolist() == [k for k in range(9) if k + n <= 9 and row[k] == row[k + n - 1]]
