import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.text import BLOCK, blocks, run_hashes, sliding, window_hashes, word_bounds

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b漢", max_size=30)), max_size=8)


@settings(max_examples=100, deadline=None)
@given(texts)
def test_words_and_hashes(rows):
    seen = {}
    for a, b, data, offs in blocks(pa.array(rows, pa.string())):
        starts, ends, first = word_bounds(data, offs)
        hashes = run_hashes(data, starts, ends)
        raw = data.tobytes()
        for i in range(b - a):
            own = slice(first[i], first[i + 1])
            words = [raw[s:e] for s, e in zip(starts[own], ends[own])]
            assert words == (rows[a + i] or "").encode().split()
            for w, h in zip(words, hashes[own]):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_a_long_text_is_a_block_of_its_own():
    rows = ["x", "y " * BLOCK, "z"]
    assert [(a, b) for a, b, _, _ in blocks(pa.array(rows))] == [(0, 1), (1, 2), (2, 3)]
    assert [x[:2] for x in blocks(pa.array(rows, pa.large_string()).slice(1))] == [(0, 1), (1, 2)]
    assert list(blocks(pa.array([], pa.string()))) == []


@given(st.lists(st.integers(0, 9), max_size=20), st.integers(1, 8))
def test_sliding(values, width):
    got = sliding(np.array(values, np.uint64), width)
    assert got.tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


def twins(doublings):
    """A word and its letter-swapped twin, equal under every sum of products with powers modulo 2**64."""
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@settings(max_examples=20, deadline=None)
@given(st.integers(5, 13), st.integers(0, 3))
def test_repetitive_words_do_not_collide(doublings, seed):
    data = np.frombuffer(" ".join(twins(doublings)).encode(), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    x, y = run_hashes(data, starts, ends, seed)
    assert x != y
    a, b = (window_hashes(np.frombuffer(t.encode(), np.uint8), 2**doublings, seed) for t in twins(doublings))
    assert len(a) == len(b) == 1 and a[0] != b[0]


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 12))
def test_window_hashes(values, width):
    got = window_hashes(np.array(values, np.uint64), width)
    runs = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert len(got) == len(runs)
    assert len(set(got.tolist())) == len(set(runs)) == len(set(zip(runs, got.tolist())))
