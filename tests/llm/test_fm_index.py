import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import words as W
from siftwell.llm.fm_index import FMIndex, suffix_order


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_search_and_locate(symbols, pattern):
    text = np.array([*symbols, 0])
    index = FMIndex(text.copy(), 3, sample=4)
    low, high = index.search(np.array([pattern]))
    want = [k for k in range(len(text)) if text[k : k + len(pattern)].tolist() == pattern]
    assert sorted(index.locate(np.arange(low[0], high[0]))) == want


def test_suffix_order_of_repeats():
    text = np.array([1, 2, 1, 2, 1, 2, 0, 1, 2, 1, 2, 0])
    order, _ = suffix_order(text)
    rank = {k: r for r, k in enumerate(np.flatnonzero(text == 0))}
    key = lambda k: [(1, v) if v else (0, rank[k + j]) for j, v in enumerate(text[k:])]
    cut = lambda k: key(k)[: [v for v, _ in key(k)].index(0) + 1]
    assert order.tolist() == sorted(range(len(text)), key=cut)


def test_large_alphabet_takes_the_other_sort():
    from siftwell.llm import fm_index

    text = np.random.default_rng(0).integers(1, 50, 500)
    text[-1] = 0
    plain, _ = suffix_order(text)
    old, fm_index._FIELD = fm_index._FIELD, 4
    try:
        other, _ = suffix_order(text)
    finally:
        fm_index._FIELD = old
    assert plain.tolist() == other.tolist()


@pytest.mark.parametrize("lower", [False, True])
def test_split_words(lower):
    from .helpers import DOCS, words2, words7

    texts = [t for _, t in DOCS]
    got = W.split_words(pa.array(texts), W.ALNUM if lower else W.NON_SPACE, lower=lower)
    vocabulary = [w.decode() for w in got.distinct.to_pylist()]
    want = [(words2 if lower else words7)(t) for t in texts]
    assert [[vocabulary[k] for k in got.ids[a:b]] for a, b in zip(got.first[:-1], got.first[1:], strict=True)] == want


def test_no_texts():
    got = W.split_words(pa.array([], pa.string()), W.ALNUM)
    assert got.n == 0 and len(got.first) == 1


@given(st.lists(st.integers(0, 2**63), min_size=0, max_size=40), st.integers(1, 9))
@settings(deadline=None)
def test_sliding_min(values, w):
    got = W.sliding_min(np.array(values, np.uint64), w)
    assert got.tolist() == [min(values[k : k + w]) for k in range(len(values) - w + 1)]
