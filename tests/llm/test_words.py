from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlgrain.llm import words as W

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\x0b\x1c\xa0,", max_size=30)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_words_are_those_of_the_pattern(texts):
    w = W.split(pa.array(texts, pa.string()))
    got = [w.buf[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)]
    want = [(i, x) for i, t in enumerate(texts) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert list(zip(w.doc.tolist(), got, strict=True)) == want
    h = w.hashes()[0]
    assert len({*h.tolist()}) == len({x for _, x in want})


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(1, 4))
def test_windows_are_equal_where_words_are(texts, size):
    w = W.split(pa.array(texts, pa.string()))
    got = [w.buf[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
    at, h = W.windows(w.hashes()[0], w.doc, size)
    want = [i for i in range(len(got) - size + 1) if len({*w.doc[i : i + size].tolist()}) == 1]
    assert at.tolist() == want
    assert len({*h.tolist()}) == len({tuple(got[i : i + size]) for i in want})


def test_prefix_hashes_and_long_words():
    w = W.split(pa.array(["abcdef abcxyz ab " + "x" * (3 << 20)]))
    _, three = w.hashes(1, (3,))
    assert three[0] == three[1] and three[2] == 0 and three[3] != 0


def test_cover_and_portions():
    assert W.cover(6, np.array([1, 2]), 2).tolist() == [False, True, True, True, False, False]
    texts = pa.array(["a" * 5, None, "b" * 9, "", "c"])
    assert [*W.portions(texts, 6)] == [(0, 2), (2, 1), (3, 2)]
    assert [*W.portions(texts.slice(0, 0), 6)] == []
