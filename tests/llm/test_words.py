import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from bondflow.llm import decontaminate, textops

TEXT = st.text(alphabet="aAb zé中\n\t.,0!", max_size=60)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    column = pa.array(texts, pa.string())
    found = []
    for _, _, data, at in textops.blocks(column, 40):
        w = textops.Words(data, at, textops.NOT_SPACE)
        h = w.hashes()
        assert len(h) == len(w)
        raw = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
        found += [raw[a:b] for a, b in zip(w.at[:-1], w.at[1:], strict=True)]
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in lower]


def test_hashes_depend_on_the_word_alone():
    x = pa.array(["Ab", "x" * 100 + " ab", None, "", "ab", "x" * 100])
    data, at = textops.raw(x)
    h = textops.Words(data, at, textops.NOT_SPACE).hashes()
    assert h[0] == h[2] == h[3] and h[1] == h[4] and h[0] != h[1]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 6))
def test_winnow_keeps_the_rightmost_least_of_each_window(values, window):
    h = np.array(values, np.uint64)
    kept = decontaminate.winnow(h, np.array([0, len(h)]), window)
    expected = set()
    for i in range(len(h) - window + 1):
        part = values[i : i + window]
        expected.add(i + max(j for j, v in enumerate(part) if v == min(part)))
    assert kept.tolist() == sorted(expected)
