import string

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.text import grams, words

LATIN = "abczABCZ09 \n\t.,!-'éÉñÑçß×"


def plain(text):
    """The documented definition of a word, spelled out."""
    out = []
    for w in "".join(c if ord(c) > 32 else " " for c in text).split(" "):
        w = "".join(c.lower() if ord(c) < 128 or (0xC0 <= ord(c) <= 0xDE and ord(c) != 0xD7) else c for c in w)
        w = "".join(c for c in w if c not in string.punctuation and c != "\x7f")
        if w:
            out.append(w)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=LATIN, max_size=40), max_size=6))
def test_words_match_definition(texts):
    w = words(pa.array(texts, pa.string()))
    known = {}
    for i, t in enumerate(texts):
        got = w.hash[w.first[i] : w.first[i + 1]].tolist()
        want = plain(t)
        assert len(got) == len(want)
        for a, b in zip(want, got):
            assert known.setdefault(a, b) == b
    assert len(set(known.values())) == len(known)


def test_slices_and_nulls_agree():
    texts = ["a b c", None, "", "d e", "x" * 5000 + " y", "É é"]
    whole = words(pa.array(texts))
    part = words(pa.array(texts).slice(3, 3))
    assert whole.hash[whole.first[3] :].tolist() == part.hash.tolist()
    assert whole.counts.tolist() == [3, 0, 0, 2, 2, 2]


def test_grams_stay_inside_documents():
    w = words(pa.array(["a b c", "a b", "c"]))
    h, at = grams(w, 2)
    assert at.tolist() == [0, 1, 3]
    assert h[0] == h[2] and len(np.unique(h)) == 2
