import random

import numpy as np
import pyarrow as pa
import pytest

from reclutark.llm import common


def hashed(texts, lower=False):
    data, offsets = common.texts_of(pa.array(texts))
    hashes, counts = common.word_hashes(data, offsets, lower)
    assert len(hashes) == counts.sum()
    return [h.tolist() for h in np.split(hashes, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("at_once", [1 << 22, 64, 9, 2])
def test_equal_words_alone_have_equal_hashes(monkeypatch, at_once):
    monkeypatch.setattr(common, "HASHED_AT_ONCE", at_once)
    common._powers.cache_clear()
    rnd = random.Random(at_once)
    texts = ["", None, " ", "a", "ab ba", "\tab\nba\x0bab\x0cx\ry ", "é ñ \x85 　x", "ab", "a" * 30 + " b", "x" * 100]
    texts += ["".join(rnd.choice("ab \n") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    known, words = {}, [(t or "").encode().split() for t in texts]
    for found, want in zip(hashed(texts), words):
        assert len(found) == len(want)
        assert all(known.setdefault(w, h) == h for w, h in zip(want, found))
    assert len(set(known.values())) == len(known)
    common._powers.cache_clear()


def test_slices_small_letters_and_no_texts():
    whole = pa.array(["zz top", None, "One TWO", "one two", "ÑU ñU"])
    data, offsets = common.texts_of(whole.slice(2, 3))
    hashes, counts = common.word_hashes(data, offsets, True)
    assert counts.tolist() == [2, 2, 2] and hashes[:2].tolist() == hashes[2:4].tolist() and hashes[4] != hashes[5]
    assert hashed(["One TWO", "one two"])[0] != hashed(["One TWO", "one two"])[1]
    data, offsets = common.texts_of(pa.array([], pa.string()))
    assert [x.tolist() for x in common.word_hashes(data, offsets)] == [[], []]


def test_many_words_have_many_hashes():
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in range(3000)]
    assert len(set(hashed([" ".join(words)])[0])) == len(words)
