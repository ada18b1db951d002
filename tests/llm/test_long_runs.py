"""Runs of letters beyond 60 count to their end."""

import numpy as np
import pytest

from tabula.llm import toxicity


@pytest.mark.parametrize("before", [0, 10, 59, 61, 85, 300, 5000])
def test_what_stands_late_in_a_run_is_scored(before):
    gain = np.zeros(toxicity.BUCKETS, np.float32)
    gain[toxicity.subwords("horrible")] = 50.0
    score = toxicity.SubwordModel(gain, -1.0).scorer()
    assert score("x" * before + "horrible" + "x" * 200) > score("x" * (before + 208)) + 0.1


def test_pieces_cover_every_run():
    for size in (1, 60, 61, 90, 91, 119, 120, 121, 1000):
        run = "".join(chr(0x4E00 + n) for n in range(size))
        pieces = toxicity.words_of("a " + run + " b")
        assert pieces[0] == "a" and pieces[-1] == "b" and all(len(p) <= 60 for p in pieces)
        for at in range(max(1, size - 29)):
            assert any(run[at : at + 30] in p for p in pieces[1:-1])
