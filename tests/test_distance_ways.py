"""Distances that need no matrix: one side with more between, and ends that are told by slices; counted as the textbook has them."""

import random

import pytest

from foliant.functions import distance as D
from foliant.plans import statement_queries as Q


def test_a_text_with_more_between_needs_no_band(monkeypatch):
    def refused(*_):
        raise AssertionError("a band was looked at")

    monkeypatch.setattr(D, "banded", refused)
    text = "".join(random.Random(3).choice("abcdef \n") for _ in range(5000))
    assert D.edit_distance(text, f"**{text}**") == 4
    assert D.edit_distance(text, text[:40] + text[90:2000] + text[2001:]) == 51
    words = text.split()
    assert D.edit_distance(words, ["x", *words[:700], "y", *words[700:]]) == 2


@pytest.mark.parametrize("symbols", ["ab", "abcdefgh", "a\u4e00\U0001f600\ud800"])
def test_ends_and_bounds_of_long_texts(symbols):
    rng = random.Random(5)
    for _ in range(300):
        mid = ["".join(rng.choice(symbols) for _ in range(rng.randrange(600))) for _ in range(2)]
        same = "".join(rng.choice(symbols) for _ in range(rng.randrange(90)))
        a, b = sorted((same + mid[0] + same, same + mid[1] + same), key=len)
        x, y = D.without_ends(a, b)
        k = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), len(a))
        e = next((e for e in range(len(a) - k) if a[-1 - e] != b[-1 - e]), len(a) - k)
        assert (x, y) == (a[k : len(a) - e], b[k : len(b) - e])
        assert D.without_ends(list(a), list(b)) == (list(x), list(y))
        if x:
            assert D.bounds(x, y) == D.bounds(list(x), list(y))
            it = iter(y)
            assert D.is_within(x, y) == all(c in it for c in x)


def test_truths_are_counted_before_their_systems_are_set_beside_them(spark):
    plan = Q.score_micro(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan.split("Generate")[0] and "split(" in plan.split("Generate", 1)[1]
