"""Disguised personal data in forms beyond the tables of the operator, per kind, and runs that must not cost more than their length."""

from __future__ import annotations

import random
import time

import pytest

from foliant.llm import pii


def found(text):
    base = pii.detect(text)
    return [(k, text[a:b]) for k, a, b in base + pii.deobfuscated(text, base)]


EMAILS = [
    "jane { at } example.com", "jane < at > example [ dot ] org", "jane [\tat ] example.com", "jane @ example . com", "jane@example。com", "jane@example｡com", "jane(at)example{dot}co{dot}uk", "Jane AT example DOT com", "jane.doe-at-mail-dot-org",
    "j4ne_at_example_dot_com", "jane arroba ejemplo punto es", "jane [arroba] ejemplo [punto] es", "jane at beispiel punkt de", "jane(@)example(.)com", "ｊａｎｅ@example.com", "jane@еxample.com",
]
IPS = ["192[.]168[.]0[.]1", "192(dot)168(dot)0(dot)1", "10 [dot] 0 [dot] 0 [dot] 255", "10{.}1{.}2{.}3", "１０.０.０.１", "one zero dot zero dot zero dot one", "192。168。0。1"]
CARDS = ["４１１１ 1111 1111 1111", "four one one one one one one one one one one one one one one one", "4111​1111​1111​1111", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "٤١١١ 1111 1111 1111"]
PHONES = ["+１ 555 010 2345", "plus four nine three zero one two three four five six", "más tres cuatro nueve uno dos tres cuatro cinco seis", "+1 (555)​ 010-2345", "＋49 30 123456"]


@pytest.mark.parametrize("kind,forms", [("email", EMAILS), ("ip", IPS), ("card", CARDS), ("phone", PHONES)])
def test_recall_of_each_kind(kind, forms):
    hit = [f for f in forms if (kind, f) in found(f"Please note {f} and go on")]
    assert len(hit) >= 0.9 * len(forms), set(forms) - set(hit)


@pytest.mark.parametrize("text", ["look at the point . then go", "meet me @ noon . then we go", "see 3 (.) or 4 [x] 5", "a dot b at c", "he was at dot com", "page 12 [dot] of 13", "at a-dot-b", "終わり。次は at 3。"])
def test_plain_texts_stay_clean(text):
    assert found(text) == []


@pytest.mark.parametrize("pieces", [["-at-"], ["-at-", "punkt"], ["a@b-dot-"], ["a at b dot "], ["-at-", "-dot-", "x"], ["1[.]"], ["1 [ "], ["at \t"], ["a@b.c "], ["_at_", "a"], [" . ", "com "], ["a at b", " dot "]])
def test_long_runs_cost_no_more_than_their_length(pieces):
    r = random.Random(3)

    def seconds(n):
        text = "x " + "".join(r.choice(pieces) for _ in range(n)) + " (at) dot one"
        began = time.process_time()
        found(text)
        return time.process_time() - began

    seconds(100)
    few, many = min(seconds(5_000) for _ in range(2)), seconds(40_000)
    assert many < 14 * max(0.05, few), (few, many)


def spans_apart(added, taken):
    """By the definition: apart from all known spans, or larger than those it holds."""
    out, taken = [], list(taken)
    for a, b in added:
        if all(b <= x or y <= a or (a <= x and y <= b and b - a > y - x) for x, y in taken):
            out.append((a, b))
            taken.append((a, b))
    return out


def test_spans_that_meet_are_told_as_defined():
    r = random.Random(4)
    words = ["jane dot doe@x.com", "a@b.c dot com", "+1 555 010 2345", "plus one five five five zero one two three", "4111 1111 1111 1111", "one", "(at)", "dot", "10.0.0.1", "@", "x", "１０.0.0.1", "a at b dot c"]
    for _ in range(300):
        text = " ".join(r.choice(words) for _ in range(12))
        base = pii.detect(text)
        tape = [(a, b) for _, a, b in pii.deobfuscated(text, base)]
        assert spans_apart(tape, [(a, b) for _, a, b in base]) == tape
