"""Spans' kinds that are told in the task, opcodes that are kept, and bags of amounts in the row, against the plain ways."""

import dataclasses
import difflib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.functions import align, numbers
from foliant.functions import text as X
from foliant.operators import scoring as S
from foliant.plans import statement_queries as Q
from foliant.policy import STANDARD

SMALL = "/root/testdata/sf0.001"
PIECES = ["|", "||", "a", "B c", " ", "  ", "\n", "\t", "*", "**", "_", "__", "#", "## ", "> ", ">", "<td>", "</TD >", "<table\x1cx>", "<b>", "<", ":", ": ", "-", "| --- |", "|:-|", "\x1f", "'", "x_y", "1.5", "&", "&amp;", "é", "–", "\n| a | b |", "\n> # c:"]


@pytest.mark.parametrize("policy", [STANDARD, dataclasses.replace(STANDARD, fold_case=True, strip_table_marks=False), dataclasses.replace(STANDARD, unescape_html_entities=False, strip_emphasis=False, collapse_whitespace=False)])
def test_plain_texts_normalise_alike_in_both_ways(spark, policy):
    rng = random.Random(11)
    texts = ["", *["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(4000)]]
    plain = [t for t in texts if X.is_plain(t, policy)]
    got = spark.createDataFrame([(t,) for t in plain], "t string").select("t", X.normalise(F.col("t"), policy).alias("n")).collect()
    assert [(r.t, r.n) for r in got if X.plainly_normalised(r.t, policy) != r.n] == [] and len(plain) > 1000
    assert not X.is_plain("é", policy) and X.is_plain("&", policy) != policy.unescape_html_entities


def test_kinds_told_with_spans_are_those_of_spans_alone(spark):
    rng = random.Random(12)
    page = lambda: " ".join(rng.choice(PIECES) for _ in range(rng.randrange(20)))
    p = spark.createDataFrame([("s", str(k), t if k else None, page()) for k, t in enumerate(page() for _ in range(800))], "system string, stem string, truth string, prediction string")
    spans = S.word_spans(p)
    want = S.with_kind(spans.drop("same")).select("stem", "idx", "kind").collect()
    assert sorted(S.hunks(p).select("stem", "idx", "kind").collect()) == sorted(want)
    known = Counter(r.same for r in spans.collect())
    assert min(known[True], known[False], known[None]) > 50


def test_opcodes_that_are_kept_are_the_standard_library_s():
    rng = random.Random(13)
    align._of_names.cache_clear()
    for _ in range(3000):
        a, b = ([rng.choice(["p", "q", "r", str(rng.random())][: rng.choice([2, 3, 4])]) for _ in range(rng.randrange(12))] for _ in range(2))
        assert align._codes(a, b) == difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()
    assert align._of_names.cache_info().hits > 100
    one = align._codes(["a", "b", "a"], ["a", "c"])
    assert align._codes(["x", "$1", "x"], ["x", "$2"]) is one  # not searched again


def test_spans_are_counted_by_system_before_systems_are_gathered(spark):
    plan = Q.divergence_groups(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "HashAggregate(keys=[truth" in plan and "same" in plan


def test_amounts_are_found_as_they_were():
    old = re.compile(r"\d(?:\d{0,2}(?:,\d{3})+(?:\.\d{1,2})?|\d*\.\d{1,2}\b)")
    rng = random.Random(14)
    for k in range(20000):
        t = "".join(rng.choice("0123456789,,..  x_$/\n" + ("é٣" if k % 2 else "")) for _ in range(rng.randrange(24)))
        assert (numbers.EACH_ASCII_AMOUNT if t.isascii() else numbers.EACH_AMOUNT).findall(t) == old.findall(t)


def test_bags_of_amounts_are_those_of_each_page(spark):
    rng = random.Random(15)
    page = lambda: rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choice(["1.50", "1.5", "2,000", "7", "1.50", "٣.٤", "9.99"]) for _ in range(rng.randrange(9)))
    rows = [(k, page(), page()) for k in range(500)]
    d = spark.createDataFrame(rows, "k long, t string, p string")
    got = d.select("k", "t", "p", numbers.amounts(F.col("t")).alias("a"), numbers.amounts(F.col("p")).alias("b"), numbers.amount_bags(numbers.written_amounts(F.col("t")), F.col("p")).alias("bag")).collect()
    for r in got:
        t, p = Counter(r.a), Counter(r.b)
        assert sorted(map(tuple, r.bag)) == sorted((v, t[v], p[v]) for v in t | p)


def test_bags_of_amounts_are_not_gathered_by_value(spark):
    plan = Q.amount_bag(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "regexp_extract_all" not in plan
