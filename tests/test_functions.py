"""Golden cases of the scalar and table functions, and the quirks that are kept on purpose."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from foliant.errors import Refusal
from foliant.functions import distance as D
from foliant.functions import numbers as N
from foliant.functions import tables as T
from foliant.functions import text as X
from foliant.operators import projection, scoring, work
from foliant.operators.bags import intersection_size
from foliant.policy import STANDARD, from_mapping


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], list(inputs)) if inputs else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def textbook(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize(("a", "b", "n"), [("kitten", "sitting", 3), ("", "abc", 3), ("abc", "", 3), ("same", "same", 0), (["the", "cat"], ["the", "dog"], 1)])
def test_edit_distance(a, b, n):
    assert D.edit_distance(a, b) == D.edit_distance(b, a) == n


def test_edit_distance_equals_the_textbook():
    r = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(0, 14))) for _ in range(2))
        assert D.edit_distance(a, b) == textbook(a, b)


@pytest.mark.parametrize(("d", "n", "rate"), [(0, 0, 0.0), (5, 0, 1.0), (1, 4, 0.25), (8, 4, 2.0)])
def test_error_rate(spark, d, n, rate):
    assert value(spark, D.error_rate(F.col("d"), F.col("n")), d=d, n=n) == rate


def test_white_space_runs_do_not_count_as_words(spark):
    assert value(spark, X.words(F.col("t")), t="the   cat\nsat") == ["the", "cat", "sat"]
    assert value(spark, X.words(F.col("t")), t="  a b\x1cc ") == ["a", "b", "c"]


SURVIVE = ["EFTPOS SQ *COASTAL Hobart AUS", "#R-011FDD", "Credits (-)", "15:46", "a_b_c", "5 * 3 * 2"]


@pytest.mark.parametrize("text", SURVIVE)
def test_content_survives_normalisation(spark, text):
    assert value(spark, X.normalise(F.col("t"), STANDARD), t=text) == text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("| Date | Amount |\n| --- | --- |\n| 01/09/2023 | $12.00 |", "Date Amount 01/09/2023 $12.00"),
        ("> quoted", "quoted"),
        ("**Total**: $12.00", "Total $12.00"),
        ("# TAX INVOICE\n", "TAX INVOICE"),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "a b"),
        ("AT&amp;T — “x”", 'AT&T - "x"'),
        ("__strong__ and _soft_", "strong and soft"),
    ],
)
def test_conventions_are_stripped(spark, text, want):
    assert value(spark, X.normalise(F.col("t"), STANDARD), t=text) == want


def test_a_step_that_is_off_changes_nothing(spark):
    names = [f for f in STANDARD.__dataclass_fields__ if f != "unicode_form"]
    off = replace(STANDARD, **{n: False for n in names})
    text = "# **A**: — &amp; | x |\n> q  r"
    assert value(spark, X.normalise(F.col("t"), off), t=text) == text
    assert value(spark, X.normalise(F.col("t"), replace(off, fold_case=True)), t="Straße") == "strasse"


def test_policy_has_no_defaults():
    with pytest.raises(Refusal, match="lacks"):
        from_mapping({"unicode_form": "NFC"})
    whole = {k: getattr(STANDARD, k) for k in STANDARD.__dataclass_fields__}
    assert from_mapping(whole) == STANDARD
    with pytest.raises(Refusal, match="unicode_form"):
        from_mapping(whole | {"unicode_form": "NFX"})
    with pytest.raises(Refusal, match="true or false"):
        from_mapping(whole | {"fold_case": "yes"})


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("|  |  |  |\n| a | b |", [["a", "b"]]),  # a blank row is dropped
        ("||x||", [["x"]]),  # all outer pipes go
        ("| - | - |", []),
        ("| a |\n<tr><td>h <b>i</b></td><th>j</th></tr>", [["h i", "j"], ["a"]]),  # the other dialect's rows come first
        ("<tr colspan=2><td colspan=2>x</td></tr>", [["x"]]),
        ("no table", []),
    ],
)
def test_table_rows(spark, text, rows):
    assert value(spark, T.table_rows(F.col("t")), t=text) == rows


def test_the_viewer_splits_otherwise(spark):
    assert value(spark, T.split_row(F.col("t")), t="||x||") == ["", "x", ""]


def test_modal_width_takes_the_first_of_equals(spark):
    assert value(spark, T.modal_width(T.table_rows(F.col("t"))), t="| a | b | c |\n| a | b |\n| a | b | c |\n| a | b |") == 3
    assert value(spark, T.modal_width(T.table_rows(F.col("t"))), t="") == 0


def test_fragments(spark):
    assert value(spark, T.fragments(T.table_rows(F.col("t"))), t="| only |  |\n| one |\n| a | b |\n|  | b |") == 2


def test_amounts(spark):
    assert value(spark, N.amounts(F.col("t")), t="x 1,234.50 9.99 345.678") == ["1,234.50", "9.99"]


@pytest.mark.parametrize(("token", "want"), [("1,234.50", "1234.5"), ("100.00", "100"), ("1,000", "1000"), ("0.10", "0.1")])
def test_canonical(spark, token, want):
    assert value(spark, N.canonical(F.col("t")), t=token) == want


@pytest.mark.parametrize(("a", "b", "same"), [("12.5", "12.6", True), ("12.5", "1.5", True), ("12.5", "123.5", True), ("12.5", "21.5", False), ("1", "1", True), ("1", "345", False)])
def test_one_edit(spark, a, b, same):
    assert N.close(a, b) is same
    assert value(spark, D.one_edit_apart(F.col("a"), F.col("b")), a=a, b=b) is same


def test_bags_keep_repeats(spark):
    assert value(spark, intersection_size(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["x", "x", "x", "z"]) == 2


def scores(spark, truth, prediction):
    p = spark.createDataFrame([("s", "CASE001_invoices", truth, prediction)], "system string, stem string, truth string, prediction string")
    return scoring.doc_scores(p).first().asDict()


PAGE = "# S\n| Date | Text | Debit | Credit |\n| --- | --- | --- | --- |\n| 01/02/2024 | Shop |  | $1,234.50 |\n| 02/02/2024 | Rent | $9.99 |  |\n| 02/02/2024 | Rent | $9.99 |  |"


def test_a_page_scored_against_itself(spark):
    s = scores(spark, PAGE, PAGE)
    assert s["strict_cer"] == s["normalised_cer"] == s["strict_wer"] == 0
    assert s["amounts"] == s["read"] == s["placed"] == s["attributable"] == 3
    assert s["aligned"] == s["n_truth_rows"] == 4 and s["misread"] == s["dropped"] == s["invented"] == 0


def test_invariants_of_the_fact_row(spark):
    wrong = PAGE.replace("1,234.50", "1,234.60").replace("| 02/02/2024 | Rent | $9.99 |  |", "| 02/02/2024 | Rent |  | $9.99 |", 1)
    s = scores(spark, PAGE, wrong)
    assert s["attributable"] <= s["placed"] <= s["read"] <= s["amounts"]
    assert s["misfiled"] == s["amounts"] - s["placed"] and s["usable_placed"] == s["placed"]
    assert s["amounts_correct"] + s["misread"] + s["dropped"] == s["truth_amounts"]
    assert s["amounts_correct"] + s["misread"] + s["invented"] == s["prediction_amounts"]
    assert (s["read"], s["placed"], s["misread"]) == (2, 1, 1)
    assert scores(spark, PAGE, "")["strict_cer"] == 1.0


def test_headerless_tables_lose_their_first_data_row(spark):
    page = "|  |  |\n| --- | --- |\n| 01/02 | $1.00 |\n| 02/02 | $2.00 |"
    s = scores(spark, page, page)
    assert (s["amounts"], s["placed"], s["attributable"]) == (2, 2, 1)


def hunks(spark, truth, prediction, systems=("s",)):
    p = spark.createDataFrame([(x, "CASE001_invoices", truth, prediction) for x in systems], "system string, stem string, truth string, prediction string")
    return scoring.hunks(p)


def test_hunks(spark):
    assert [r["kind"] for r in hunks(spark, "Total $12.00", "**Total** $12.00").collect()] == ["convention"]
    assert [(r["truth"], r["prediction"], r["kind"]) for r in hunks(spark, "Total $12.00", "Total $13.00").collect()] == [("$12.00", "$13.00", "reading")]
    assert [r["prediction"] for r in hunks(spark, "a b c", "a c").collect()] == [""]
    assert sorted(r["kind"] for r in hunks(spark, "Total is $12.00", "**Total** is $13.00").collect()) == ["convention", "reading"]
    assert hunks(spark, PAGE, PAGE).count() == 0


def test_divergences_group_over_systems(spark):
    g = scoring.divergence_groups(hunks(spark, "a 1", "a 2", ("one", "two")))
    assert [(r["count"], r["systems"]) for r in g.collect()] == [(2, ["one", "two"])]
    assert scoring.top_divergences(g, 1).count() == 1


def test_pairing_refuses(spark):
    corpus = spark.createDataFrame([("a", "x"), ("b", "y")], "stem string, truth string")
    pred = lambda *rows: spark.createDataFrame(list(rows), "system string, stem string, prediction string")
    none = spark.createDataFrame([("s", "b", "too long")], "system string, stem string, reason string")
    with pytest.raises(Refusal, match="missing"):
        scoring.pairs(corpus, pred(("s", "a", "x")))
    with pytest.raises(Refusal, match="no transcript"):
        scoring.pairs(corpus, pred(("s", "a", "x"), ("s", "b", "y"), ("s", "c", "z")))
    with pytest.raises(Refusal, match="declared unproduced"):
        scoring.pairs(corpus, pred(("s", "a", "x"), ("s", "b", "y")), none)
    got = {r["stem"]: (r["prediction"], r["is_unproduced"]) for r in scoring.pairs(corpus, pred(("s", "a", "x")), none).collect()}
    assert got == {"a": ("x", False), "b": ("", True)}


def test_projection(spark):
    c = spark.createDataFrame([("CASE1", "01/01 | 02/01", "Shop | Pay", "12.00 | NOT_FOUND")], "case_id string, dates string, descriptions string, paid string")
    r = projection.statements(c).first()
    assert (r["transaction_amounts_paid"], r["transaction_dates"], r["line_item_descriptions"]) == ("$12.00", "01/01", "Shop")
    with pytest.raises(Refusal, match="different lengths"):
        projection.statements(c.withColumn("dates", F.lit("01/01")))


def test_shards(spark):
    stems = spark.createDataFrame([(x,) for x in "abcde"], "stem string")
    assert sorted(r["stem"] for r in work.shard(stems, 1, 2).collect()) == ["b", "d"]
    with pytest.raises(Refusal, match="shard"):
        work.shard(stems, 2, 2)
    assert work.chunks(stems, 0).select("chunk").distinct().count() == 5


def test_timing_rollup(spark):
    t = spark.createDataFrame([("a", 0, 2, 1, 10, 60.0, None), ("a", 1, 2, 1, 12, 30.0, True), ("b", 0, 1, 2, 5, 10.0, None)], "system string, shard int, shards int, cards int, images int, inference_seconds double, includes_model_load boolean")
    got = {r["system"]: r for r in work.shard_rollup(t).collect()}
    assert (got["a"]["images"], got["a"]["seconds"], got["a"]["deployment"], got["a"]["includes_model_load"]) == (22, 60.0, "dp=2", True)
    assert (got["b"]["deployment"], got["b"]["includes_model_load"], got["b"]["images_per_minute"]) == ("tp=2", False, 30.0)


def test_bounds_and_bands_agree_with_the_whole_matrix():
    import random

    from foliant.functions import distance as D

    r = random.Random(3)

    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for n in (0, 3, 12, 80):
        for _ in range(150):
            a = [r.choice("abc") for _ in range(r.randrange(n + 1))]
            b = list(a)
            for _ in range(r.randrange(6)):
                k = r.randrange(len(b) + 1)
                b[k : k + 1] = r.choice([[], ["x"], ["a", "b"]])
            want = plain(a, b)
            assert D.edit_distance("".join(a), "".join(b)) == D.edit_distance(a, b) == want
            low, high = D.bounds(*sorted((a, b), key=len))
            assert low <= want <= high
            for most in (1, 2, 5):
                assert D.banded(*sorted((a, b), key=len), most) == (want if want <= most else None)
