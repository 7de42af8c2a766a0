"""Tables of many pages at once give what the expressions over one text give."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.functions import cells as C
from foliant.functions import tables as T
from foliant.operators import scoring as S
from foliant.plans import statement_queries as Q

SMALL = "/root/testdata/sf0.001"
PIECES = ["|", "|", "|", "\n", "\n", "\n|", " ", "  ", "-", "--", ":", "a", "b", "$1.00", "$1.00", "2,300.50 Cr", "3.5", "٣٤.٥٠", "x\x0by", "\xa0", " |", "\x1c|", "\r\n|", "\x1f", "\x01"]
TAGS = ["<tr>", "<TR class='a'>", "</tr>", "</tr>", "<td>", "<td>", "</td>", "</TD>", "<th>", "</th>", "<b>", "<", ">", "<tr", "</t"]


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(8)
    made = ["".join(rng.choice(PIECES + (TAGS if k % 2 else [])) for _ in range(rng.randrange(60))) for k in range(1500)]
    return [None, "", "|", "||", "|-|", "| | a |\n|:|", "<tr></tr>", "<tr><td>1.00</td></tr>\n| 1.00 |", "<td>a</td><tr><td>b<td>c</td></tr>", *made]


def test_cells_are_those_of_table_rows(spark, pages):
    """Placed amounts of many pages, with the width, against the expressions over each."""
    d = spark.createDataFrame([(t,) for t in pages], "t string").select(T.table_rows(F.col("t")).alias("r"), C.placed_amounts(F.col("t")).alias("c"))
    got = d.select(T.placements(F.col("r")).alias("p"), T.modal_width(F.col("r")).alias("w"), "c").collect()
    assert sum(len(r.p) for r in got) > 500
    assert all([(x.amount, x.col, x.row_key, x.row_idx > 0) for x in r.p] == [tuple(x) for x in r.c.amounts] and r.w == r.c.width for r in got)


def test_amounts_found_are_bag_intersections(spark, pages):
    p = spark.createDataFrame([("s", str(k), a, b) for k, (a, b) in enumerate(zip(pages, [*pages[3:], *pages[:3]]))], "system string, stem string, truth string, prediction string")
    p = p.unionByName(p.withColumns({"system": F.lit("same"), "prediction": F.col("truth")}))
    got = S.column_facts(S.with_rows(p)).withColumns({"t": T.placements(F.col("truth_rows")), "p": T.placements(F.col("prediction_rows")), "w": T.modal_width(F.col("prediction_rows"))}).collect()
    size = lambda r, key, first=0: (Counter(key(x) for x in r.t if x.row_idx >= first) & Counter(key(x) for x in r.p if x.row_idx >= first)).total()
    for r in got:
        want = (len(r.t), size(r, lambda x: x.amount), size(r, lambda x: x[:2]), size(r, lambda x: x[:3], 1), r.w)
        assert (r.amounts, r.read, r.placed, r.attributable, r.prediction_columns) == want
    assert sum(r.attributable for r in got) > 100


def test_keys_too_large_for_62_bits_are_numbered_anew():
    import numpy as np

    page, truth = np.array([0, 0, 1, 1, 1]), np.array([True, False, True, False, False])
    k = C.Keys(page, np.array([5, 5, 1 << 60, 1 << 60, 1 << 60]), (1 << 60) + 1, truth).and_(np.array([7, 7, 1 << 20, 1 << 20, 3]))
    assert k.shared(3).to_pylist() == [1, 1, 0] and k.where(truth).shared(1 + 2).to_pylist() == [0, 0, 0]


def test_column_facts_read_predictions_in_batches(spark):
    plan = Q.column_rates_system(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "_found_amounts" in plan and "regexp_extract_all" not in plan and "split(" not in plan


def test_table_facts_are_those_of_each_page(spark, pages):
    from foliant.functions import align

    p = spark.createDataFrame([("s", str(k), a, b) for k, (a, b) in enumerate(zip(pages, [*pages[3:], *pages[:3]]))], "system string, stem string, truth string, prediction string")
    p = p.unionByName(p.withColumns({"system": F.lit("same"), "prediction": F.col("truth")}))
    t, q = F.col("truth_rows"), F.col("prediction_rows")
    old = {"vt": T.cell_values(t), "vp": T.cell_values(q), "f": T.fragments(q), "w": T.width_breaks(q), "rows": F.size(t), "own": F.size(q), "a": align.aligned(T.row_signatures(t), T.row_signatures(q))}
    got = S.table_facts(S.with_rows(p)).withColumns(old).collect()
    for r in got:
        want = ((Counter(r.vt) & Counter(r.vp)).total(), len(r.vt), r.f, r.w, r.rows, r.own, r.a)
        assert (r.recalled_cells, r.truth_cells, r.fragments, r.width_breaks, r.n_truth_rows, r.n_prediction_rows, r.aligned) == want
    assert sum(r.fragments > 0 for r in got) > 50 and sum(0 < r.aligned < r.rows for r in got) > 20


def test_table_facts_read_predictions_in_batches(spark):
    for query in (Q.content_recall, Q.aligned_rows, Q.fragments_and_breaks):
        plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert ("_recalled" in plan or "_structure" in plan) and "regexp_extract_all" not in plan and "split(" not in plan
    assert "_structure" not in Q.content_recall(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_number_facts_are_those_of_each_page(spark):
    from foliant.functions import numbers as N

    rng = random.Random(9)
    tokens = ["1,234.50", "1,234.5", "1,234.60", "9.99", "9.9", "100", "10.00", "1,000", "10", "0.10", "٣.٤", "12.5x", "345.678", "7..1", ",", "é", "."]
    made = [" ".join(rng.choice(tokens[: 10 + k % 8]) for _ in range(rng.randrange(12))) for k in range(600)]
    texts = [None, "", "none", *made]
    p = spark.createDataFrame([("s", str(k), a, b) for k, (a, b) in enumerate(zip(texts, [*texts[2:], *texts[:2]]))], "system string, stem string, truth string, prediction string")
    p = p.unionByName(p.withColumns({"system": F.lit("same"), "prediction": F.col("truth")}))
    old = {f"{x}{y}": c for x, side in (("t", "truth"), ("p", "prediction")) for y, c in (("w", N.amounts(F.col(side))), ("c", F.transform(N.amounts(F.col(side)), N.canonical)))}
    got = S.number_facts(p).withColumns(old).collect()
    for r in got:
        correct, spare, misread = (Counter(r.tc) & Counter(r.pc)).total(), N._left_over(r.pc, r.tc), 0
        for want in N._left_over(r.tc, r.pc):
            k = next((k for k, x in enumerate(spare) if N.close(want, x)), None)
            if k is not None:
                spare.pop(k)
                misread += 1
        assert (r.truth_amounts, r.prediction_amounts, r.amounts_correct, r.literal, r.misread) == (len(r.tw), len(r.pw), correct, (Counter(r.tw) & Counter(r.pw)).total(), misread)
    assert sum(r.misread > 0 for r in got) > 50 and sum(r.literal < r.amounts_correct for r in got) > 50


def test_number_facts_read_predictions_in_batches(spark):
    for query in (Q.failure_taxonomy, Q.numeric_fidelity_system):
        plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "_held" in plan and "regexp_extract_all" not in plan and "split(" not in plan
