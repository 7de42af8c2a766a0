"""All facts of a page in one trip are those of the steps one by one, and a row holds its two texts alone on the way."""

import random

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import scoring as S
from foliant.plans import statement_queries as Q
from foliant.policy import STANDARD

PIECES = ["|", "|", "| ", "\n", "\n|", " ", "-", ":", "a", "bc", "$1.00", "2,300.50 Cr", "3.5", "x\x0by", "**", "# ", "> ", "é", "–", "&amp;", "<tr>", "</tr>", "<td>", "</td>", "12.50", "1,250.0"]


def test_facts_in_one_trip_are_those_of_the_steps(spark):
    rng = random.Random(21)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(50))) for _ in range(500)]
    texts = [None, "", "|", "| a | 1.00 |\n| b | 2.50 |", *made]
    rows = [("s", str(k), a, b) for k, (a, b) in enumerate(zip(texts, [*texts[3:], *texts[:3]]))]
    rows += [("same", str(k), a, a) for k, a in enumerate(texts)] + [("less", str(k), a, a and a[: len(a) // 2] + a[len(a) // 2 + 3 :]) for k, a in enumerate(texts)]
    p = spark.createDataFrame(rows, "system string, stem string, truth string, prediction string")
    each = p.withColumns({"nt": X.normalise(F.col("truth"), STANDARD), "np": X.normalise(F.col("prediction"), STANDARD)})
    each = S.number_facts(S.table_facts(S.column_facts(S.with_rows(S.character_facts(S.character_facts(each), "nt", "np", "normalised")))))
    got = S.doc_scores(p)
    want = {(r.system, r.stem): r for r in each.select(*got.columns).collect()}
    rows = got.collect()
    odd = [(r.system, r.stem, {c: (r[c], want[r.system, r.stem][c]) for c in got.columns if r[c] != want[r.system, r.stem][c]}) for r in rows if r != want[r.system, r.stem]]
    assert len(rows) == len(want) > 1500 and odd == []
    assert sum(r.attributable > 0 for r in rows) > 10 and sum(0 < r.normalised_char_distance for r in rows if r.normalised_char_distance is not None) > 300


def test_rows_hold_no_cells_while_they_are_in_python(spark):
    plan = Q.full_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "_placed_amounts" not in plan and "_found_amounts" not in plan and "_held" not in plan and plan.count("facts(") > 0


def test_batches_of_pages_are_small(spark):
    Q.full_scores(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
