"""Steps that many queries share: what holds of the truth alone is worked out once a page, and quick ways give what the long ones do."""

import difflib
import random

from pyspark.sql import functions as F

from foliant.functions import align
from foliant.functions import numbers as N
from foliant.functions import tables as T
from foliant.operators import scoring as S
from foliant.operators.bags import _shared, intersection_size
from foliant.plans import derived as P

SMALL = "/root/testdata/sf0.001"


def test_pages_of_written_lines_are_those_of_cells(spark):
    systems = [*P.SYSTEMS, "ragged"]
    new = P.statement_pairs(spark, SMALL, systems)
    made = F.array(*[F.struct(F.lit(s).alias("system"), P.written(F.col("lines"), s).alias("prediction")) for s in systems])
    old = P.statement_orders(spark, SMALL).select("stem", P.written(F.col("lines"), "exact").alias("truth"), F.explode(made).alias("s")).select("s.system", "stem", "truth", "s.prediction")
    assert new.count() == old.count() and new.exceptAll(old).isEmpty()


def test_truth_is_read_before_systems_are_set_beside_it(spark):
    p = S.column_facts(S.with_rows(P.statement_pairs(spark, SMALL, about=S.truth_tables)))
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "AS pt#" not in above and "pt#" in below


def test_amounts_by_thousands(spark):
    values = [0, 9, 99, 100, 99999, 100000, 99999999, 100000000, 123456789012]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "c long").select(P.dollars(F.col("c"))).collect()]
    assert got == [f"${v // 100:,}.{v % 100:02d}" for v in values]


def test_bags_that_repeat_values_on_both_sides(spark):
    rng = random.Random(5)
    rows = [([rng.choice([None, *"abcdef"]) for _ in range(rng.randrange(12))], [rng.choice([None, *"abcdef"]) for _ in range(rng.randrange(12))]) for _ in range(200)]
    rows += [(["a", "b"] * 200, ["b", "a", "a"] * 100)]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(intersection_size(a, b).alias("n"), _shared(a, b).alias("m"), "a", "b").collect()
    assert all(r.n == r.m == sum(min(r.a.count(v), r.b.count(v)) for v in {*r.a}) for r in got)


def test_rows_aligned_without_a_search(spark):
    rng = random.Random(6)
    rows = [([rng.choice("abcdefgh") for _ in range(rng.randrange(7))], [rng.choice("abcdefgh") for _ in range(rng.randrange(7))]) for _ in range(300)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", align.aligned_plainly(F.col("a"), F.col("b")).alias("n")).collect()
    told = [r for r in got if r.n is not None]
    assert len(told) > 30 and len(told) < len(got)
    assert all(r.n == sum(m.size for m in difflib.SequenceMatcher(None, r.a, r.b, False).get_matching_blocks()) for r in told)


def test_plain_and_other_pages_are_read_alike(spark):
    plain = "x\n |  a | b  c|| \n||--|:-|\n|-|\n| | |\n|||q|\n"
    texts = [plain, plain + "é", plain.replace("a", "a\x0b| z"), plain.replace("  ", "\xa0"), "<tr><td>a <b>b</b></td><td> c\n d</td></tr>", "", "none"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.pipe_rows(F.col("t")).alias("r"), T._pipe_rows(F.col("t"), T.LINE_END, T.trim).alias("o"), T.table_rows(F.col("t")).alias("all"))
    rows = rows.withColumns({"values": T.cell_values(F.col("all")), "v": F.array_remove(F.transform(F.flatten("all"), T.squeeze), ""), "s": T.row_signatures(F.col("all")), "s1": F.transform("all", T.row_signature)}).collect()
    assert all(r.r == r.o and r["values"] == r.v and r.s == r.s1 for r in rows)
    assert rows[0].r == [["a", "b  c"], ["q"]] and rows[4]["values"] == ["a b", "c d"]


def test_amounts_and_their_values(spark):
    t = "1,234.50 9.99 345.678 12.5x 00.10 ٣.٤ 7,000"
    r = spark.createDataFrame([(t,), (t[:33],)], "t string").select(N.amounts(F.col("t")).alias("a"), F.transform(N.amounts(F.col("t")), N.canonical).alias("c")).collect()
    assert r[0].a[:2] == ["1,234.50", "9.99"] and r[0].c[:2] == ["1234.5", "9.99"] and "٣.٤" in r[0].a and r[1].a == r[0].a[: len(r[1].a)]


def test_codes_by_substrings_are_the_standard_library_s():
    rng = random.Random(7)
    for k in range(3000):
        a, b = ([rng.choice("ab" if k % 3 else "abcdefgh") for _ in range(rng.randrange(14))] for _ in range(2))
        assert align._codes(a, b) == difflib.SequenceMatcher(None, a, b, False).get_opcodes()


def test_hunks_of_texts_need_no_second_shuffle_of_pages(spark):
    from foliant.plans import statement_queries as Q

    plan = Q.hunks(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    r = spark.createDataFrame([("a b c  d", "a x c\nd"), ("a b", "a  b"), (None, "a")], "t string, p string").select(align.text_hunks(F.col("t"), F.col("p")).alias("h")).collect()
    assert [h.asDict() for h in r[0].h] == [{"idx": 0, "truth": "b", "prediction": "x"}] and r[1].h == [] and r[2].h is None


def test_pages_and_digests_are_made_once(spark):
    """A filter on the size of an exploded array would make all that is in it a second time."""
    from foliant.plans import sheet_queries, text_queries

    for df in (P.statement_pairs(spark, SMALL), P.prose_pairs(spark, SMALL), text_queries.text_steps(spark, SMALL), sheet_queries.sheet_pairs(spark, SMALL)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode" in plan and "size(array(" not in plan


def test_lines_are_sorted_once_and_not_gathered_again(spark):
    plan = P.statement_pairs(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Sort [") == 1 and "Aggregate" not in plan


def test_sheets_of_written_lines_are_those_of_cells(spark):
    from foliant.plans import sheet_queries

    def whole(lines, system):
        total = F.array(F.lit("Total"), F.size(lines).cast("string"), P.dollars(F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + x["cents"])))
        body = P.page(F.array(total), ["Item", "Lines", "Amount"], html=system == "html")
        return F.concat(P.written(lines, system), F.lit("\n\nTotals\n"), F.replace(body, F.lit("# Statement\n"), F.lit("")))

    made = F.array(*[F.struct(F.lit(s).alias("system"), whole(F.col("lines"), s).alias("prediction")) for s in sheet_queries.SYSTEMS])
    old = P.statement_orders(spark, SMALL).select("stem", whole(F.col("lines"), "exact").alias("truth"), F.explode(made).alias("s")).select("s.system", "stem", "truth", "s.prediction")
    new = sheet_queries.sheet_pairs(spark, SMALL)
    assert new.count() == old.count() and new.exceptAll(old).isEmpty()


def test_placed_amounts_are_placements_with_their_keys(spark):
    text = "| D | A | B |\n|---|---|---|\n| x | $1.00 | |\n|  | 2.50 | $3.00 Cr |\n| 4.00 | - | 5 |"
    r = spark.createDataFrame([(text,)], "t string").select(T.table_rows(F.col("t")).alias("r")).select(T.placements(F.col("r")).alias("p"), T.placed_amounts(F.col("r")).alias("q")).collect()[0]
    assert [tuple(x) for x in r.p] == [("$1.00", 1, "x", 1), ("2.50", 1, "", 2), ("$3.00 Cr", 2, "", 2), ("4.00", 0, "4.00", 3)]
    assert [tuple(x) for x in r.q] == [(a, f"{a}\x01{c}", f"{a}\x01{c}\x01{k}", i) for a, c, k, i in r.p]


def test_documents_are_dealt_before_anything_is_made_of_them(spark):
    from foliant.plans import statement_queries, text_queries

    for df in (statement_queries.prose_scores(spark, SMALL), text_queries.text_steps(spark, SMALL)):
        above, below = df._jdf.queryExecution().optimizedPlan().toString().split("Generate explode", 1)
        assert "RepartitionByExpression" in below and "RepartitionByExpression" not in above
