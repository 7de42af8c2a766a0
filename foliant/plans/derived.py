"""Corpora and reports derived from the relational test tables, so that every operator has input and an oracle.

Statements: one page for each order, rendered as text; systems are pure functions of the same rows. The engine sees
only text, an oracle sees only the rows. Prose: the documents, with systems whose edits can be counted by hand. Reports:
fact rows made of integers by the same portable SQL in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

#: A total order of an order's rows: (l_orderkey, l_linenumber) is not unique; rows tied on all columns are alike.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
HEADER = ["Date", "Description", "Debit", "Credit", "Balance"]
SYSTEMS = ["exact", "html", "shifted", "orphaned", "misread", "dropper"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dollars(cents: Column) -> Column:
    whole = F.floor(cents / 100)
    three = lambda x: F.lpad((x % 1000).cast("string"), 3, "0")
    grouped = F.regexp_replace(whole.cast("string"), r"(\d)(?=(\d{3})+$)", "$1,")
    # by arithmetic up to a million, which costs a tenth of the pattern
    few = F.when(whole < 1000, whole.cast("string")).otherwise(F.concat(F.floor(whole / 1000).cast("string"), F.lit(","), three(whole)))
    whole = F.when((whole >= 0) & (whole < 1000000), few).otherwise(grouped)
    return F.concat(F.lit("$"), whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def fewer_rows_a_batch(spark: SparkSession) -> None:
    """1,000 rows, unless the session has a setting of its own: while a batch is in Python its pages wait in a queue, texts, cells and all, one for
    each step there, and queues that find no memory go to disk."""
    if spark.conf.get(ROWS_A_BATCH, "10000") == "10000":
        spark.conf.set(ROWS_A_BATCH, "1000")


def _of_order() -> WindowSpec:
    return W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)


def _ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As statement_lines, and what the rows are ordered by: a window like _of_order further on then sorts nothing."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    # the one shuffle, by order, that all below rests on; its partitions are not merged, since each line becomes pages of text
    dealt = load(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    li = dealt.withColumns({"rn": F.row_number().over(_of_order()), "cents": cents})
    running = F.sum("cents").over(_of_order().rowsBetween(W.unboundedPreceding, 0))
    return li.withColumns({
        "stem": F.concat(F.lit("CASE"), F.col("l_orderkey"), F.lit("_bank_statements")), "date": F.date_format("l_shipdate", "dd/MM/yyyy"),
        "description": F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(" Supplier "), F.col("l_suppkey")), "debit": F.col("l_returnflag") == "R", "balance": running,
    })


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, stem, rn, date, description, cents, debit (boolean), balance."""
    return _ordered_lines(spark, sf_dir).select("l_orderkey", "stem", "rn", "date", "description", "cents", "debit", "balance")


def last_digit_wrong(cents: Column) -> Column:
    return cents - cents % 10 + (cents % 10 + 1) % 10


def cells(x: Column, cents: Column | None = None, date: Column | None = None) -> Column:
    """A line's cells as they are, or with another amount or date."""
    amount = dollars(x["cents"] if cents is None else cents)
    return F.array(x["date"] if date is None else date, x["description"], F.when(x["debit"], amount).otherwise(""), F.when(x["debit"], "").otherwise(amount), dollars(x["balance"]))


def page(rows: Column, header: list[str], html: bool = False) -> Column:
    """The text of a page of rows (arrays of cells)."""
    lit = F.array(*map(F.lit, header))
    if html:
        row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>"))
        return F.concat(F.lit("# Statement\n<table>"), row(lit), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.lit("| " + " | ".join(["---"] * len(header)) + " |")
    return F.concat(F.lit("# Statement\n"), F.array_join(F.concat(F.array(row(lit), rule), F.transform(rows, row)), "\n"))


def statement_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, lines (in order): one scan and one shuffle, that of the order's lines."""
    own = F.struct("rn", "date", "description", "cents", "debit", "balance")
    return statement_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.first("stem").alias("stem"), F.array_sort(F.collect_list(own)).alias("lines")).drop("l_orderkey")


def written(lines: Column, system: str) -> Column:
    """The page as a system writes it."""
    each = lambda f: F.transform(lines, f)
    if system == "html":
        return page(each(lambda x: cells(x)), HEADER, html=True)
    if system == "shifted":
        return page(each(lambda x: F.concat(F.array(F.lit("")), cells(x))), ["", *HEADER])
    if system == "orphaned":
        return page(F.flatten(each(lambda x: F.array(F.array(x["date"], *[F.lit("")] * 4), cells(x, date=F.lit(""))))), HEADER)
    if system == "misread":
        return page(each(lambda x: cells(x, F.when(x["rn"] % 3 == 0, last_digit_wrong(x["cents"])).otherwise(x["cents"]))), HEADER)
    if system == "ragged":
        return page(each(lambda x: F.when(x["rn"] % 2 == 0, F.concat(cells(x), F.array(F.lit("?")))).otherwise(cells(x))), HEADER)
    if system == "dropper":
        return page(F.transform(F.filter(lines, lambda x: x["rn"] % 4 != 0), lambda x: cells(x)), HEADER)
    return page(each(lambda x: cells(x)), HEADER)


def with_money(lines: DataFrame) -> DataFrame:
    """Adds the amounts that line_text writes: worked out once a line. In each text anew they would make one method too long for the JIT compiler."""
    wrong = F.when(F.col("rn") % 3 == 0, last_digit_wrong(F.col("cents"))).otherwise(F.col("cents"))
    return lines.withColumns({"money": dollars(F.col("cents")), "misread_money": dollars(wrong), "balance_money": dollars(F.col("balance"))})


def line_text(system: str) -> Column:
    """What a system writes for one line of with_money, as written() has it; null for a line that it drops. Null cells leave no trace."""
    amount = F.col("misread_money" if system == "misread" else "money")
    rest = [F.col("description"), F.when(F.col("debit"), amount).otherwise(""), F.when(F.col("debit"), "").otherwise(amount), F.col("balance_money")]
    row = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    if system == "html":
        return F.concat(F.lit("<tr>"), F.concat_ws("", *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in (F.col("date"), *rest)]), F.lit("</tr>"))
    if system == "orphaned":
        return F.concat(row(F.col("date"), *[F.lit("")] * 4), F.lit("\n"), row(F.lit(""), *rest))
    whole = row(*([F.lit("")] if system == "shifted" else []), F.col("date"), *rest)
    if system == "ragged":
        return F.when(F.col("rn") % 2 == 0, F.concat(whole, F.lit(" ? |"))).otherwise(whole)
    return F.when(F.col("rn") % 4 != 0, whole) if system == "dropper" else whole


def page_of(texts: Column, system: str) -> Column:
    """The page of what a system writes for its lines, in order."""
    if system == "html":
        head = "".join(f"<td>{c}</td>" for c in HEADER)
        return F.concat(F.lit(f"# Statement\n<table><tr>{head}</tr>"), F.concat_ws("", texts), F.lit("</table>"))
    header = ["", *HEADER] if system == "shifted" else HEADER
    rows = [header, ["---"] * len(header)]
    return F.concat_ws("\n", F.lit("# Statement"), *[F.lit("| " + " | ".join(r) + " |") for r in rows], texts)


def statement_corpus(spark: SparkSession, sf_dir: str, header: list[str] = HEADER) -> DataFrame:
    return statement_orders(spark, sf_dir).select("stem", page(F.transform("lines", lambda x: cells(x)), header).alias("truth"))


def statement_pairs(spark: SparkSession, sf_dir: str, systems: list[str] = SYSTEMS, about: Callable[[DataFrame], DataFrame] = lambda c: c) -> DataFrame:
    """system, stem, truth, prediction: each page's systems side by side, from the same lines.

    Lines are written out one by one, and only strung together for each page. What `about` adds to the corpus (stem, truth)
    is worked out once for each page, not for each of its systems, and comes as further columns."""
    lines = written_lines(spark, sf_dir, ["exact", *systems])
    corpus = about(lines.withColumn("truth", page_of(F.col("lines")["exact"], "exact")))
    more = [c for c in corpus.columns if c not in ("stem", "truth", "lines")]
    # names are set beside the lines, and each page strung together after it: of an array of pages a filter on its size would make them all twice
    named = corpus.select("stem", "truth", *more, "lines", F.explode(F.array(*map(F.lit, systems))).alias("system"))
    return named.select("system", "stem", "truth", each_of("system", {s: page_of(F.col("lines")[s], s) for s in systems}).alias("prediction"), *more)


def each_of(name: str, columns: dict[str, Column]) -> Column:
    """Of the columns the one that the row's name says; only that is worked out."""
    (first, column), *rest = columns.items()
    chosen = F.when(F.col(name) == first, column)
    for key, column in rest:
        chosen = chosen.when(F.col(name) == key, column)
    return chosen


def written_lines(spark: SparkSession, sf_dir: str, systems: list[str], **more: Column) -> DataFrame:
    """stem, lines: for each order an array of what each system writes for each line, in order; more: columns over the order's lines.

    Collected by a window in the order that the lines are in already, so that nothing is sorted again."""
    fewer_rows_a_batch(spark)
    texts = F.struct(*[line_text(s).alias(s) for s in dict.fromkeys(systems)])
    whole = _of_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own = with_money(_ordered_lines(spark, sf_dir)).withColumn("line", texts)
    return own.withColumns({"lines": F.collect_list("line").over(whole)} | {k: c.over(whole) for k, c in more.items()}).where("rn = 1").select("stem", "lines", *more)


def prose_pairs(spark: SparkSession, sf_dir: str, about: Callable[[DataFrame], DataFrame] = lambda c: c) -> DataFrame:
    """identity; sloppy: every e an a; appended: two words more; emphatic: marks around all; unproduced: nothing.

    What `about` adds to the documents (stem, truth) comes as further columns, as in statement_pairs."""
    d = about(load(spark, sf_dir, "documents").select(F.concat(F.lit("CASE"), F.col("doc_id"), F.lit("_documents")).alias("stem"), F.coalesce("text", F.lit("")).alias("truth")))
    t = F.col("truth")
    made = {"identity": t, "sloppy": F.translate(t, "e", "a"), "appended": F.concat(t, F.lit(" zzq zzq")), "emphatic": F.concat(F.lit("**"), t, F.lit("**")), "unproduced": F.lit("")}
    more = [c for c in d.columns if c not in ("stem", "truth")]
    named = d.select("stem", "truth", *more, F.explode(F.array(*map(F.lit, made))).alias("system"))
    return named.select("system", "stem", "truth", each_of("system", made).alias("prediction"), *more)


#: Fact rows of four systems on seven rungs; delta has clean pages only. Portable: {orders} is the table.
REPORT_ROWS = """
SELECT s.system, r.family, r.severity,
       concat('CASE', CAST(o.k AS STRING), '_', CASE WHEN o.k % 3 = 0 THEN 'bank_statements' WHEN o.k % 3 = 1 THEN 'receipts' ELSE 'tax_invoices' END) AS stem,
       5 + o.k % 11 AS amounts, 5 + o.k % 11 - (o.k + r.rn) % 3 AS read, 5 + o.k % 11 - (o.k * s.sn * (r.rn + 1)) % 4 AS placed,
       (o.k * s.sn * (r.rn + 1)) % 4 AS misfiled, 5 + o.k % 11 - (o.k * s.sn * (r.rn + 1)) % 4 - (o.k * r.rn + s.sn) % 2 AS attributable,
       4 + o.k % 7 AS truth_rows, 4 + o.k % 7 - (o.k + s.sn * r.rn) % 3 AS aligned, (o.k * r.rn) % 2 AS fragments, (o.k * s.sn) % 2 AS width_breaks,
       7 + o.k % 11 AS truth_amounts, 7 + o.k % 11 - (o.k + r.rn * s.sn) % 3 AS amounts_correct, (o.k + s.sn) % 5 <> 0 AS columns_match,
       CAST((o.k * 13 + r.rn * 7 + s.sn) % 100 AS DOUBLE) / 400 AS normalised_cer,
       CAST((o.k * 13 + r.rn * 7 + s.sn) % 100 + (o.k * s.sn) % 50 AS DOUBLE) / 400 AS strict_cer
FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM {orders}) o
CROSS JOIN (VALUES ('alpha', 1), ('beta', 2), ('gamma', 3), ('delta', 4)) AS s(system, sn)
CROSS JOIN (VALUES ('clean', 'clean', 0), ('scan', 'light', 1), ('scan', 'moderate', 2), ('scan', 'heavy', 3), ('photo', 'light', 4), ('photo', 'moderate', 5), ('photo', 'heavy', 6)) AS r(family, severity, rn)
WHERE s.system <> 'delta' OR r.rn = 0
"""


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """28 small rows of systems and rungs are broadcast to the orders."""
    return spark.sql(REPORT_ROWS, orders=load(spark, sf_dir, "orders"))
