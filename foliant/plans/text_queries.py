"""Queries over text steps, rows and names, and over files that are written and read back, each with SQL from the rows."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import tables as T
from foliant.functions import text as X
from foliant.materialise import shared_folder
from foliant.operators import analysis as A
from foliant.operators import projection, routing
from foliant.operators import scoring as S
from foliant.plans import derived as P
from foliant.plans.sheet_queries import _ROUTES, page_routes
from foliant.plans.statement_queries import _ROWS
from foliant.policy import STANDARD
from foliant.sources import runs


def _folder(spark: SparkSession) -> str:
    """A new folder, shared by the driver and all executors."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# -- text --------------------------------------------------------------------------------------------------------------


def normalised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of both dialects come to the same words: headings, rules, pipes, tags and white space go, case is folded."""
    p = P.statement_pairs(spark, sf_dir, ["exact", "html"])
    return p.select("system", "stem", F.sha2(X.normalise(F.col("prediction"), dataclasses.replace(STANDARD, fold_case=True)), 256).alias("normalised"))


def text_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step by itself over all documents, on texts into which something for it was put."""
    t = F.coalesce(F.col("text"), F.lit(""))
    put = lambda new: F.replace(t, F.lit("e"), F.lit(new))
    steps = {
        "dash": X.fold_dashes(put("–")), "quote": X.fold_quotes(put("’")), "double quote": X.fold_quotes(put("„")), "entity": X._python_step("NFC", True)(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("e"), F.lit("&euml;"))),
        "form": X._python_step("NFC", False)(put("ë")), "html": X.strip_html_tables(put('<TD colspan="2">')), "padded": X.pad_html_tables(put("</tr>")), "heading": X.strip_headings(F.concat(F.lit("  ## "), F.replace(t, F.lit("#"), F.lit("")))),
        "quoted": X.strip_blockquotes(F.concat(F.lit("> "), F.replace(F.replace(t, F.lit(">"), F.lit("")), F.lit("\n"), F.lit("\n> ")))), "colon": X.fold_trailing_colons(F.concat(F.replace(t, F.lit(":"), F.lit("")), F.lit("a:b c: d:"))), "squeezed": X.squeeze(F.concat(F.lit("  "), put(" \t"))),
        "strong": X.strip_emphasis(F.concat(F.lit("__"), F.translate(t, "*_  \n\t", "------"), F.lit("__ **lone"))), "emphasis": X.strip_emphasis(F.concat(F.lit("a *"), F.translate(t, "*_ \n\t", "-----"), F.lit("* b*"))), "pipes": X.strip_pipe_tables(F.concat(F.lit("| "), F.translate(t, "|\n", "- "), F.lit(" |\n|---|:-:|\na|b"))),
    }
    # digests are columns, and names are set beside them: a filter on the size of an array of digests would work each out twice
    docs = S.dealt(P.load(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text"), "doc_id")
    made = docs.select("doc_id", *[F.sha2(v, 256).alias(k) for k, v in steps.items()])
    named = made.select("*", F.explode(F.array(*map(F.lit, steps))).alias("step"))
    return named.select("doc_id", "step", P.each_of("step", {k: F.col(k) for k in steps}).alias("result"))


def row_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the shifted pages, whose blank cells leave no trace in them."""
    rows = T.table_rows(F.col("prediction"))
    p = P.statement_pairs(spark, sf_dir, ["shifted"]).select("stem", F.posexplode(rows).alias("idx", "row"))
    return p.where("idx > 0").select("stem", "idx", F.replace(T.row_signature(F.col("row")), F.lit("\u0001"), F.lit("/")).alias("signature"), F.size("row").alias("cells"))


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The viewer's split keeps blank outer cells, the scorer's does not."""
    line = F.concat(F.lit("|| "), F.col("s_name"), F.lit(" | "), F.col("s_nationkey").cast("string"), F.lit(" ||"))
    return P.load(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(T.split_row(line), "/").alias("viewed"), F.array_join(T.table_rows(line)[0], "/").alias("scored"))


def names_and_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names of systems, where they have one, and the condition that a folder's name ends with."""
    c = P.load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("model-"), F.col("c_nationkey").cast("string")).alias("system"), F.concat(F.lit("parsing_"), F.element_at(F.array(*map(F.lit, ("scan-light", "photo-heavy", "2026"))), F.col("c_custkey").cast("int") % 3 + 1)).alias("folder"))
    short = P.load(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("model-"), F.col("n_nationkey").cast("string")).alias("system"), F.col("n_name").alias("short"))
    return A.short_names(c, short).select("c_custkey", "short", A.condition("folder", ["scan-light", "photo-heavy", "heavy"]).alias("condition"), projection.tier_of(F.col("folder")).alias("tier"), runs.corpus_stamp(F.col("folder")).alias("stamp"))


def uneven_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose lists differ in length: orders whose lines are not all of one return flag, each flag's lines being a list."""
    li = P.load(spark, sf_dir, "lineitem")
    each = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == flag, F.col("l_linenumber")))), lambda x: x.cast("string")), " | ")
    cases = li.groupBy(F.col("l_orderkey").alias("case_id")).agg(each("A").alias("dates"), each("N").alias("descriptions"), each("R").alias("paid"))
    return projection.uneven_statements(cases.where("dates <> '' and descriptions <> '' and paid <> ''"), "dates", "descriptions", "paid").select("case_id")


def prompt_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document is sent, if a rule line stands behind its first line: digest and words."""
    d = P.load(spark, sf_dir, "documents").where("text <> ''")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("For whoever runs this."), F.lit("\n---\n"), F.col("text"))).otherwise(F.col("text"))
    body = runs.prompt_body(text)
    return d.select("doc_id", F.sha2(body, 256).alias("sha256"), S.D.word_count(body).alias("words"))


# -- files -------------------------------------------------------------------------------------------------------------


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest that was written and read, old records without labels among them."""
    o = P.load(spark, sf_dir, "orders")
    stem = F.concat(F.lit("CASE"), F.col("o_orderkey").cast("string"), F.lit("_invoices"))
    records = o.select(F.concat(F.lit("images/"), stem, F.lit(".png")).alias("image"), F.concat(F.lit("transcripts/"), stem, F.lit(".md")).alias("transcript"), F.lit("invoices").alias("doc_type"), F.sha2(stem, 256).alias("sha256"), F.when(F.col("o_orderstatus") != "P", "scan").alias("family"), F.when(F.col("o_orderstatus") == "F", "heavy").alias("severity"))
    path = _folder(spark)
    runs.write_manifest(records, path)
    return runs.manifest(spark, path).select(runs.stem_of(F.col("image")).alias("stem"), "doc_type", "sha256", "family", "severity")


def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page facts with their run's throughput, written as results, and read from the flat table; every other nation has no prompt stamp."""
    rows = P.report_rows(spark, sf_dir).where("severity = 'clean'").select("system", "stem", "amounts", F.when(F.col("system") > "b", F.sha2("system", 256)).alias("prompt_sha256"))
    timing = P.load(spark, sf_dir, "supplier").selectExpr("element_at(array('alpha', 'beta', 'gamma', 'delta'), int(s_suppkey % 4) + 1) as system", "cast(s_suppkey as int) as shard", "4 as shards", "1L as cards", "100L as images", "double(10 + s_suppkey % 7) as inference_seconds", "false as includes_model_load")
    speed = runs.work.shard_rollup(timing).select("system", "images", "seconds", "deployment")
    path = _folder(spark)
    runs.write_results(runs.run_rows(rows, speed), ["system", "prompt_sha256", "images", "seconds", "deployment"], path)
    read = spark.read.csv(f"{path}/csv", header=True, schema="system string, prompt_sha256 string, images long, seconds double, deployment string, stem string, amounts long")
    nested = spark.read.json(f"{path}/json", schema="system string, documents array<struct<stem:string,amounts:long>>").select("system", F.explode("documents").alias("d")).groupBy("system").agg(F.sum("d.amounts").alias("nested_amounts"))
    return read.groupBy("system", "prompt_sha256", "images", "seconds", "deployment").agg(F.count("*").alias("pages"), F.sum("amounts").alias("amounts")).join(nested, "system")


def extraction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines and as a table, and read from both."""
    o = P.load(spark, sf_dir, "orders").select(F.concat(F.lit("CASE"), F.col("o_orderkey").cast("string"), F.lit("_bank_statement.png")).alias("filename"), F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('", | x')).alias("amounts"))
    path = _folder(spark)
    runs.write_extraction(o, path)
    flat = spark.read.csv(f"{path}/csv", header=True, schema="image_file string, amounts string", escape="\\")
    lines = spark.read.json(f"{path}/jsonl", schema="filename string, amounts string")
    return lines.join(flat.select(F.col("image_file").alias("filename"), F.col("amounts").alias("flat")), "filename").select("filename", "amounts", "flat")


def flat_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with unlike columns under one header, in order of first sight, read back from the table."""
    n, r = P.load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_regionkey"), P.load(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    path = _folder(spark)
    runs.write_flat([n, r], path)
    return spark.read.csv(path, header=True, schema="name string, n_regionkey long, s_suppkey long")


def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that were routed and written: what a reader of predictions sees, and what is set aside."""
    path = _folder(spark)
    routing.write_routes(page_routes(spark, sf_dir).where("conflict is null"), path)
    read = lambda name: spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("place"), "system", "stem", "text")
    both: DataFrame = read("predictions").unionByName(read("_truncated")).unionByName(read("_unproduced"))
    return both.groupBy("place", "system").agg(F.count("*").alias("pages"), F.count("text").alias("texts"))


def _put(new: str) -> str:
    return f"replace(t, 'e', '{new}')"


_STEPS: dict[str, str] = {
    "dash": _put("-"), "quote": _put("''"), "double quote": _put('"'), "entity": _put("ë"), "form": _put("ë"), "html": _put(" "), "padded": _put(" </tr> "), "heading": "replace(t, '#', '')", "quoted": "replace(t, '>', '')", "colon": "concat(replace(t, ':', ''), 'a:b c d')",
    "squeezed": r"trim(regexp_replace(replace(t, 'e', ' '), '[ \t\n\r\f\v\x{1c}-\x{1f}\x{85}\x{a0}\x{2003}]+', ' ', 'g'), ' ')", "strong": "concat(translate(t, concat('*_', chr(160), ' ', chr(10), chr(9)), '------'), ' **lone')",
    "emphasis": "concat('a ', translate(t, concat('*_ ', chr(10), chr(9)), '-----'), ' b*')", "pipes": "concat('  ', translate(t, concat('|', chr(10)), '- '), '  ', chr(10), 'a|b')",
}
_DOLLARS = "concat('$', format('{:,}', x // 100), '.', lpad(CAST(x % 100 AS VARCHAR), 2, '0'))"


def _money(x: str) -> str:
    return _DOLLARS.replace("x", x)


QUERIES = {f.__name__: f for f in (normalised_pages, text_steps, row_signatures, split_rows, names_and_conditions, uneven_statements, prompt_bodies, manifest_scan, results_table, extraction_files, flat_union, routed_files)}

ORACLES = {
    "normalised_pages": _ROWS + f""", n AS (SELECT stem, concat('statement date description debit credit balance ', string_agg(lower(concat_ws(' ', date, description, {_money('cents')}, {_money('balance')})), ' ' ORDER BY rn)) AS t FROM o GROUP BY stem)
        SELECT system, stem, sha256(t) AS normalised FROM n CROSS JOIN (VALUES ('exact'), ('html')) AS z(system)""",
    "text_steps": "WITH d AS (SELECT doc_id, text AS t FROM documents WHERE text <> '') " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS step, sha256({v}) AS result FROM d" for k, v in _STEPS.items()),
    "row_signatures": _ROWS + f"SELECT stem, CAST(rn AS INT) AS idx, concat_ws('/', date, description, {_money('cents')}, {_money('balance')}) AS signature, 6 AS cells FROM o",
    "split_rows": "SELECT s_suppkey, concat('/', s_name, '/', CAST(s_nationkey AS VARCHAR), '/') AS viewed, concat(s_name, '/', CAST(s_nationkey AS VARCHAR)) AS scored FROM supplier",
    "names_and_conditions": """WITH c AS (SELECT c_custkey, c_nationkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'scan-light' WHEN 1 THEN 'photo-heavy' ELSE '2026' END AS tier FROM customer)
        SELECT c_custkey, coalesce(n_name, concat('model-', CAST(k AS VARCHAR))) AS short, CASE WHEN tier = '2026' THEN 'clean' ELSE tier END AS condition, tier, tier AS stamp FROM c LEFT JOIN nation ON n_nationkey = k AND k % 2 = 0""",
    "uneven_statements": "WITH g AS (SELECT l_orderkey AS case_id, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT case_id FROM g WHERE a > 0 AND n > 0 AND r > 0 AND (a <> n OR n <> r)",
    "prompt_bodies": r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 AND contains(text, concat(chr(10), '---', chr(10))) THEN substr(text, strpos(text, concat(chr(10), '---', chr(10))) + 5) ELSE text END AS t FROM documents WHERE text <> ''), b AS (SELECT doc_id, trim(t, concat(' ', chr(9), chr(13), chr(10))) AS t FROM d)
        SELECT doc_id, sha256(t) AS sha256, len(list_filter(regexp_split_to_array(t, '[ \t\n\r\f\v\x{1c}-\x{1f}\x{85}\x{a0}]+'), lambda x: x <> '')) AS words FROM b""",
    "manifest_scan": "SELECT concat('CASE', CAST(o_orderkey AS VARCHAR), '_invoices') AS stem, 'invoices' AS doc_type, sha256(concat('CASE', CAST(o_orderkey AS VARCHAR), '_invoices')) AS sha256, CASE WHEN o_orderstatus <> 'P' THEN 'scan' END AS family, CASE WHEN o_orderstatus = 'F' THEN 'heavy' END AS severity FROM orders",
    "results_table": "WITH r AS (" + P.REPORT_ROWS.replace("{orders}", "orders").replace("STRING", "VARCHAR") + """), tm AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE 'delta' END AS system, count(*) AS n, max(CAST(10 + s_suppkey % 7 AS DOUBLE)) AS seconds FROM supplier GROUP BY 1)
        SELECT r.system, CASE WHEN r.system > 'b' THEN sha256(r.system) END AS prompt_sha256, 100 * n AS images, seconds, concat('dp=', CAST(n AS VARCHAR)) AS deployment, count(*) AS pages, CAST(sum(amounts) AS BIGINT) AS amounts, CAST(sum(amounts) AS BIGINT) AS nested_amounts FROM r JOIN tm USING (system) WHERE severity = 'clean' GROUP BY r.system, n, seconds""",
    "extraction_files": """SELECT concat('CASE', CAST(o_orderkey AS VARCHAR), '_bank_statement.png') AS filename, concat('say "', o_orderpriority, '", | x') AS amounts, amounts AS flat FROM orders""",
    "routed_files": _ROUTES + "SELECT CASE route WHEN 'written' THEN 'predictions' WHEN 'truncated' THEN '_truncated' ELSE '_unproduced' END AS place, system, count(*) AS pages, count(text) AS texts FROM r WHERE conflict IS NULL AND route <> 'pending' GROUP BY 1, 2",
    "flat_union": "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(NULL AS BIGINT) AS s_suppkey FROM nation UNION ALL SELECT s_name, NULL, CAST(s_suppkey AS BIGINT) FROM supplier",
}
