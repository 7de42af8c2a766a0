"""Queries over derived pages: scores read off text, with oracles that see only the rows that the text was made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import numbers as N
from foliant.functions import tables as T
from foliant.operators import scoring as S
from foliant.plans import derived as P

# -- prose -------------------------------------------------------------------------------------------------------------


def prose_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are dealt out before their systems are set beside them: a tenth of the text is shuffled, and no file's task makes all its pages."""
    return S.character_facts(P.prose_pairs(spark, sf_dir, lambda d: S.truth_lengths(S.dealt(d, "stem")))).drop("truth", "prediction")


def doc_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose_scores(spark, sf_dir).select("system", "stem", "strict_char_distance", "strict_chars", "strict_cer")


def doc_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose_scores(spark, sf_dir).select("system", "stem", "strict_word_distance", "strict_words", "strict_wer")


def score_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.micro(prose_scores(spark, sf_dir))


def score_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.macro(prose_scores(spark, sf_dir))
    return m.select("system", F.round("macro_cer", 9).alias("macro_cer"), F.round("macro_wer", 9).alias("macro_wer"))


def normalised_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks around a page vanish in the normalised text unless its own marks pair up with them."""
    p = P.prose_pairs(spark, sf_dir).where("system in ('emphatic', 'identity') and not contains(truth, '*') and not contains(truth, '_') and truth rlike '^\\\\S' and truth rlike '\\\\S$'")
    p = p.withColumns({"nt": S.X.normalise(F.col("truth"), S.STANDARD), "np": S.X.normalise(F.col("prediction"), S.STANDARD)})
    return p.groupBy("system").agg(F.count("*").alias("documents"), F.count_if(F.col("nt") == F.col("np")).alias("same"))


PROSE = r"""
WITH d AS (SELECT concat('CASE', CAST(doc_id AS VARCHAR), '_documents') AS stem, coalesce(text, '') AS t,
                  CAST(length(coalesce(text, '')) AS BIGINT) AS chars,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT stem, chars, CAST(len(w) AS BIGINT) AS words, CAST(length(t) - length(replace(t, 'e', '')) AS BIGINT) AS e, CAST(len(list_filter(w, lambda x: contains(x, 'e'))) AS BIGINT) AS we,
           regexp_matches(t, '^[ \t\n\r\f\v]') AS head, regexp_matches(t, '[ \t\n\r\f\v]$') AS tail FROM d),
s AS (SELECT 'identity' AS system, stem, chars, words, CAST(0 AS BIGINT) AS cd, CAST(0 AS BIGINT) AS wd FROM f
      UNION ALL SELECT 'sloppy', stem, chars, words, e, we FROM f
      UNION ALL SELECT 'appended', stem, chars, words, 8, 2 FROM f
      UNION ALL SELECT 'unproduced', stem, chars, words, chars, words FROM f
      UNION ALL SELECT 'emphatic', stem, chars, words, 4, CASE WHEN words = 0 THEN CASE WHEN chars = 0 THEN 1 ELSE 2 END WHEN words = 1 AND NOT head AND NOT tail THEN 1 ELSE 2 END FROM f),
r AS (SELECT *, CASE WHEN chars = 0 THEN CASE WHEN cd = 0 THEN 0.0 ELSE 1.0 END ELSE CAST(cd AS DOUBLE) / chars END AS cer,
                CASE WHEN words = 0 THEN CASE WHEN wd = 0 THEN 0.0 ELSE 1.0 END ELSE CAST(wd AS DOUBLE) / words END AS wer FROM s)
"""

# -- statements --------------------------------------------------------------------------------------------------------


def statement_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.column_facts(S.with_rows(P.statement_pairs(spark, sf_dir, about=S.truth_tables)))


COLUMNS = ["amounts", "read", "placed", "misfiled", "attributable"]


def column_integrity_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_columns(spark, sf_dir).select("system", "stem", *COLUMNS, "truth_columns", "prediction_columns", "columns_match", "placement_rate")


def column_integrity_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.column_sums(statement_columns(spark, sf_dir))


def column_rates_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.column_rates(S.column_sums(statement_columns(spark, sf_dir)))


def modal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.with_rows(P.statement_pairs(spark, sf_dir, about=lambda c: S.adding(c, {"truth_rows": T.table_rows(F.col("truth"))})))
    return p.groupBy("system", T.modal_width(F.col("prediction_rows")).alias("width")).agg(F.count("*").alias("pages"))


def table_structure(spark: SparkSession, sf_dir: str, systems: list[str] = P.SYSTEMS) -> DataFrame:
    return S.table_facts(S.with_rows(P.statement_pairs(spark, sf_dir, systems, S.truth_cells)))


def fragments_and_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a system more, whose every other row has a cell too many."""
    p = table_structure(spark, sf_dir, [*P.SYSTEMS, "ragged"]).groupBy("system")
    return p.agg(*[F.sum(c).alias(c) for c in ("n_truth_rows", "n_prediction_rows", "fragments", "width_breaks")])


def content_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_structure(spark, sf_dir).select("system", "stem", "recalled_cells", "truth_cells", "content_recall")


def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table_sums(table_structure(spark, sf_dir))


def amount_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bag of amounts of each page: as value and number of times. A page's bag is of its own row, so nothing is gathered by pages and values."""
    p = P.statement_pairs(spark, sf_dir, about=S.truth_numbers)
    b = p.select("system", "stem", F.explode(N.amount_bags(F.col("wt"), F.col("prediction"))).alias("b"))
    return b.select("system", "stem", F.replace(F.replace("b.value", F.lit(",")), F.lit(".")).cast("long").alias("cents"), "b.n_t", "b.n_p")


def numeric_fidelity_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.number_facts(P.statement_pairs(spark, sf_dir, about=S.truth_numbers))
    return n.select("system", "stem", "truth_amounts", "prediction_amounts", "amounts_correct", "literal")


def numeric_fidelity_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the greedy split of what is wrong."""
    return S.number_sums(S.number_facts(P.statement_pairs(spark, sf_dir, about=S.truth_numbers)))


def canonical_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of amounts and of balances, which go beyond a million."""
    lines = P.statement_lines(spark, sf_dir).select(F.explode(F.array("cents", "balance")).alias("cents"))
    return lines.select("cents", F.replace(P.dollars(F.col("cents")), F.lit("$")).alias("token")).distinct().select("cents", N.canonical(F.col("token")).alias("canonical"))


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hunks(P.statement_pairs(spark, sf_dir))


def divergence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.divergence_groups(S.word_spans(P.statement_pairs(spark, sf_dir)))


def top_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_divergences(divergence_groups(spark, sf_dir))


def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.failure_taxonomy(S.number_facts(S.column_facts(S.with_rows(P.statement_pairs(spark, sf_dir, about=lambda c: S.truth_numbers(S.truth_tables(c)))))))


def full_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.doc_scores(P.statement_pairs(spark, sf_dir), deal=False)


def headerless_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank header vanishes, the first data row is taken for it, and its amounts cannot be attributed."""
    c = P.statement_corpus(spark, sf_dir, [""] * 5)
    f = S.column_facts(S.with_rows(c.select(F.lit("self").alias("system"), "stem", "truth", F.col("truth").alias("prediction"))))
    return f.groupBy("system").agg(F.count("*").alias("pages"), F.sum("amounts").alias("amounts"), F.sum("attributable").alias("attributable"))


_ROWS = """
WITH o AS (SELECT concat('CASE', CAST(l_orderkey AS VARCHAR), '_bank_statements') AS stem, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_returnflag = 'R' AS debit,
                  strftime(l_shipdate, '%d/%m/%Y') AS date, concat('Part ', CAST(l_partkey AS VARCHAR), ' Supplier ', CAST(l_suppkey AS VARCHAR)) AS description,
                  row_number() OVER w AS rn, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance
           FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)),
y AS (SELECT * FROM (VALUES ('exact'), ('html'), ('shifted'), ('orphaned'), ('misread'), ('dropper')) AS y(system)),
p AS (SELECT system, stem, rn, debit, CASE WHEN system IN ('shifted', 'orphaned') THEN '' ELSE date END AS key, date, description,
             CASE WHEN system = 'misread' AND rn % 3 = 0 THEN cents - cents % 10 + (cents % 10 + 1) % 10 ELSE cents END AS cents, balance,
             CASE WHEN system = 'shifted' THEN 1 ELSE 0 END AS shift
      FROM o CROSS JOIN y WHERE NOT (system = 'dropper' AND rn % 4 = 0)),
ta AS (SELECT stem, cents, CASE WHEN debit THEN 2 ELSE 3 END AS col, date AS key FROM o UNION ALL SELECT stem, balance, 4, date FROM o),
t AS (SELECT system, ta.* FROM ta CROSS JOIN y),
a AS (SELECT system, stem, cents, CASE WHEN debit THEN 2 ELSE 3 END + shift AS col, key FROM p UNION ALL SELECT system, stem, balance, 4 + shift, key FROM p)
"""


def _bag(name: str, key: str) -> str:
    """Size of the bag intersection of t and a on a key, for each system and page."""
    return f"""{name} AS (SELECT system, stem, CAST(sum(least(x.n, z.n)) AS BIGINT) AS n FROM (SELECT system, stem, {key}, count(*) AS n FROM t GROUP BY ALL) x
    JOIN (SELECT system, stem, {key}, count(*) AS n FROM a GROUP BY ALL) z USING (system, stem, {key}) GROUP BY system, stem)"""


_DOC = (
    _ROWS + "," + ",\n".join([_bag("rd", "cents"), _bag("pl", "cents, col"), _bag("ab", "cents, col, key")])
    + """,
n AS (SELECT system, stem, count(*) AS amounts FROM t GROUP BY ALL),
doc AS (SELECT system, stem, amounts, coalesce(rd.n, 0) AS read, coalesce(pl.n, 0) AS placed, amounts - coalesce(pl.n, 0) AS misfiled, coalesce(ab.n, 0) AS attributable, 5 AS truth_columns,
               CASE WHEN system = 'shifted' THEN 6 ELSE 5 END AS prediction_columns, system <> 'shifted' AS columns_match,
               CASE WHEN coalesce(rd.n, 0) > 0 THEN CAST(coalesce(pl.n, 0) AS DOUBLE) / rd.n END AS placement_rate
        FROM n LEFT JOIN rd USING (system, stem) LEFT JOIN pl USING (system, stem) LEFT JOIN ab USING (system, stem))
"""
)
_SUMS = "CAST(sum(amounts) AS BIGINT) AS amounts, CAST(sum(read) AS BIGINT) AS read, CAST(sum(placed) AS BIGINT) AS placed, CAST(sum(misfiled) AS BIGINT) AS misfiled, CAST(sum(attributable) AS BIGINT) AS attributable"

#: A wrong last digit is an edit, unless it makes or ends whole dollars, whose canonical form has no decimals.
_NUMBERS = _ROWS + """, tt AS (SELECT system, stem, cents, count(*) AS n FROM t GROUP BY ALL), pp AS (SELECT system, stem, cents, count(*) AS n FROM a GROUP BY ALL),
    bag AS (SELECT system, stem, cents, coalesce(tt.n, 0) AS n_t, coalesce(pp.n, 0) AS n_p FROM tt FULL JOIN pp USING (system, stem, cents)),
    odd AS (SELECT system, stem, x.cents, x.n_t - x.n_p AS lost, z.n_p - z.n_t AS made FROM bag x JOIN bag z USING (system, stem) WHERE x.n_t > x.n_p AND z.n_p > z.n_t AND z.cents = x.cents - x.cents % 10 + (x.cents % 10 + 1) % 10 AND x.cents % 100 NOT IN (0, 9)),
    mis AS (SELECT system, stem, sum(least(lost, made)) AS misread FROM odd GROUP BY ALL),
    num AS (SELECT system, stem, sum(n_t) AS truth_amounts, sum(n_p) AS prediction_amounts, sum(least(n_t, n_p)) AS amounts_correct FROM bag GROUP BY ALL),
    nd AS (SELECT *, coalesce(misread, 0) AS wrong, truth_amounts - amounts_correct - coalesce(misread, 0) AS dropped, prediction_amounts - amounts_correct - coalesce(misread, 0) AS invented FROM num LEFT JOIN mis USING (system, stem))"""


QUERIES = {f.__name__: f for f in (doc_cer, doc_wer, score_micro, score_macro, normalised_emphasis, column_integrity_doc, column_integrity_system, column_rates_system, modal_width, fragments_and_breaks, content_recall, aligned_rows, amount_bag, numeric_fidelity_doc, numeric_fidelity_system, canonical_amounts, hunks, divergence_groups, top_divergences, failure_taxonomy, full_scores, headerless_attribution)}

_RECALL = """, h AS (SELECT DISTINCT stem FROM o), hv AS (SELECT * FROM (VALUES ('h1'), ('h2'), ('h3'), ('h4'), ('h5')) AS hv(v)),
        tv AS (SELECT stem, v FROM (SELECT stem, unnest([date, description, CAST(cents AS VARCHAR), CAST(balance AS VARCHAR)]) AS v FROM o UNION ALL SELECT stem, v FROM h CROSS JOIN hv)),
        pv AS (SELECT system, stem, v FROM (SELECT system, stem, unnest([date, description, CAST(cents AS VARCHAR), CAST(balance AS VARCHAR)]) AS v FROM p UNION ALL SELECT system, stem, v FROM h CROSS JOIN hv CROSS JOIN y)),
        tc AS (SELECT stem, v, count(*) AS n FROM tv GROUP BY ALL), pc AS (SELECT system, stem, v, count(*) AS n FROM pv GROUP BY ALL),
        rr AS (SELECT system, stem, CAST(sum(least(tc.n, pc.n)) AS BIGINT) AS recalled_cells FROM tc JOIN pc USING (stem, v) GROUP BY system, stem), rc AS (SELECT stem, count(*) AS truth_cells FROM tv GROUP BY stem),
        recall AS (SELECT system, stem, recalled_cells, truth_cells, CAST(recalled_cells AS DOUBLE) / truth_cells AS content_recall FROM rr JOIN rc USING (stem))"""


ORACLES = {
    "doc_cer": PROSE + "SELECT system, stem, cd AS strict_char_distance, chars AS strict_chars, cer AS strict_cer FROM r",
    "doc_wer": PROSE + "SELECT system, stem, wd AS strict_word_distance, words AS strict_words, wer AS strict_wer FROM r",
    "score_micro": PROSE + "SELECT system, CAST(sum(cd) AS BIGINT) AS char_distance, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(wd) AS BIGINT) AS word_distance, CAST(sum(words) AS BIGINT) AS words, CAST(sum(cd) AS DOUBLE) / sum(chars) AS cer, CAST(sum(wd) AS DOUBLE) / sum(words) AS wer FROM r GROUP BY system",
    "score_macro": PROSE + "SELECT system, round(avg(cer), 9) AS macro_cer, round(avg(wer), 9) AS macro_wer FROM r GROUP BY system",
    "normalised_emphasis": r"""WITH d AS (SELECT text FROM documents WHERE NOT contains(text, '*') AND NOT contains(text, '_') AND regexp_matches(text, '^\S') AND regexp_matches(text, '\S$'))
        SELECT system, count(*) AS documents, count(*) AS same FROM d CROSS JOIN (VALUES ('identity'), ('emphatic')) AS s(system) GROUP BY system""",
    "column_integrity_doc": _DOC + "SELECT * FROM doc",
    "column_integrity_system": _DOC + f"SELECT system, {_SUMS}, count(*) FILTER (NOT columns_match) AS documents_mismatched FROM doc GROUP BY system",
    "column_rates_system": _DOC + "SELECT system, CAST(sum(read) AS DOUBLE) / sum(amounts) AS read_rate, CAST(sum(placed) AS DOUBLE) / sum(read) AS placed_rate, CAST(sum(placed) AS DOUBLE) / sum(amounts) AS usable_placed_rate, CAST(sum(attributable) AS DOUBLE) / sum(amounts) AS usable_attributable_rate FROM doc GROUP BY system",
    "modal_width": _ROWS + "SELECT system, CASE WHEN system = 'shifted' THEN 6 ELSE 5 END AS width, count(DISTINCT stem) AS pages FROM t GROUP BY system",
    "fragments_and_breaks": _ROWS + """SELECT y.system, (SELECT count(*) + count(DISTINCT stem) FROM o) AS n_truth_rows,
        (SELECT count(*) FROM p WHERE p.system = y.system) * CASE WHEN y.system = 'orphaned' THEN 2 ELSE 1 END + (SELECT count(DISTINCT stem) FROM o) AS n_prediction_rows,
        CASE WHEN y.system = 'orphaned' THEN (SELECT count(*) FROM o) ELSE 0 END AS fragments, CAST(0 AS BIGINT) AS width_breaks FROM y
        UNION ALL SELECT 'ragged', count(*) + count(DISTINCT stem), count(*) + count(DISTINCT stem), 0, count(*) FILTER (rn % 2 = 0) FROM o""",
    "content_recall": _ROWS + _RECALL + " SELECT * FROM recall",
    "amount_bag": _ROWS + """, tt AS (SELECT system, stem, cents, count(*) AS n FROM t GROUP BY ALL), pp AS (SELECT system, stem, cents, count(*) AS n FROM a GROUP BY ALL)
        SELECT system, stem, cents, coalesce(tt.n, 0) AS n_t, coalesce(pp.n, 0) AS n_p FROM tt FULL JOIN pp USING (system, stem, cents)""",
    "numeric_fidelity_doc": _ROWS + "," + _bag("rd", "cents") + """, nt AS (SELECT system, stem, count(*) AS n FROM t GROUP BY ALL), np AS (SELECT system, stem, count(*) AS n FROM a GROUP BY ALL)
        SELECT system, stem, nt.n AS truth_amounts, coalesce(np.n, 0) AS prediction_amounts, coalesce(rd.n, 0) AS amounts_correct, coalesce(rd.n, 0) AS literal FROM nt LEFT JOIN np USING (system, stem) LEFT JOIN rd USING (system, stem)""",
    "numeric_fidelity_system": _NUMBERS + """SELECT system, CAST(sum(truth_amounts) AS BIGINT) AS truth_amounts, CAST(sum(prediction_amounts) AS BIGINT) AS prediction_amounts, CAST(sum(amounts_correct) AS BIGINT) AS amounts_correct, CAST(sum(amounts_correct) AS BIGINT) AS literal,
        CAST(sum(wrong) AS BIGINT) AS misread, CAST(sum(dropped) AS BIGINT) AS dropped, CAST(sum(invented) AS BIGINT) AS invented, count(*) FILTER (wrong > 0 OR dropped > 0 OR invented > 0) AS documents_with_an_error FROM nd GROUP BY system""",
    "failure_taxonomy": _NUMBERS + _DOC.removeprefix(_ROWS) + """SELECT system, CAST(sum(amounts) AS BIGINT) AS amounts, CAST(sum(wrong) AS BIGINT) AS misread, CAST(sum(dropped) AS BIGINT) AS dropped, CAST(sum(read - placed) AS BIGINT) AS misplaced, CAST(sum(placed - attributable) AS BIGINT) AS orphaned,
        CAST(sum(wrong + read - attributable) AS BIGINT) AS silently_wrong FROM doc JOIN nd USING (system, stem) GROUP BY system""",
    "aligned_rows": _ROWS + _RECALL + """, q AS (SELECT stem, count(*) AS n, count(*) FILTER (rn % 3 <> 0) AS read, count(*) FILTER (rn % 4 <> 0) AS kept FROM o GROUP BY stem)
        SELECT system, CAST(sum(n + 1) AS BIGINT) AS n_truth_rows, CAST(sum(1 + CASE system WHEN 'orphaned' THEN 0 WHEN 'misread' THEN read WHEN 'dropper' THEN kept ELSE n END) AS BIGINT) AS aligned, CAST(sum(CASE WHEN system = 'orphaned' THEN n ELSE 0 END) AS BIGINT) AS fragments, CAST(0 AS BIGINT) AS width_breaks,
          (SELECT CAST(sum(recalled_cells) AS BIGINT) FROM recall WHERE recall.system = y.system) AS recalled_cells, (SELECT CAST(sum(truth_cells) AS BIGINT) FROM recall WHERE recall.system = y.system) AS truth_cells FROM q CROSS JOIN y GROUP BY system""",
    "canonical_amounts": _ROWS + """SELECT DISTINCT cents, concat(CAST(cents // 100 AS VARCHAR), CASE WHEN cents % 100 = 0 THEN '' WHEN cents % 10 = 0 THEN concat('.', CAST(cents % 100 // 10 AS VARCHAR)) ELSE concat('.', lpad(CAST(cents % 100 AS VARCHAR), 2, '0')) END) AS canonical FROM (SELECT cents FROM o UNION SELECT balance FROM o)""",
    "headerless_attribution": _ROWS + "SELECT 'self' AS system, count(DISTINCT stem) AS pages, CAST(2 * count(*) AS BIGINT) AS amounts, CAST(2 * count(*) - 2 * count(DISTINCT stem) AS BIGINT) AS attributable FROM o",
}
