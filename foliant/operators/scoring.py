"""Scoring predictions against a corpus: pairing, per-document facts, per-system aggregates, divergences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.errors import Refusal, some
from foliant.functions import align
from foliant.functions import cells as C
from foliant.functions import distance as D
from foliant.functions import numbers as N
from foliant.functions import pages
from foliant.functions import tables as T
from foliant.functions import text as X
from foliant.operators.bags import intersection_size
from foliant.policy import STANDARD, Policy

PAIR = ["system", "stem"]


# -- pairing -----------------------------------------------------------------------------------------------------------


def expected_pairs(corpus: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every system with every stem of the corpus; systems are few."""
    return corpus.select("stem").crossJoin(F.broadcast(predictions.select("system").distinct()))


def missing_predictions(corpus: DataFrame, predictions: DataFrame, unproduced: DataFrame | None = None) -> DataFrame:
    lost = expected_pairs(corpus, predictions).join(predictions.select(*PAIR), PAIR, "left_anti")
    return lost if unproduced is None else lost.join(unproduced.select(*PAIR), PAIR, "left_anti")


def extra_predictions(corpus: DataFrame, predictions: DataFrame) -> DataFrame:
    return predictions.select(*PAIR).join(corpus.select("stem"), "stem", "left_anti").select(*PAIR)


def declared_but_present(predictions: DataFrame, unproduced: DataFrame) -> DataFrame:
    return predictions.select(*PAIR).join(unproduced.select(*PAIR), PAIR, "left_semi")


def refuse_untyped(rows: DataFrame) -> None:
    """Stems that say no document type: nothing after the first underscore, or none."""
    bad = [r["stem"] for r in rows.where("stem is null or stem not rlike '^[^_]*_.+$'").select("stem").distinct().limit(6).collect()]
    if bad:
        raise Refusal(f"stems without a document type: {some(list(map(str, bad)), len(bad))}", "stems", "<case>_<type>", "name the pages by case and type")


def refuse_any(rows: DataFrame, what: str, recover: str) -> None:
    first = rows.limit(6).collect()
    if first:
        names = ["/".join(str(x) for x in r) for r in first]
        raise Refusal(f"{what}: {some(names, rows.count())}", "pairing", "each system has each stem once, or declares it unproduced", recover)


def pairs(corpus: DataFrame, predictions: DataFrame, unproduced: DataFrame | None = None, check: bool = True) -> DataFrame:
    """system, stem, truth, prediction, is_unproduced; an unproduced page counts as the empty prediction."""
    if check:
        refuse_any(missing_predictions(corpus, predictions, unproduced), "predictions are missing", "produce them, or declare them unproduced")
        refuse_any(extra_predictions(corpus, predictions), "predictions have no transcript", "remove them, or score the corpus they belong to")
        if unproduced is not None:
            refuse_any(declared_but_present(predictions, unproduced), "pages are declared unproduced but are there", "remove the declaration or the page")
    every = predictions.select(*PAIR, "prediction", F.lit(False).alias("is_unproduced"))
    if unproduced is not None:
        every = every.unionByName(unproduced.select(*PAIR, F.lit("").alias("prediction"), F.lit(True).alias("is_unproduced")))
    return corpus.select("stem", "truth").join(every, "stem").select(*PAIR, "truth", "prediction", "is_unproduced")


# -- per-document facts ------------------------------------------------------------------------------------------------


def dealt(p: DataFrame, *by: str) -> DataFrame:
    """Pages dealt out by their names, or by other columns: their costs differ by far, and whole runs of long ones may stand in one file.

    Over as many partitions as the session sets: texts shrink so much in a shuffle that partitions merged by size would leave few tasks."""
    return p.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(by or PAIR))


def truth_lengths(p: DataFrame, left: str = "truth", prefix: str = "strict") -> DataFrame:
    """Adds what character_facts needs of the truth alone. A corpus is given it once, before its systems join."""
    return adding(p, {f"{prefix}_chars": F.length(left).cast("long"), f"{prefix}_words": D.word_count(F.col(left))})


def character_facts(p: DataFrame, left: str = "truth", right: str = "prediction", prefix: str = "strict") -> DataFrame:
    """Adds <prefix>_char_distance, _chars, _word_distance, _words, _cer, _wer."""
    a, b = F.col(left), F.col(right)
    p = p.withColumn("_d", D.distances(a, b))
    p = truth_lengths(p.withColumns({f"{prefix}_char_distance": F.col("_d.chars"), f"{prefix}_word_distance": F.col("_d.words")}), left, prefix).drop("_d")
    rate = lambda k, n: D.error_rate(F.col(f"{prefix}_{k}_distance"), F.col(f"{prefix}_{n}"))
    return p.withColumns({f"{prefix}_cer": rate("char", "chars"), f"{prefix}_wer": rate("word", "words")})


def adding(p: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """With those of the columns that are not there yet."""
    return p.withColumns({k: c for k, c in columns.items() if k not in p.columns})


def truth_tables(p: DataFrame) -> DataFrame:
    """Adds what column_facts needs of the truth alone, and its rows. A corpus (stem, truth) is given it once, before its systems join."""
    p = adding(p, {"truth_rows": T.table_rows(F.col("truth"))})
    return p if "pt" in p.columns else p.withColumn("_t", C.placed_amounts(F.col("truth"))).withColumns({"pt": F.col("_t.amounts"), "tw": F.col("_t.width")}).drop("_t")


def truth_cells(p: DataFrame) -> DataFrame:
    """As truth_tables, for table_facts alone."""
    p = adding(p, {"truth_rows": T.table_rows(F.col("truth"))})
    return p if "vt" in p.columns else p.withColumns({"vt": C.cell_values(F.col("truth")), "rt": C.structure(F.col("truth"))})


def truth_numbers(p: DataFrame) -> DataFrame:
    """As truth_tables, for number_facts."""
    return p if "wt" in p.columns else p.withColumn("wt", N.written_amounts(F.col("truth")))


def truth_facts(p: DataFrame) -> DataFrame:
    return truth_numbers(truth_cells(truth_tables(p)))


def with_rows(p: DataFrame) -> DataFrame:
    """Adds the parsed tables truth_rows, prediction_rows; a page like its truth is not read again."""
    p = adding(p, {"truth_rows": T.table_rows(F.col("truth"))})
    return p.withColumn("prediction_rows", F.when(F.col("prediction") == F.col("truth"), F.col("truth_rows")).otherwise(T.table_rows(F.col("prediction"))))


def column_facts(p: DataFrame) -> DataFrame:
    """Adds amounts, read, placed, misfiled, usable_placed, attributable, placement_rate, column counts.

    The document's first row counts as its header, so attribution skips it even where it holds data."""
    p = truth_tables(p).withColumn("_like", F.col("prediction").eqNullSafe(F.col("truth")))
    # pages like their truth have all that it has, and are not read again
    p = p.withColumn("_found", C.found_amounts(F.col("pt"), F.when(~F.col("_like"), F.col("prediction"))))
    shared = lambda own, name: F.when(F.col("_like"), own).otherwise(F.col("_found")[name])
    every, in_body = F.size("pt").cast("long"), F.size(F.filter("pt", lambda x: x["in_body"])).cast("long")
    p = p.withColumns({"amounts": every, "read": shared(every, "read"), "placed": shared(every, "placed"), "attributable": shared(in_body, "attributable"), "truth_columns": F.col("tw"), "prediction_columns": shared(F.col("tw"), "width")})
    return p.withColumns({"misfiled": F.col("amounts") - F.col("placed"), "usable_placed": F.col("placed"), "columns_match": F.col("truth_columns") == F.col("prediction_columns"), "placement_rate": F.try_divide("placed", "read")}).drop("pt", "tw", "_like", "_found")


def strictly_attributable(p: DataFrame, name: str = "attributable_strict") -> DataFrame:
    """From with_rows: adds the amounts that stand under the right heading in a row with the right first two cells, date and description.

    The plain key, the first cell alone, takes two lines of one day for each other. As there, the document's first row is its header."""
    key = lambda r: F.concat_ws("\u0001", T.trim(r[0]), F.coalesce(T.trim(F.get(r, F.lit(1))), F.lit("")))
    cells = lambda rows: F.flatten(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.transform(r, lambda c, j: F.struct(c.alias("amount"), F.concat_ws("\u0001", c, j.cast("string"), key(r)).alias("placed")))))
    own = lambda rows: F.transform(F.filter(cells(rows), lambda x: x["amount"].rlike(T.AMOUNT_CELL)), lambda x: x["placed"])
    return p.withColumn(name, intersection_size(own(F.col("truth_rows")), own(F.col("prediction_rows"))))


def table_facts(p: DataFrame) -> DataFrame:
    """Adds n_truth_rows, n_prediction_rows, aligned, fragments, width_breaks, recalled_cells, truth_cells, content_recall."""
    p = truth_cells(p).withColumn("_like", F.col("prediction").eqNullSafe(F.col("truth")))
    # pages like their truth are not read again
    other = F.when(~F.col("_like"), F.col("prediction"))
    p = p.withColumns({"_recalled": C.recalled(F.col("vt"), other), "_rows": C.structure(other)})
    p = p.withColumns({"st": F.col("rt.signatures"), "sp": F.when(F.col("_like"), F.col("rt.signatures")).otherwise(F.col("_rows.signatures"))})
    p = p.withColumn("plain", align.aligned_plainly(F.col("st"), F.col("sp")))
    sought = lambda c: F.when(F.col("plain").isNull(), F.col(c))
    of_rows = lambda name: F.when(F.col("_like"), F.col("rt")[name]).otherwise(F.col("_rows")[name])
    cells = F.size("vt").cast("long")
    p = p.withColumns({"n_truth_rows": F.size("st").cast("long"), "n_prediction_rows": F.size("sp").cast("long"), "aligned": F.coalesce("plain", align.aligned(sought("st"), sought("sp"))), "fragments": of_rows("fragments"), "width_breaks": of_rows("width_breaks"), "recalled_cells": F.when(F.col("_like"), cells).otherwise(F.col("_recalled")), "truth_cells": cells})
    return p.withColumn("content_recall", F.try_divide("recalled_cells", "truth_cells")).drop("vt", "rt", "st", "sp", "plain", "_like", "_recalled", "_rows")


def number_facts(p: DataFrame) -> DataFrame:
    """truth_amounts, prediction_amounts, amounts_correct (by value), literal (as written), misread, dropped, invented."""
    p = truth_numbers(p).withColumn("_like", F.col("prediction").eqNullSafe(F.col("truth")))
    p = p.withColumn("_held", N.held_amounts(F.col("wt"), F.when(~F.col("_like"), F.col("prediction"))))
    every = F.size("wt").cast("long")
    names = ("prediction_amounts", "amounts_correct", "literal", "misread")
    p = p.withColumns({"truth_amounts": every} | {k: F.when(F.col("_like"), F.lit(0).cast("long") if k == "misread" else every).otherwise(F.col("_held")[k]) for k in names})
    return p.withColumns({"dropped": F.col("truth_amounts") - F.col("amounts_correct") - F.col("misread"), "invented": F.col("prediction_amounts") - F.col("amounts_correct") - F.col("misread")}).drop("wt", "_like", "_held")


def truth_scores(p: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """As truth_tables, for doc_scores."""
    return truth_facts(adding(p, {"nt": X.normalise(F.col("truth"), policy)}))


def doc_scores(p: DataFrame, policy: Policy = STANDARD, deal: bool = True) -> DataFrame:
    """The fact table: one row for each system and stem, with all of the above, strict and normalised.

    Pages are dealt out first, unless they are already; each goes to Python once, with its truth (functions/pages)."""
    kept = [c for c in p.columns if c not in ("truth", "prediction", "truth_rows", "prediction_rows", "nt", "pt", "tw", "vt", "rt", "wt")]
    p = (dealt(p) if deal else p).select(*kept, pages.page_facts(F.col("truth"), F.col("prediction"), policy).alias("_f")).select(*kept, "_f.*")
    rates = {f"{x}_{y}er": D.error_rate(F.col(f"{x}_{k}_distance"), F.col(f"{x}_{k}s")) for x in ("strict", "normalised") for y, k in (("c", "char"), ("w", "word"))}
    p = p.withColumns(rates | {"misfiled": F.col("amounts") - F.col("placed"), "usable_placed": F.col("placed"), "columns_match": F.col("truth_columns") == F.col("prediction_columns"), "placement_rate": F.try_divide("placed", "read"), "content_recall": F.try_divide("recalled_cells", "truth_cells")})
    return p.withColumns({"dropped": F.col("truth_amounts") - F.col("amounts_correct") - F.col("misread"), "invented": F.col("prediction_amounts") - F.col("amounts_correct") - F.col("misread")})


# -- per-system aggregates ---------------------------------------------------------------------------------------------


def micro(scores: DataFrame, prefix: str = "strict", by: tuple[str, ...] = ("system",)) -> DataFrame:
    """Summed distances over summed lengths."""
    s = scores.groupBy(*by).agg(*[F.sum(f"{prefix}_{c}").alias(c) for c in ("char_distance", "chars", "word_distance", "words")])
    return s.withColumns({"cer": D.error_rate(F.col("char_distance"), F.col("chars")), "wer": D.error_rate(F.col("word_distance"), F.col("words"))})


def macro(scores: DataFrame, prefix: str = "strict", by: tuple[str, ...] = ("system",)) -> DataFrame:
    """Unweighted means of documents' rates."""
    return scores.groupBy(*by).agg(F.coalesce(F.avg(f"{prefix}_cer"), F.lit(0.0)).alias("macro_cer"), F.coalesce(F.avg(f"{prefix}_wer"), F.lit(0.0)).alias("macro_wer"))


def column_sums(scores: DataFrame) -> DataFrame:
    return scores.groupBy("system").agg(*[F.sum(c).alias(c) for c in ("amounts", "read", "placed", "misfiled", "attributable")], F.count_if(~F.col("columns_match")).alias("documents_mismatched"))


def column_rates(sums: DataFrame) -> DataFrame:
    """read and attributable over amounts, placed over what was read; null where there is nothing to divide by."""
    return sums.select("system", F.try_divide("read", "amounts").alias("read_rate"), F.try_divide("placed", "read").alias("placed_rate"), F.try_divide("placed", "amounts").alias("usable_placed_rate"), F.try_divide("attributable", "amounts").alias("usable_attributable_rate"))


def table_sums(scores: DataFrame) -> DataFrame:
    names = ("n_truth_rows", "aligned", "fragments", "width_breaks", "recalled_cells", "truth_cells")
    return scores.groupBy("system").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in names])


def number_sums(scores: DataFrame) -> DataFrame:
    names = ("truth_amounts", "prediction_amounts", "amounts_correct", "literal", "misread", "dropped", "invented")
    wrong = (F.col("misread") > 0) | (F.col("dropped") > 0) | (F.col("invented") > 0)
    return scores.groupBy("system").agg(*[F.sum(c).alias(c) for c in names], F.count_if(wrong).alias("documents_with_an_error"))


def failure_taxonomy(scores: DataFrame) -> DataFrame:
    """Documented only: orphaned = placed - attributable; misplaced = read - placed; silently wrong = both and misread."""
    s = scores.groupBy("system").agg(F.sum("amounts").alias("amounts"), F.sum("misread").alias("misread"), F.sum("dropped").alias("dropped"), F.sum(F.col("read") - F.col("placed")).alias("misplaced"), F.sum(F.col("placed") - F.col("attributable")).alias("orphaned"))
    return s.withColumn("silently_wrong", F.col("misread") + F.col("misplaced") + F.col("orphaned"))


# -- divergences -------------------------------------------------------------------------------------------------------

CONVENTION, READING = "convention", "reading"


def word_spans(p: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """system, stem, idx, truth, prediction, same: word spans that differ; same: whether both sides normalise alike, told where spans are found if they are plain, else null."""
    text = lambda c: X.pad_html_tables(F.col(c)) if policy.strip_html_table_marks else F.col(c)
    return p.select(*PAIR, F.explode(align.text_hunks_alike(text("truth"), text("prediction"), policy)).alias("h")).select(*PAIR, "h.idx", "h.truth", "h.prediction", "h.same")


def with_kind(spans: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Adds kind: convention if both sides normalise alike, else reading. Where `same` is there, it says so, and only spans without are looked at."""
    side = lambda c: F.when(F.col("same").isNull(), F.col(c)) if "same" in spans.columns else F.col(c)
    same = X.normalise(side("truth"), policy) == X.normalise(side("prediction"), policy)
    known = [F.col("same")] if "same" in spans.columns else []
    return spans.withColumn("kind", F.when(F.coalesce(*known, same), CONVENTION).otherwise(READING)).drop("same")


def hunks(p: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """system, stem, idx, truth, prediction, kind: word spans that differ."""
    return with_kind(word_spans(p, policy), policy)


def rate_tables(scores: DataFrame) -> DataFrame:
    """system, and the rates of the four tables that a run shows: characters, words, columns, amounts; in the order of the systems' names.

    Rates over nothing are null. digit recall is over the truth's amounts, precision over those written."""
    rates = micro(scores, "normalised").select("system", F.col("cer").alias("normalised_cer"), F.col("wer").alias("normalised_wer")).join(micro(scores).select("system", F.col("cer").alias("strict_cer"), F.col("wer").alias("strict_wer")), "system")
    tables = table_sums(scores).select("system", F.try_divide("aligned", "n_truth_rows").alias("rows_aligned"), "fragments", "width_breaks", F.try_divide("recalled_cells", "truth_cells").alias("content_recall"))
    numbers = number_sums(scores).select("system", F.try_divide("amounts_correct", "truth_amounts").alias("digit_recall"), F.try_divide("amounts_correct", "prediction_amounts").alias("digit_precision"), "misread", "dropped", "invented", "documents_with_an_error")
    return rates.join(column_rates(column_sums(scores)), "system").join(tables, "system").join(numbers, "system").orderBy("system")


def divergence_groups(h: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Exact groups over all systems, with counts and who made them. Of hunks, or of word_spans: their kinds are then told once for each group."""
    told = [c for c in ("kind", "same") if c in h.columns]  # by both sides alone
    # counted for each system first, by hash: a set of systems for each span would make every span be sorted
    each = h.groupBy("truth", "prediction", *told, "system").agg(F.count("*").alias("count"))
    g = each.groupBy("truth", "prediction", *told).agg(F.sum("count").alias("count"), F.sort_array(F.collect_list("system")).alias("systems"))
    return (g if "kind" in h.columns else with_kind(g, policy)).select("kind", "truth", "prediction", "count", "systems")


def top_divergences(groups: DataFrame, n: int = 20, width: int = 60) -> DataFrame:
    """The n most frequent of each kind, spans cut for display."""
    order = W.partitionBy("kind").orderBy(F.desc("count"), "truth", "prediction")
    ranked = groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("kind", "rank", F.substring("truth", 1, width).alias("truth"), F.substring("prediction", 1, width).alias("prediction"), "count", "systems")
