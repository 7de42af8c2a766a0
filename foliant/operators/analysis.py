"""What is made of score reports: ladders, paired change, medians, de-duplication, rollups, skylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, DateType, IntegralType, NumericType, TimestampType

from foliant.errors import Refusal
from foliant.operators import order
from foliant.operators.order import null_safe_join

#: Severities in order; their alphabetical order is another.
SEVERITIES = ("clean", "light", "moderate", "heavy")
FAMILIES = ("photo", "scan")
#: Types of which an aggregate by hash can hold a value.
FIXED = (NumericType, BooleanType, DateType, TimestampType)


def severity_ord(severity: str = "severity") -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity)).cast("int") - 1


def doc_type(stem: str = "stem") -> Column:
    """After the first underscore; null without one."""
    return F.nullif(F.regexp_extract(stem, r"^[^_]*_(.+)$", 1), F.lit(""))


def case_id(stem: str = "stem") -> Column:
    return F.substring_index(stem, "_", 1)


def is_statement(stem: str = "stem") -> Column:
    return F.col(stem).endswith("_bank_statements")


# -- reports -----------------------------------------------------------------------------------------------------------


def keep_last(rows: DataFrame, order: str = "load_seq", names: tuple[str, ...] = ("family", "severity")) -> DataFrame:
    """Of each system and stem the row loaded last.

    Where all else is of fixed width, it is kept while rows are read, so that no rows are sorted and one of each is shuffled. names:
    columns of few texts, which go by their numbers meanwhile. Other rows are put in order."""
    names = tuple(c for c in names if c in rows.columns)
    rest = [c for c in rows.columns if c not in ("system", "stem", *names)]
    if not isinstance(rows.schema[order].dataType, IntegralType) or not all(isinstance(rows.schema[c].dataType, FIXED) for c in rest):
        return rows.withColumn("rn", F.row_number().over(W.partitionBy("system", "stem").orderBy(F.desc(order)))).where("rn = 1").drop("rn")
    code, at = "_code", F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))
    known = F.broadcast(rows.select(*names).distinct().withColumn(code, F.row_number().over(W.orderBy(*names)))) if names else None
    coded = rows if known is None else null_safe_join(rows, known, list(names)).drop(*names)
    kept = coded.groupBy("system", "stem").agg(*[F.max_by(c, at).alias(c) for c in (*rest, *([code] if names else []))])
    return (kept if known is None else kept.join(known, code)).select(*rows.columns)


def keep_first_report(rows: DataFrame, order: str = "report_seq") -> DataFrame:
    """Of each system all rows of the first report that has statements of it."""
    first = rows.where(is_statement()).groupBy("system").agg(F.min(order).alias("first_report"))
    return rows.where(is_statement()).join(F.broadcast(first), "system").where(F.col(order) == F.col("first_report")).drop("first_report")


def in_both_families(clean: DataFrame) -> DataFrame:
    """A clean row is the origin of every family's ladder."""
    return clean.withColumn("family", F.explode(F.array(*map(F.lit, FAMILIES))))


def statement_rollup(rows: DataFrame, by: list[str]) -> DataFrame:
    """Pages, amounts, usable (attributable over amounts), and the other measures of statements; width_ok: pages of the right width; median_ncer: the upper median."""
    s = rows.groupBy(*by).agg(
        F.count("*").alias("pages"), F.sum("amounts").alias("amounts"), F.sum("attributable").alias("attributable"), F.sum("misfiled").alias("misfiled"), F.sum("read").alias("read"),
        F.sum("amounts_correct").alias("amounts_correct"), F.sum("truth_amounts").alias("truth_amounts"), F.sum("aligned").alias("aligned"), F.sum("truth_rows").alias("truth_rows"), F.count_if("columns_match").alias("width_ok"),
    )
    s = s.join(order.upper_medians(rows, by, "normalised_cer", "median_ncer"), by, "left")
    return s.select(*by, "pages", "amounts", F.try_divide("attributable", "amounts").alias("usable_attributable"), "misfiled", F.try_divide("read", "amounts").alias("read_rate"), F.try_divide("amounts_correct", "truth_amounts").alias("digit_recall"), F.try_divide("aligned", "truth_rows").alias("rows_aligned"), "width_ok", "median_ncer")


def degraded_systems(rows: DataFrame) -> DataFrame:
    return rows.where("severity <> 'clean'").select("system").distinct()


def ladder(rows: DataFrame) -> DataFrame:
    """A row for each system, family and severity; systems with nothing but clean rows are left out."""
    s = rows.where(is_statement())
    both = in_both_families(s.where("severity = 'clean'")).unionByName(s.where("severity <> 'clean'"))
    both = both.join(F.broadcast(degraded_systems(s)), "system", "left_semi")
    return statement_rollup(both, ["system", "family", "severity"]).withColumn("severity_ord", severity_ord())


def clean_only_systems(rows: DataFrame) -> DataFrame:
    return rows.select("system").distinct().join(degraded_systems(rows), "system", "left_anti")


def ladder_change(steps: DataFrame, value: str = "usable_attributable") -> DataFrame:
    """Each rung's change against the one before, and against the clean origin."""
    w = W.partitionBy("system", "family").orderBy("severity_ord")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return steps.select("system", "family", "severity", "severity_ord", value, (F.col(value) - F.lag(value).over(w)).alias("step"), F.lag("severity").over(w).alias("before"), (F.col(value) - F.first(value).over(whole)).alias("from_clean"), (F.first("rows_aligned").over(whole) - F.last("rows_aligned").over(whole)).alias("rows_lost"))


def largest_drop(steps: DataFrame) -> DataFrame:
    """Of each system and family the rung with the largest fall, the first of equals."""
    c = ladder_change(steps).where("step is not null")
    order = W.partitionBy("system", "family").orderBy("step", "severity_ord")
    return c.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("system", "family", "before", "severity", "step", "rows_lost")


def ladder_pivot(steps: DataFrame, systems: list[str], value: str = "usable_attributable") -> DataFrame:
    return steps.groupBy("family", "severity").pivot("system", systems).agg(F.avg(value))


def paired_change(rows: DataFrame, value: str = "misfiled", aliases: DataFrame | None = None) -> DataFrame:
    """Of each degraded rung, pages that are worse, better or the same as the system's clean page, and the net change.

    A system without clean pages may go under another name (aliases: system, clean_system); without any it drops out."""
    s = rows.where(is_statement())
    clean = s.where("severity = 'clean'").select(F.col("system").alias("base"), "stem", F.col(value).alias("clean_value"))
    names = s.select("system").distinct()
    own = names.join(clean.select(F.col("base").alias("system")).distinct(), "system", "left_semi").withColumn("base", F.col("system"))
    if aliases is not None:
        other = names.join(own.select("system"), "system", "left_anti").join(aliases, "system").select("system", F.col("clean_system").alias("base"))
        own = own.unionByName(other)
    # names are few, so no system's pages are gathered for them; both sides then stand in as many partitions as are set, which are not merged
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = s.where("severity <> 'clean'").select("system", "family", "severity", "stem", value).join(F.broadcast(own), "system")
    d = d.repartition(parts, "base", "stem").join(clean.repartition(parts, "base", "stem"), ["base", "stem"])
    delta = F.col(value) - F.col("clean_value")
    return d.groupBy("system", "family", "severity").agg(F.count_if(delta > 0).alias("worse"), F.count_if(delta < 0).alias("better"), F.count_if(delta == 0).alias("same"), F.sum(delta).alias("net"))


def verdict(changes: DataFrame) -> DataFrame:
    """noise if the lesser count is at least half the larger, none at all included."""
    return changes.withColumn("verdict", F.when(F.least("worse", "better") >= F.greatest("worse", "better") / 2, "noise").otherwise("real"))


def prompt_mixes(runs: DataFrame) -> DataFrame:
    """Rungs measured under several prompts; an unknown prompt is one of its own."""
    return runs.groupBy("system", "family", "severity").agg(F.count_distinct(F.coalesce("prompt_sha256", F.lit("∅"))).alias("prompts")).where("prompts > 1")


def refuse_mixed_prompts(runs: DataFrame) -> None:
    bad = prompt_mixes(runs).limit(1).collect()
    if bad:
        raise Refusal(f"{bad[0]['prompts']} prompts on one rung", f"{bad[0]['system']} {bad[0]['family']} {bad[0]['severity']}", "one prompt for each rung", "score the runs apart")


def refuse_several_corpora(reports: DataFrame) -> None:
    n = reports.agg(F.count_distinct("corpus")).first()[0]
    if n > 1:
        raise Refusal(f"reports of {n} corpora", "reports", "one corpus", "load them apart")


# -- summaries ---------------------------------------------------------------------------------------------------------


def convention_gap(rows: DataFrame) -> DataFrame:
    """The median of pages' gaps, and the difference of medians: two operators, often confused."""
    s = order.medians(rows, ["system"], {"strict": F.col("strict_cer"), "normalised": F.col("normalised_cer"), "median_gap": F.col("strict_cer") - F.col("normalised_cer")})
    return s.select("system", "strict", "normalised", "median_gap", (F.col("strict") - F.col("normalised")).alias("gap_of_medians"))


def structure_tradeoff(rows: DataFrame) -> DataFrame:
    s = rows.groupBy("system").agg(F.sum("aligned").alias("recovered"), F.sum("truth_rows").alias("rows"), F.sum(F.col("fragments") + F.col("width_breaks")).alias("broken"))
    return s.withColumn("share", F.try_divide("recovered", "rows"))


def misfiled_by_doc_type(rows: DataFrame) -> DataFrame:
    s = rows.withColumn("doc_type", doc_type()).groupBy("doc_type", "system").agg(F.sum("misfiled").alias("misfiled"), F.sum("amounts").alias("amounts"))
    return s.withColumn("rate", F.try_divide("misfiled", "amounts"))


def weighted_rate(rows: DataFrame, part: str, whole: str, by: str = "system") -> DataFrame:
    return rows.groupBy(by).agg(F.sum(part).alias(part), F.sum(whole).alias(whole)).withColumn("rate", F.try_divide(part, whole))


def summary_table(rows: DataFrame) -> DataFrame:
    s = rows.groupBy("system").agg(
        F.count("*").alias("pages"), F.avg("normalised_cer").alias("mean_ncer"), F.count_if(F.col("normalised_cer") == 0).alias("exact_pages"),
        F.try_divide(F.sum("misfiled"), F.sum("amounts")).alias("misfiled_rate"), F.count_if(~F.col("columns_match")).alias("documents_mismatched"),
        F.try_divide(F.sum("aligned"), F.sum("truth_rows")).alias("rows_aligned"), F.sum("fragments").alias("fragments"),
    )
    middle = order.medians(rows, ["system"], {"median_ncer": F.col("normalised_cer"), "gap": F.col("strict_cer") - F.col("normalised_cer")})
    return s.join(middle, "system", "left").select("system", "pages", "median_ncer", "mean_ncer", "exact_pages", "gap", "misfiled_rate", "documents_mismatched", "rows_aligned", "fragments")


def statement_table(rows: DataFrame) -> DataFrame:
    """The cost of orphaned rows: what is placed but cannot be attributed, over all amounts."""
    s = rows.where(is_statement()).groupBy("system").agg(F.sum("placed").alias("placed"), F.sum("attributable").alias("attributable"), F.sum("amounts").alias("amounts"), F.sum("fragments").alias("fragments"))
    return s.select("system", F.try_divide("placed", "amounts").alias("usable_placed"), F.try_divide("attributable", "amounts").alias("usable_attributable"), F.try_divide(F.col("placed") - F.col("attributable"), F.col("amounts")).alias("cost"), "fragments")


def pareto(points: DataFrame, x: str, y: str, key: str = "system") -> DataFrame:
    """Points that no other equals or beats on both and beats on one; points with a null on either side stand apart, and stay.

    A point is beaten by the best y of a larger x, or by a better y of the same x: a running maximum over x, falling."""
    whole = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    best = order.accumulated(whole.groupBy(x).agg(F.max(y).alias("_best")), [], [F.desc(x)], "_best", "max", "_larger")
    beaten = F.coalesce(F.col("_larger") >= F.col(y), F.lit(False)) | F.coalesce(F.col("_best") > F.col(y), F.lit(False))
    return points.join(best, x, "left").where(~beaten).select(*points.columns)


def spearman(rows: DataFrame, x: str, y: str, by: str = "system") -> DataFrame:
    """Rank correlation with average ranks of equals; null where one side is constant."""
    return order.rank_correlation(rows, [by], x, y)


def short_names(rows: DataFrame, names: DataFrame, col: str = "system") -> DataFrame:
    """names: system, short. Several systems may share a short name."""
    return rows.join(names.select(F.col("system").alias(col), "short"), col, "left").withColumn("short", F.coalesce("short", col))


def condition(name: str, tiers: list[str]) -> Column:
    """The first tier that the name ends with, else clean."""
    c = F.lit("clean")
    for t in reversed(tiers):
        c = F.when(F.col(name).endswith(t), t).otherwise(c)
    return c
