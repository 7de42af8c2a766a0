"""Analyses as lines of text, and tables in the order in which they are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.display import fixed, left, right, signed
from foliant.operators.analysis import is_statement, short_names

TITLE = "Usable bank-statement amounts by image quality"


def ladder_lines(steps: DataFrame) -> DataFrame:
    """system, family, rank, line: a heading for each system and family (rank -1), a line for each rung, and a blank one after.

    steps: a ladder. A rung's drop is told against the clean one, where there is one; title and order are the reader's
    (TITLE, then orderBy system, family, rank)."""
    origin = steps.where("severity = 'clean'").groupBy("system", "family").agg(F.min("usable_attributable").alias("origin"))
    s = steps.join(origin, ["system", "family"], "left")
    drop = F.when(F.col("origin").isNull(), "").otherwise(F.concat(F.lit("  ("), signed((F.col("usable_attributable") - F.col("origin")) * 100, 1), F.lit(" pts)")))
    shown = lambda c, digits: F.coalesce(fixed(F.col(c), digits), F.lit("-"))
    line = F.concat(
        F.lit("    "), left(F.col("severity"), 9), F.lit(" usable "), shown("usable_attributable", 4), F.coalesce(drop, F.lit("")), F.lit("   misfiled "), right(F.col("misfiled").cast("string"), 4),
        F.lit("   rows "), shown("rows_aligned", 3), F.lit("   digits "), shown("digit_recall", 4), F.lit("   nCER "), shown("median_ncer", 4),
    )
    rungs = s.select("system", "family", F.col("severity_ord").alias("rank"), line.alias("line"))
    groups = steps.select("system", "family").distinct()
    heads = groups.select("system", "family", F.lit(-1).alias("rank"), F.concat(F.lit("  "), "system", F.lit("  |  "), "family").alias("line"))
    return heads.unionByName(rungs).unionByName(groups.select("system", "family", F.lit(99).alias("rank"), F.lit("").alias("line")))


def published_ladder(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """place, line: attributable amounts of statements for each run, clean ones first, then by family and severity by name.

    runs: run, family, severity, images_per_minute; documents: run, stem, amounts, attributable. Ladders elsewhere go by severity;
    this one goes by its name. A run without amounts shows a dash."""
    sums = documents.where(is_statement()).groupBy("run").agg(F.sum("amounts").alias("a"), F.sum("attributable").alias("t"))
    j = runs.join(sums, "run", "left").fillna(0, ["a", "t"])
    line = F.concat(
        F.lit("  "), left(F.col("family"), 6), F.lit(" "), left(F.col("severity"), 9), F.lit(" "), right(F.coalesce(fixed(F.col("images_per_minute"), 2), F.lit("-")), 6), F.lit(" img/min   attributable "),
        right(F.col("t").cast("string"), 4), F.lit("/"), right(F.col("a").cast("string"), 4), F.lit(" = "), F.coalesce(fixed(F.try_divide("t", "a"), 4), F.lit("-")),
    )
    return j.select((F.col("family") != "clean").alias("degraded"), "family", "severity", "run", line.alias("line"))


def in_published_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy("degraded", "family", "severity", "run")


def deployment_comparison(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """deployment, placed, attributable, misfiled, rows_aligned of statements: the same system's runs under several deployments.

    labels: report, system, deployment; a run that nobody labelled drops out, a label without a run has no row."""
    sums = lambda df, *by: df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("placed", "attributable", "misfiled", "amounts", "aligned", "truth_rows")])
    # runs are summed up before labels join them: all pages of a run would meet in one task
    s = sums(sums(documents.where(is_statement()), "report", "system").join(F.broadcast(labels), ["report", "system"]), "deployment")
    return s.select("deployment", F.try_divide("placed", "amounts").alias("placed"), F.try_divide("attributable", "amounts").alias("attributable"), "misfiled", F.try_divide("aligned", "truth_rows").alias("rows_aligned"))


def leaderboard(rows: DataFrame, *measures: str, key: str = "system") -> DataFrame:
    """Best first, ties by name; nulls last."""
    return rows.orderBy(*[F.desc_nulls_last(m) for m in measures], key)


def without_systems(rows: DataFrame, names: DataFrame, excluded: list[str]) -> DataFrame:
    """Rows of systems whose short name is not excluded."""
    return short_names(rows, names).where(~F.col("short").isin(excluded))


def deployable(system: str = "system") -> Column:
    """Systems that do not run in half precision, which no card of the deployment holds."""
    return ~F.col(system).contains("BF16")


def digit_precision(rows: DataFrame, by: str = "system") -> DataFrame:
    """Amounts read right over all amounts written."""
    return rows.groupBy(by).agg(F.try_divide(F.sum("amounts_correct"), F.sum("prediction_amounts")).alias("digit_precision"))
