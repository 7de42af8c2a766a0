"""Ground truth to extraction records, and grouped statements to full rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.errors import Refusal

ABSENT = "NOT_FOUND"
#: The types' names in the singular; a type that is not here keeps its name.
SINGULAR = {"bank_statements": "bank_statement", "invoices": "invoice", "receipts": "receipt"}


def tier_of(folder: Column) -> Column:
    """What stands after a corpus folder's last underscore: scan-light."""
    return F.element_at(F.split(folder, "_"), -1)


def case_records(images: DataFrame, cases: DataFrame, doc_type: str) -> DataFrame:
    """Images of the type (case_id, doc_type, suffix, folder: null for the clean corpus) with their case's fields; others drop out.

    One case has many tiers. Records are named by case, singular type and tier without its hyphen."""
    name = F.concat("case_id", F.lit("_" + SINGULAR.get(doc_type, doc_type)), F.coalesce(F.concat(F.lit("_"), F.replace(tier_of(F.col("folder")), F.lit("-"))), F.lit("")), "suffix")
    return images.where(F.col("doc_type") == doc_type).join(cases, "case_id").withColumn("filename", name).drop("doc_type", "suffix", "folder")


def parts(value: Column) -> Column:
    """A pipe-joined list, each part trimmed."""
    return F.transform(F.split(value, r"\|"), lambda x: F.trim(x))


def money(value: Column) -> Column:
    return F.when((value == ABSENT) | value.startswith("$"), value).otherwise(F.concat(F.lit("$"), value))


def uneven_statements(cases: DataFrame, dates: str, descriptions: str, paid: str) -> DataFrame:
    """Cases whose three lists differ in length."""
    n = [F.size(parts(F.col(c))) for c in (dates, descriptions, paid)]
    return cases.where((n[0] != n[1]) | (n[1] != n[2]))


def statements(cases: DataFrame, dates: str = "dates", descriptions: str = "descriptions", paid: str = "paid", check: bool = True) -> DataFrame:
    """case_id and the three lists less the rows without a paid amount, joined again; amounts get a dollar sign."""
    if check and (bad := uneven_statements(cases, dates, descriptions, paid).limit(1).collect()):
        raise Refusal("lists of different lengths", str(bad[0]["case_id"]), "one date, description and amount for each line", "mend the ground truth")
    lines = F.arrays_zip(parts(F.col(dates)).alias("date"), parts(F.col(descriptions)).alias("description"), parts(F.col(paid)).alias("paid"))
    spent = F.filter(lines, lambda x: x["paid"] != ABSENT)
    join = lambda f: F.array_join(F.transform("spent", f), " | ")
    return cases.withColumn("spent", spent).select("case_id", join(lambda x: x["description"]).alias("line_item_descriptions"), join(lambda x: x["date"]).alias("transaction_dates"), join(lambda x: money(x["paid"])).alias("transaction_amounts_paid"))


def carry_down(rows: DataFrame, by: str, order: list[str], key: str) -> DataFrame:
    """A group's key, given on its first row only, filled down."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(key, F.last(F.nullif(F.col(key), F.lit("")), ignorenulls=True).over(w))
