"""Numbering, running sums and order statistics without a group, or the whole, in one task.

Rows are put in order by ranges, and the ranges are written down once, since a plan that works them out twice may sample
other bounds. What stands before a row is then what stands before its range, a table of one row for each range and
group, and what stands before it within the range. Order statistics go by distinct values with their counts, summed on
the map side, so that a value that a third of all rows share is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.materialise import materialised

#: Places of the row within its partition in what monotonically_increasing_id gives.
_ROW_BITS = 33


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in names])


def null_safe_join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on names in which nulls are equal; the right side's other columns are added."""
    if not names:
        return left.crossJoin(right)
    return left.join(right, _same(left, right, names), how).drop(*[right[c] for c in names])


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, name: str = "idx") -> DataFrame:
    """Adds the row's place in the order, from 0, within its group; rows that are equal in the order stand in any.

    Equal rows, however many, are dealt over ranges by an id of their own."""
    by = by or []
    tie, at, part = "_tie", "_at", "_part"
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by, *order, tie).sortWithinPartitions(*by, *order, tie)
    placed = materialised(ranged.withColumn(at, F.monotonically_increasing_id()).drop(tie))
    placed = placed.withColumns({part: F.shiftright(F.col(at), _ROW_BITS), at: F.col(at).bitwiseAND((1 << _ROW_BITS) - 1)})
    counts = placed.groupBy(part, *by).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(part, *by, (ahead - F.col("_first")).alias("_shift"))
    return null_safe_join(placed, offsets, [part, *by]).withColumn(name, F.col(at) + F.col("_shift")).drop(part, at, "_shift")


def accumulated(rows: DataFrame, by: list[str], order: list[Column], value: str, combine: str = "sum", name: str = "before") -> DataFrame:
    """Adds the sum, max or min of value over the rows that stand before within the group, null of none. No two rows of a group are equal in the order."""
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[combine]
    merge = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}[combine]  # the last two skip nulls
    part, own, ahead, within = "_part", "_own", "_ahead", "_within"
    placed = materialised(rows.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy(part, *by).agg(fold(value).alias(own)).withColumn(ahead, fold(own).over(earlier(W.partitionBy(*by).orderBy(part)))).drop(own)
    placed = placed.withColumn(within, fold(value).over(earlier(W.partitionBy(part, *by).orderBy(*order))))
    return null_safe_join(placed, offsets, [part, *by]).withColumn(name, merge(F.col(ahead), F.col(within))).drop(part, ahead, within)


def value_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, before, total: each distinct value that is not null, with its rows, the rows of lesser values, and all rows of the group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    counts = accumulated(counts, by, [F.col(value)], "n").withColumn("before", F.coalesce("before", F.lit(0)))
    return null_safe_join(counts, counts.groupBy(*by).agg(F.sum("n").alias("total")), by)


def at_place(place: Column, value: str) -> Column:
    """Aggregate over value_counts: the value of the row at the place, from 0."""
    return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))


def upper_medians(rows: DataFrame, by: list[str], value: str, name: str | None = None) -> DataFrame:
    """by, name: the middle value, the upper one of two; groups without a value have no row."""
    counts = value_counts(rows, by, value)
    return counts.groupBy(*by).agg(at_place(F.floor(F.col("total") / 2), value).alias(name or value))


def medians(rows: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """by, and the median of each measure, between the two middle values where they are two; all measures in one pass."""
    each = F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in measures.items()])
    long = rows.select(*by, F.explode(each).alias("m")).select(*by, "m.measure", "m.value")
    counts = value_counts(long, [*by, "measure"], "value")
    low, high = at_place(F.floor((F.col("total") - 1) / 2), "value"), at_place(F.floor(F.col("total") / 2), "value")
    middle = counts.groupBy(*by, "measure").agg(low.alias("low"), high.alias("high")).withColumn("median", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * 0.5))
    return middle.groupBy(*by).agg(*[F.max(F.when(F.col("measure") == k, F.col("median"))).alias(k) for k in measures])


def rank_correlation(rows: DataFrame, by: list[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """by, rho: the correlation of average ranks, over pairs of values with their counts; null where a side is constant."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    joint = pairs.groupBy(*by, x, y).agg(F.count("*").alias("_m"))
    rank = F.col("before") + (F.col("n") - F.col("total")) / 2.0  # less its mean
    for c, r in ((x, "_rx"), (y, "_ry")):
        joint = null_safe_join(joint, value_counts(pairs, by, c).select(*by, c, rank.alias(r)), [*by, c])
    sums = joint.groupBy(*by).agg(*[F.sum(F.col("_m") * F.col(a) * F.col(b)).alias(k) for k, a, b in (("_xy", "_rx", "_ry"), ("_xx", "_rx", "_rx"), ("_yy", "_ry", "_ry"))])
    return sums.select(*by, F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy")).alias(name))
