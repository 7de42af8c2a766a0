"""Numbering and order statistics against plain versions."""

from __future__ import annotations

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.operators import analysis, order, work

R = random.Random(9)


@pytest.fixture(params=["true", "false"])
def adaptive(request, spark):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.enabled", was)


def test_a_million_rows_with_payload_are_numbered_without_a_gap(spark, adaptive):
    n = 1_000_000
    stems = spark.range(0, n, 1, 16).select(F.format_string("%08x", F.pmod(F.col("id") * 7919, F.lit(n))).alias("stem"), F.col("id").alias("payload"), F.repeat(F.lit("x"), F.pmod("id", F.lit(5)).cast("int")).alias("more")).repartition(13)
    got = work.numbered(stems)
    row = got.agg(F.count("*"), F.count_distinct("idx"), F.min("idx"), F.max("idx"), F.sum((F.conv("stem", 16, 10).cast("long") == F.col("idx")).cast("long"))).first()
    assert tuple(row) == (n, n, 0, n - 1, n)
    parts = [work.shard(stems, k, 3) for k in range(3)]
    sizes = [p.agg(F.count("*"), F.count_distinct("stem")).first() for p in parts]
    assert [tuple(s) for s in sizes] == [(333334, 333334), (333333, 333333), (333333, 333333)]
    chunks = work.chunks(stems, 4096).groupBy("chunk").count().collect()
    assert len(chunks) == 245 and {r["count"] for r in chunks} == {4096, n % 4096}


def test_repeated_stems_and_groups_are_numbered_apart(spark):
    rows = [(R.choice(["a", "b", None]), "hot" if k % 3 else f"s{k}", k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, stem string, k int").repartition(7)
    got = [tuple(r) for r in work.numbered(df, by="g").select("g", "stem", "k", "idx").collect()]
    for g in ("a", "b", None):
        own = sorted((i, s) for x, s, _, i in got if x == g)
        assert [i for i, _ in own] == list(range(len(own)))
        assert [s for _, s in own] == sorted(s for x, s, _ in rows if x == g)
    assert Counter(r[:3] for r in got) == Counter(rows)
    assert work.numbered(df.limit(0)).collect() == []


def values(spark):
    rows = [(R.choice(["s", "t"]), R.choice([0.0, 0.0, 0.25, R.random()]), R.randrange(4)) for _ in range(701)] + [("one", 0.5, 1), ("two", 0.5, 1), ("two", 1.0, 2), ("none", None, 1)]
    return rows, spark.createDataFrame(rows, "system string, v double, w long").repartition(6)


def of(rows, system, k=1):
    return sorted(r[k] for r in rows if r[0] == system and r[1] is not None)


def test_medians(spark, adaptive):
    rows, df = values(spark)
    upper = {r["system"]: r["m"] for r in order.upper_medians(df, ["system"], "v", "m").collect()}
    assert upper == {s: of(rows, s)[len(of(rows, s)) // 2] for s in ("s", "t", "one", "two")}
    both = {r["system"]: (r["a"], r["b"]) for r in order.medians(df, ["system"], {"a": F.col("v"), "b": F.col("w")}).collect()}
    assert both["none"] == (None, 1.0)
    for s in ("s", "t", "one", "two"):
        assert both[s] == pytest.approx((statistics.median(of(rows, s)), statistics.median(of(rows, s, 2))), abs=1e-12)


def average_ranks(xs):
    at = sorted(xs)
    return [at.index(x) + (at.count(x) + 1) / 2 for x in xs]


def test_rank_correlation(spark):
    rows, df = values(spark)
    got = {r["system"]: r["rho"] for r in order.rank_correlation(df, ["system"], "v", "w").collect()}
    for s in ("s", "t"):
        pairs = [r[1:] for r in rows if r[0] == s]
        x, y = (average_ranks([p[k] for p in pairs]) for k in (0, 1))
        assert got[s] == pytest.approx(statistics.correlation(x, y), abs=1e-9)
    assert got["one"] is None and got["two"] == pytest.approx(1.0) and "none" not in got


def test_pareto_is_the_skyline(spark):
    points = [(f"p{k}", float(R.randrange(12)), float(R.randrange(12))) for k in range(120)] + [("n", None, 11.0), ("same1", 11.0, 11.0), ("same2", 11.0, 11.0)]
    for some in (points, points[:7], points[:120]):
        df = spark.createDataFrame(some, "system string, x double, y double").repartition(5)
        beaten = {p for p, x, y in some for q, u, v in some if None not in (x, y, u, v) and q != p and u >= x and v >= y and (u > x or v > y)}
        assert {r["system"] for r in analysis.pareto(df, "x", "y").collect()} == {p for p, *_ in some} - beaten
