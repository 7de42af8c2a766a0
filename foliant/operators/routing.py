"""Where a system's pages go: written, set aside as cut short, declared as not produced, or still pending.

Every page of the corpus takes exactly one route for each system. Declaring is deliberate, so nothing is declared by a
failure: what is neither written nor declared is pending, and a run is refused as long as it has any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.errors import Refusal, some

WRITTEN, TRUNCATED, DECLARED, PENDING = "written", "truncated", "declared", "pending"
ROUTES = (WRITTEN, TRUNCATED, DECLARED, PENDING)
#: Why a generation stopped at the token cap.
CUT = "length"


def routed(corpus: DataFrame, generated: DataFrame, declared: DataFrame) -> DataFrame:
    """system, stem, route, text, reason, attempts, conflict: one row for every system and stem of the corpus.

    corpus: stem. generated: system, stem, text, finish_reason, any number of attempts. declared: system, stem, reason.
    A whole, non-empty attempt is written (the least text of several); else a cut one is set aside, else a declared page is
    declared, else it is pending: so a later attempt rescues a cut page. conflict: written and declared at once, or not in the corpus.
    All three tables meet in one group-by; a page's attempts come to one row on the map side."""
    systems = generated.select("system").unionByName(declared.select("system")).distinct()
    blank = lambda df, **given: df.select("system", "stem", *[given.get(k, F.lit(None).cast(t)).alias(k) for k, t in (("whole", "string"), ("cut", "string"), ("reason", "string"), ("tried", "int"), ("asked", "int"))])
    usable = F.col("text") != ""
    stopped = F.col("finish_reason").eqNullSafe(CUT)
    every = (
        blank(corpus.select("stem").distinct().crossJoin(F.broadcast(systems)), asked=F.lit(1))  # systems are few
        .unionByName(blank(generated, whole=F.when(usable & ~stopped, F.col("text")), cut=F.when(stopped, F.coalesce("text", F.lit(""))), tried=F.lit(1)))
        .unionByName(blank(declared, reason=F.coalesce("reason", F.lit(""))))
    )
    one = every.groupBy("system", "stem").agg(F.min("whole").alias("whole"), F.min("cut").alias("cut"), F.min("reason").alias("reason"), F.coalesce(F.sum("tried"), F.lit(0)).alias("attempts"), F.max("asked").alias("asked"))
    route = F.when(F.col("whole").isNotNull(), WRITTEN).when(F.col("cut").isNotNull() & F.col("reason").isNull(), TRUNCATED).when(F.col("reason").isNotNull(), DECLARED).otherwise(PENDING)
    conflict = F.when(F.col("asked").isNull(), "not in the corpus").when(F.col("whole").isNotNull() & F.col("reason").isNotNull(), "declared, but there")
    return one.select("system", "stem", route.alias("route"), F.coalesce("whole", "cut").alias("text"), "reason", "attempts", conflict.alias("conflict"))


def totals(routes: DataFrame) -> DataFrame:
    """system, a count of each route, pages: the routes of a system add up to the pages of the corpus."""
    return routes.groupBy("system").agg(*[F.count_if(F.col("route") == r).alias(r) for r in ROUTES], F.count("*").alias("pages"))


def refuse_incomplete(routes: DataFrame) -> None:
    """Conflicts first, then pages that are neither written nor declared; cut ones are named apart."""
    wrong = routes.where("conflict is not null")
    if first := wrong.limit(6).collect():
        raise Refusal(f"pages in conflict: {some([f'{r["system"]}/{r["stem"]} ({r["conflict"]})' for r in first], wrong.count())}", "routing", "pages of the corpus, declared or there", "take back the declaration, or remove the page")
    left = routes.where(F.col("route").isin(PENDING, TRUNCATED))
    if first := left.orderBy("system", "stem").limit(6).collect():
        raise Refusal(f"pages are not whole: {some([f'{r["system"]}/{r["stem"]} ({r["route"]})' for r in first], left.count())}", "routing", "each page written or declared", "run them again with a higher cap, or declare them unproduced")


def predictions(routes: DataFrame) -> DataFrame:
    """What scoring sees: system, stem, prediction of written pages alone."""
    return routes.where(F.col("route") == WRITTEN).select("system", "stem", F.col("text").alias("prediction"))


def unproduced(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("route") == DECLARED).select("system", "stem", "reason")


def write_routes(routes: DataFrame, path: str) -> None:
    """Written pages under path/predictions, cut ones, verbatim, under path/_truncated, which Spark's readers pass over, declared ones under path/_unproduced."""
    for route, name in ((WRITTEN, "predictions"), (TRUNCATED, "_truncated"), (DECLARED, "_unproduced")):
        routes.where(F.col("route") == route).select("system", "stem", "text", "reason").write.mode("overwrite").partitionBy("system").parquet(f"{path}/{name}")
