"""Connected components of a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint

MOST_ROUNDS = 100
#: Links up to which nodes' least neighbours are broadcast (32 bytes each); beyond, a shuffled join does the same.
BROADCAST_ROWS = 200_000
#: Links in each part of a round's table.
PART_ROWS = 100_000


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b), root being the component's least node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each is a group-by on one end, the number of
    rounds is logarithmic, and links never outnumber those given. Neighbours are joined to their least node, not listed,
    so no group is held in memory; few links make few tasks. Empty links give no rows; links of a node to itself are left out.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = checkpoint(edges), None
    n = edges.count()

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n <= BROADCAST_ROWS else df

    for _ in range(MOST_ROUNDS):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours are linked to the least of all
        large = both.where("b > a").join(near(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near(low), "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = checkpoint(small.where("a <> b").distinct().coalesce(1 + n // PART_ROWS))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
