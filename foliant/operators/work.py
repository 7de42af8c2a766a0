"""The relational half of resumable, sharded runs, and the audit of their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.errors import Refusal, some
from foliant.operators import order


def pending(stems: DataFrame, outputs: DataFrame) -> DataFrame:
    """Stems without an output, or with an empty one (outputs: stem, size)."""
    return stems.join(outputs.where("size > 0").select("stem"), "stem", "left_anti")


def refuse_pending(stems: DataFrame, outputs: DataFrame) -> None:
    left = pending(stems, outputs)
    first = [r["stem"] for r in left.orderBy("stem").limit(5).collect()]
    if first:
        raise Refusal(f"pages are pending: {some(first, left.count())}", "outputs", "a non-empty output for each stem", "run again, or declare them unproduced")


def numbered(stems: DataFrame, by: str | None = None) -> DataFrame:
    """idx: place in stem order, from 0, within each `by` group, or in the whole list; neither is gathered (see order.numbered)."""
    return order.numbered(stems, ["stem"], [by] if by else None)


def shard(stems: DataFrame, index: int, of: int) -> DataFrame:
    if of < 1 or not 0 <= index < of:
        raise Refusal(f"shard {index} of {of}", "sharding", "0 <= index < shards", "choose an index in range")
    return numbered(stems).where(F.col("idx") % of == index)


def chunks(stems: DataFrame, size: int) -> DataFrame:
    return numbered(stems).withColumn("chunk", F.floor(F.col("idx") / max(1, size)))


def shard_rollup(timing: DataFrame) -> DataFrame:
    """Shards run side by side: images and cards add up, seconds are the slowest shard's."""
    t = timing.groupBy("system").agg(
        F.sum("images").alias("images"), F.max("inference_seconds").alias("seconds"), F.sum("cards").alias("cards"), F.coalesce(F.bool_or("includes_model_load"), F.lit(False)).alias("includes_model_load"),
        F.count("*").alias("parts"), F.min_by(F.struct("shards", "cards"), "shard").alias("first"),
    )
    rate = F.try_divide(60 * F.col("images"), F.col("seconds"))
    tensor = (F.col("first.shards") == 1) & (F.col("first.cards") > 1)
    return t.select("system", "images", "seconds", "cards", "includes_model_load", rate.alias("images_per_minute"), (rate / F.col("cards")).alias("per_card"), F.when(tensor, F.concat(F.lit("tp="), F.col("first.cards"))).otherwise(F.concat(F.lit("dp="), F.col("parts"))).alias("deployment"))


def accuracy_and_throughput(accuracy: DataFrame, throughput: DataFrame) -> DataFrame:
    """Systems are few: what stands beside them, be it pages, is not gathered by their names."""
    return accuracy.join(F.broadcast(throughput), "system")


def refuse_untimed(reports: DataFrame, timing: DataFrame) -> None:
    lost = [r["system"] for r in reports.select("system").distinct().join(timing, "system", "left_anti").limit(6).collect()]
    if lost:
        raise Refusal(f"no timing of {some(lost, len(lost))}", "timing", "a timing file for each system", "run with timing on")


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """stem, status of run a's pages in run b: identical, differing or missing; an empty page is missing."""
    j = a.select("stem", F.col("text").alias("a")).join(b.where("text <> ''").select("stem", F.col("text").alias("b")), "stem", "left")
    return j.select("stem", F.when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "identical").otherwise("differing").alias("status"))


def prompt_audit(runs: DataFrame, known: DataFrame) -> DataFrame:
    """runs: run, prompt_sha256; known: prompt_sha256, prompt. LEGACY without a stamp, UNKNOWN with one nobody knows."""
    j = runs.join(known, "prompt_sha256", "left")
    return j.select("run", F.when(F.col("prompt_sha256").isNull(), "LEGACY").when(F.col("prompt").isNull(), "UNKNOWN").otherwise("OK").alias("status"))


def transfer_audit(images: DataFrame, transcripts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Of each tier the three counts, and whether they agree."""
    n = lambda df, c: df.groupBy("tier").agg(F.count("*").alias(c))
    j = n(images, "images").join(n(transcripts, "transcripts"), "tier", "full").join(n(manifest, "rows"), "tier", "full").fillna(0)
    return j.withColumn("complete", (F.col("images") == F.col("transcripts")) & (F.col("images") == F.col("rows")))


def orphans_and_spares(images: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Of each tier the images, transcripts, orphans (transcripts without an image) and spares; usable: transcripts, and no orphan."""
    sides = images.select("tier", "stem", F.lit(1).alias("i"), F.lit(0).alias("t")).unionByName(transcripts.select("tier", "stem", F.lit(0).alias("i"), F.lit(1).alias("t")))
    stems = sides.groupBy("tier", "stem").agg(F.max("i").alias("i"), F.max("t").alias("t"))
    counts = stems.groupBy("tier").agg(F.sum("i").alias("images"), F.sum("t").alias("transcripts"), F.count_if(F.expr("t > i")).alias("orphans"), F.count_if(F.expr("i > t")).alias("spares"))
    return counts.withColumn("usable", (F.col("transcripts") > 0) & (F.col("orphans") == 0))


def carved(stems: DataFrame, whole_types: list[str], named: list[str]) -> DataFrame:
    """A subset for an experiment: all pages of some types, and pages that are named; a name that is not there is refused."""
    kept = stems.where(F.regexp_extract("stem", "^[^_]*_(.+)$", 1).isin(whole_types) | F.col("stem").isin(named))
    there = {r["stem"] for r in kept.where(F.col("stem").isin(named)).select("stem").distinct().collect()}  # as many as were named
    lost = sorted(set(named) - there)
    if lost:
        raise Refusal(f"no such pages: {some(lost, len(lost))}", "subset", "pages of the corpus", "name pages that are there")
    return kept


def redo(previous: DataFrame, stems: DataFrame) -> DataFrame:
    """The previous run's pages less those to be done again."""
    return previous.join(stems.select("stem"), "stem", "left_anti")
