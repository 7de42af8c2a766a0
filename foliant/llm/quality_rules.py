"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text. The cross-document rule hashes normalised lines, counts the documents of a host that hold
each line, takes away the lines above a limit, and rejects documents that are depleted by it. Each document contributes
one count to a line however often it repeats it, so a plain count with map-side sums is the number of documents, and no
line's rows meet in one task. Rows are documents: repeated rows count each. Null and empty texts have no words and fail
the base rules; a null host is a host of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import SPACE, checkpoint, split_words

#: A line in more documents of a host than this is boilerplate.
MAX_DOCS = 50
#: A document is depleted if less than this share of its words, or fewer than MIN_WORDS, stay.
KEEP_SHARE, MIN_WORDS = 0.5, 20
#: Frequent lines up to which they are broadcast (16 bytes and a host each). Of more, the most frequent are broadcast, as
#: many as can stand in at least that part of all their documents, and a shuffled join that has no hot key does the rest.
BROADCAST_ROWS = 200_000
WINDOW, REPEAT_PERCENT = 8, 30


def window_hashes(hashes: str, n: str, size: int = WINDOW) -> Column:
    """64-bit hashes of all windows of word hashes; none if there are fewer words."""
    own = ", ".join(f"{hashes}[i + {k}]" for k in range(size))
    return F.expr(f"if({n} < {size}, array(), transform(sequence(0, {n} - {size}), i -> xxhash64({own})))")


def metrics(docs: DataFrame) -> DataFrame:
    """From columns text, host, doc_id: the base measures, and lines as an array of (hash, words) for lines with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "host", text.alias("text"), split_words(text, SPACE).alias("words"))
    d = d.select("doc_id", "host", "text", "words", F.size("words").cast("long").alias("n_words"), F.expr("transform(words, w -> xxhash64(w))").alias("hashes"))
    d = d.select(
        "doc_id", "host", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        window_hashes("hashes", "int(n_words)").alias("windows"),
    )
    # positions of windows whose hash occurs again, found next to each other after a sort, only in texts that have any
    d = d.withColumn("pairs", F.expr("if(size(array_distinct(windows)) < size(windows), array_sort(transform(windows, (h, i) -> struct(h, i))), array())"))
    d = d.withColumn("again", F.expr("array_sort(transform(filter(pairs, (p, k) -> (k > 0 and pairs[k - 1].h = p.h) or (k + 1 < size(pairs) and pairs[k + 1].h = p.h)), p -> p.i))"))
    d = d.withColumn("n_repeat_words", F.expr(f"aggregate(again, struct(0L as n, -{WINDOW} as last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) as n, p as last), a -> a.n)"))
    return d.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.transform("lines", lambda x: F.struct(line_hash(x).alias("line"), F.size(split_words(x, SPACE)).alias("words"))).alias("lines"),
    )


def line_hash(line: Column) -> Column:
    """Case, digits and white space do not tell lines apart."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\s+", " "), "[0-9]+", "0"))


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, line, n: hashes of the normalised lines that more than max_docs documents of the host hold, n of them."""
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = docs.select("host", F.explode(F.array_distinct(F.transform(lines, line_hash))).alias("line"))
    return own.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)


def marked(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """lines with hit: whether frequent (host, line, n) has the row's host and line."""
    frequent = frequent.select(F.col("host").alias("own_host"), F.col("line").alias("own_line"), "n", F.lit(True).alias("hit"))
    known = frequent.agg(F.count("*").alias("lines"), F.sum("n").alias("held")).first()
    on = (F.col("host") == F.col("own_host")) & (F.col("line") == F.col("own_line"))
    if known["lines"] <= BROADCAST_ROWS:
        return lines.join(F.broadcast(frequent), on, "left").drop("own_host", "own_line", "n")
    # no more than BROADCAST_ROWS lines can each have that part of what all have; rows of any other are few
    hot = F.col("n") * BROADCAST_ROWS >= known["held"]
    first = lines.join(F.broadcast(frequent.where(hot)), on, "left").drop("own_host", "own_line", "n")
    # a row with its answer goes anywhere: its key is its own, and what it meets there changes nothing
    first = first.withColumn("key", F.when(F.col("hit"), F.xxhash64("row", "line")).otherwise(F.col("line"))).withColumnRenamed("hit", "hit_hot")
    rest = first.join(frequent.where(~hot).drop("n"), (F.col("host") == F.col("own_host")) & (F.col("key") == F.col("own_line")), "left")
    return rest.withColumn("hit", F.coalesce("hit_hot", "hit")).drop("own_host", "own_line", "hit_hot", "key")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, keep_share: float = KEEP_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and n_kept_words: words outside frequent lines."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"))
    frequent = checkpoint(frequent_lines(own, max_docs))
    measured = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    lines = metrics(own).withColumn("row", F.monotonically_increasing_id()).select("row", "host", *measured, F.explode_outer("lines").alias("l"))
    lines = lines.select("row", "host", *measured, F.col("l.line").alias("line"), F.coalesce("l.words", F.lit(0)).alias("words"))
    joined = marked(lines, frequent)
    totals = joined.groupBy("row").agg(*[F.first(c).alias(c) for c in measured], F.sum(F.when(F.col("hit"), 0).otherwise(F.col("words"))).alias("n_kept_words"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("n_kept_words") < keep_share * F.col("n_words")) | (F.col("n_kept_words") < min_words)
    return totals.select(*measured, base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"), "n_kept_words")
