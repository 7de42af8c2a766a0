"""Benchmark decontamination: a prefix-filtered set join over item-sized windows, in DataFrame functions only.

A benchmark item's windows of `size` words are sets to be wholly contained in a document. For full containment the
necessary prefix of a set is its one rarest member, so each window is joined by its rarest word: rarity is counted over
all documents. Where a document has that word, the window can only start `offset` words before it; the bounds on
position and length are checked, then the words themselves are compared, so hits are exact.

Documents are never shuffled: the places of prefix words are found inside each row, and only those places, with the
words around them, are exploded and joined. Prefix words are dealt out in blocks of at most BLOCK words, so no set held
in a task outgrows its bound; each block is one more pass over the documents.
Null texts and items have no words; items with a null id are left out, repeated items count once; repeated document
rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, lower_ascii, split_words

SIZE = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Prefix words that one pass looks for; bytes of vocabulary words, of windows with their items, or of keys of texts, that may be broadcast.
BLOCK, BROADCAST_BYTES = 20_000, 32 << 20


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """window (array of words), items (ids): each distinct window once. An item of fewer words, but not none, is one window."""
    w = items.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("words"))
    w = w.select("item_id", F.explode(F.expr(f"case when size(words) = 0 then array() when size(words) < {size} then array(words) else transform(sequence(1, size(words) - {size - 1}), i -> slice(words, i, {size})) end")).alias("window"))
    return w.groupBy("window").agg(F.collect_set("item_id").alias("items"))


def small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def weigh(df: DataFrame, size: Column) -> int:
    return df.agg(F.sum(size.cast("long") + 40).alias("n")).first()["n"] or 0


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """word, offset, window, items: each window under its rarest word over all documents (ties: the smaller word)."""
    placed = windows.select("window", "items", F.posexplode("window").alias("offset", "word"))
    vocabulary = checkpoint(placed.select("word").distinct())
    n = weigh(vocabulary, F.octet_length("word"))
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("word"))
    seen = seen.join(small(vocabulary, n), "word", "left_semi").groupBy("word").agg(F.count("*").alias("seen"))
    ranked = placed.join(small(seen, n), "word", "left").select("*", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "offset").alias("rank"))
    rarest = ranked.groupBy("window").agg(F.min("rank").alias("rank"), F.first("items").alias("items"))
    return rarest.select(F.col("rank.word").alias("word"), F.col("rank.offset").alias("offset"), "window", "items")


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, n_words, hits (sorted array of start, length), item_ids (array): one row for each document row."""
    items = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prefix = checkpoint(prefixes(own, item_windows(items, size)))
    n_windows, n_words = weigh(prefix, F.octet_length(F.array_join("window", "")) + 24 * F.size("window") + 16 * F.size("items")), prefix.select("word").distinct().count()
    n_blocks = max(1, -(-n_words // BLOCK))
    base = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    if n_blocks > 1:
        base = checkpoint(base)  # the passes meet by row number
    found = None
    for block in range(n_blocks):
        part = prefix.where(F.pmod(F.xxhash64("word"), F.lit(n_blocks)) == block)
        listed = [r["word"] for r in part.select("word").distinct().collect()]  # at most about BLOCK words of the benchmark
        is_prefix = (lambda x: x.isin(listed)) if listed else (lambda x: F.lit(False))
        reach = size - 1
        d = base.withColumn("places", F.filter(F.transform("words", lambda x, i: F.when(is_prefix(x), i)), lambda i: i.isNotNull()))
        d = d.withColumn("places", F.expr(f"transform(places, p -> struct(p as pos, words[p] as word, least(p, {reach}) as before, slice(words, greatest(p - {reach}, 0) + 1, {2 * reach + 1}) as near))"))
        d = d.select("row", "doc_id", F.size("words").alias("n_words"), F.explode_outer("places").alias("place"))
        d = d.select("row", "doc_id", "n_words", F.col("place.word").alias("word"), F.col("place.pos").alias("pos"), F.col("place.before").alias("before"), F.col("place.near").alias("near"))
        j = d.join(small(part, n_windows), "word", "left")
        start = F.col("pos") - F.col("offset")
        bounds = (start >= 0) & (start + F.size("window") <= F.col("n_words")) & (F.col("before") >= F.col("offset"))
        same = F.slice("near", F.when(bounds, F.col("before") - F.col("offset") + 1).otherwise(1), F.size("window")) == F.col("window")
        hit = F.coalesce(bounds & same, F.lit(False))
        j = j.select("row", "doc_id", "n_words", F.when(hit, F.struct(start.alias("start"), F.size("window").alias("length"))).alias("hit"), F.when(hit, F.col("items")).alias("items"))
        found = j if found is None else found.unionByName(j)
    grouped = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set("hit")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"))
    return grouped.drop("row")


def n_hit(hits: str = "hits") -> Column:
    """Words inside any of the sorted (start, length) spans."""
    return F.expr(f"aggregate({hits}, struct(0L as n, 0 as upto), (a, h) -> struct(a.n + greatest(0, h.start + h.length - greatest(a.upto, h.start)) as n, greatest(a.upto, h.start + h.length) as upto), a -> a.n)")


def contamination(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    c = contained(docs, items, **names)
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    c = c.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit().cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return c.withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns. The text alone decides, whatever the ids."""
    keys = [F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)]
    own = docs.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), F.col(text_col).alias("text"))
    bad = checkpoint(contamination(own, items, id_col="key").where("contaminated").select("doc_id.*").distinct())
    n_bytes = 40 * bad.count()
    bad = small(bad, n_bytes)
    return docs.join(bad, (keys[0] == bad["k0"]) & (keys[1] == bad["k1"]), "left_anti")
