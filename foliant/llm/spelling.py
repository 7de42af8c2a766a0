"""Spelling variants by Aho-Corasick halves: words one edit apart, and the form that each variant stands for.

A word of L code points is cut into two segments. One edit leaves one of the two whole: the left one at the start of the
other word, the right one at its end. Segments are dealt out over shards by a hash; a shard builds one automaton over its
segments and scans the words that may hold one of them: each word goes to the shards of its own starts and ends, for
words as long as itself and for words one shorter (so each pair is met from its longer side), four at most. A match counts
only at its offset and for its length; then the distance is verified, code point by code point.

A segment that more than HOT words share is not left to one task: what the segment leaves open of its words is cut in two
again, as often as needed, so that no shard's list outgrows HOT words (or a single open code point).

Occurrences are summed in tasks over bounded dictionaries before the shuffle. Null and empty texts hold no words; a null id
reads as an empty one; repeated rows count each. Equal counts are told apart by code-point order. Words without a near
word have n_near 0 and no form, and are their own root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, slices

#: A maximal run of these is a word, once A-Z is lower case.
RUN = "[a-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, TIMES = 5, 3, 2
#: Fixed values of the planted slips: a run loses a code point where DAMAGE divides its checksum.
DAMAGE = 97
#: Words a task counts before it hands its sums on.
TASK_WORDS = 300_000
#: Words that may share a segment before what it leaves open is cut again.
HOT = 256
#: Rows of a shard.
SHARD_ROWS = 100_000
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000


def damaged(run: str, start: int) -> str:
    """The run, less one code point where the checksum of `<id>:<run>` says so; start: the checksum of `<id>:`."""
    h = zlib.crc32(run.encode(), start)
    if h % DAMAGE:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: occurrences over all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = re.compile(RUN).findall, Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return out

        for batch in batches:
            for ids, raws in zip(slices(batch.column("id")), slices(batch.column("raw"))):
                for i, raw in zip(ids, raws):
                    start = zlib.crc32(f"{i}:".encode())
                    for run, n in Counter(find(raw.lower().decode())).items():
                        if len(run) >= min_chars and len(w := damaged(run, start)) >= min_chars:
                            total[w] += n
                    if len(total) > TASK_WORDS:
                        yield rows()
        yield rows()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    return texts.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- near words --------------------------------------------------------------------------------------------------------


def one_edit(u: str, v: str) -> bool:
    """Exactly one code point inserted, deleted or replaced; v is not shorter than u."""
    n = len(u)
    if u == v or not 0 <= len(v) - n <= 1:
        return False
    k = 0
    while k < n and u[k] == v[k]:
        k += 1
    return u[k + (len(v) == n) :] == v[k + 1 :]


def known(word: Column, n: Column, a: Column, s: Column) -> Column:
    """Names the words of n code points that begin with this one's first a and end with its last s."""
    return F.xxhash64(n, a, s, F.substring(word, F.lit(1), a), F.substring(word, F.length(word) - s + 1, s))


def halves(entries: DataFrame) -> DataFrame:
    """Each entry twice: with the left, and with the right half of what it left open taken for whole."""
    left = F.floor((F.col("len") - F.col("a") - F.col("s")) / 2).cast("int")
    cut = F.array(F.struct((F.col("a") + left).alias("a"), F.col("s").alias("s")), F.struct(F.col("a").alias("a"), (F.col("len") - F.col("a") - left).alias("s")))
    out = entries.select("word", "n", "pattern", "len", F.explode(cut).alias("cut")).select("word", "n", "pattern", "len", "cut.a", "cut.s")
    return out.withColumn("key", known(F.col("word"), F.col("len"), F.col("a"), F.col("s")))


def segments(words: DataFrame, hot: int = HOT, min_chars: int = MIN_CHARS) -> DataFrame:
    """word, n, pattern, len, a, s, key: a word as a pattern of its own length, and as one that is scanned for patterns of len."""
    own = F.length("word")
    roles = F.array(F.struct(F.lit(True).alias("pattern"), own.alias("len")), F.struct(F.lit(False).alias("pattern"), own.alias("len")), F.struct(F.lit(False).alias("pattern"), (own - 1).alias("len")))
    rows = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.pattern", "r.len", F.lit(0).alias("a"), F.lit(0).alias("s")).where(F.col("len") >= min_chars)
    entries, done = halves(rows), None
    while True:
        entries = checkpoint(entries)
        # what is open halves each time, so this ends
        shared = entries.where("pattern and len - a - s > 1").groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > hot).select("key")
        shared = checkpoint(shared)
        n = shared.count()
        if not n:
            return entries if done is None else done.unionByName(entries)
        side = F.broadcast(shared) if n <= BROADCAST_ROWS else shared
        rest = entries.join(side, "key", "left_anti").select(*entries.columns)
        done = rest if done is None else done.unionByName(rest)
        entries = halves(entries.join(side, "key", "left_semi"))


def scan(group: pa.Table) -> pa.Table:
    """Of a shard's patterns and words: the pairs one edit apart, with both counts, the shorter or lesser word first."""
    import ahocorasick

    rows = list(zip(*(group.column(c).to_pylist() for c in ("word", "n", "pattern", "len", "a", "s"))))
    lists: dict[tuple, list] = {}
    for word, n, pattern, size, a, s in rows:
        if pattern:
            lists.setdefault((size, word[:a], word[size - s :]), []).append((word, n))
    needles: dict[str, list] = {}
    for key in lists:
        needles.setdefault(max(key[1:], key=len), []).append(key)
    found = []
    if needles:
        automaton = ahocorasick.Automaton()
        for needle, keys in needles.items():
            automaton.add_word(needle, (len(needle), keys))
        automaton.make_automaton()
        for v, m in {(word, n) for word, n, pattern, *_ in rows if not pattern}:
            for end, (k, keys) in automaton.iter(v):
                if end + 1 != k and end + 1 != len(v):
                    continue
                for key in keys:
                    size, head, tail = key
                    if 0 <= len(v) - size <= 1 and v.startswith(head) and v.endswith(tail):
                        found += [(u, n, v, m) for u, n in lists[key] if (size < len(v) or u < v) and one_edit(u, v)]
    found = sorted(set(found))
    return pa.table([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["a", "an", "b", "bn"])


def near_words(words: DataFrame, hot: int = HOT, min_chars: int = MIN_CHARS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, near, near_n: every ordered pair of words one edit apart, once."""
    entries = segments(words, hot, min_chars)
    shards = max(16, entries.count() // shard_rows)
    pairs = entries.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(scan, "a string, an long, b string, bn long").distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*")


# -- forms -------------------------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead at last. Steps double each round; who has arrived is not joined again."""
    steps = checkpoint(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while n := steps.where("open").count():
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.where("open").join(F.broadcast(on) if n <= BROADCAST_ROWS and steps.count() <= BROADCAST_ROWS else on, "root", "left")
        moved = moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        steps = checkpoint(moved.unionByName(steps.where("not open")))
    return steps.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of min_chars code points that occurs min_count times.

    form: the most frequent near word, if it occurs `times` as often as the word; root: the end of the chain of forms."""
    words = checkpoint(word_counts(docs, id_col, text_col, min_chars, min_count))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, hot, min_chars).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    far = F.col("near_n") >= times * F.col("n")
    out = checkpoint(out.select("word", "n", "n_near", F.when(far, F.col("near")).alias("form"), F.when(far, F.col("near_n")).alias("form_n")))
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
