"""Token counts: a map-side two-tier lookup.

Tier one is a compact table of frequent pre-token lengths, broadcast to all workers; tier two is each worker's own
cache, filled by encoding the pre-tokens that tier one lacks. No pre-token is shuffled: the frequent ones are found
with bounded summaries (Misra-Gries), one for each task, merged in a tree of small groups.
Null texts count as empty, repeated rows each give a row, other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.pretoken import KEEP_BYTES, count, encode_words, specials, token_counts

TOKENIZER = "word_bpe_49k.json"
#: Entries of the broadcast table, and of each task's summary: both fixed, whatever the input.
TABLE, SUMMARY = 16_384, 2_048
#: Summaries that one merging task reads.
FAN_IN = 32


def keep_largest(counts: Counter, size: int) -> Counter:
    """Misra-Gries reduction: subtract the (size+1)-th count from all, keep what is above zero."""
    if len(counts) <= size:
        return counts
    cut = counts.most_common(size + 1)[-1][1]
    return Counter({k: n - cut for k, n in counts.items() if n > cut})


def pack(counts: Counter) -> bytes:
    """Pre-tokens hold no white space, so lines can hold them."""
    return b"\n".join(b"%d %b" % (n, k) for k, n in counts.items())


def unpack(blob: bytes) -> Counter:
    return Counter({k: int(n) for n, _, k in (x.partition(b" ") for x in blob.split(b"\n") if x)})


def frequent_pretokens(texts: DataFrame, size: int = TABLE) -> list[bytes]:
    """The pre-tokens with the largest counts, at most size, from summaries of all texts (binary column raw)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if raw:
                    counts.update(raw.lower().split())
                    if len(counts) > 64 * SUMMARY:
                        counts = keep_largest(counts, 8 * SUMMARY)
        counts = Counter({k: n for k, n in counts.items() if len(k) <= KEEP_BYTES})
        yield pa.RecordBatch.from_pydict({"summary": pa.array([pack(keep_largest(counts, SUMMARY))], pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for blob in group.column("summary").to_pylist():
            total.update(unpack(blob))
        return pa.table({"summary": pa.array([pack(keep_largest(total, 4 * SUMMARY))], pa.binary())})

    level = texts.select("raw").mapInArrow(summarise, "summary binary")
    tasks = texts.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = math.ceil(tasks / FAN_IN)
        level = level.withColumn("part", F.spark_partition_id() % F.lit(tasks)).groupBy("part").applyInArrow(merge, "summary binary")
    total: Counter = Counter()
    for row in level.collect():  # at most FAN_IN summaries of fixed size
        total.update(unpack(bytes(row["summary"])))
    return [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    marks = specials(tokenizer)[2]
    keys = [k for k in frequent_pretokens(texts) if not any(m in k for m in marks)]
    sizes = [count(ids) for ids in encode_words(tokenizer, keys)]
    compact = docs.sparkSession.sparkContext.broadcast((b"\n".join(keys), sizes))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sizes = compact.value
        frequent = dict(zip(words.split(b"\n"), sizes))
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            n = list(token_counts(tokenizer, raws, frequent))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(x) for x in raws], pa.int64()), "n_tokens": pa.array(n, pa.int64())})

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(tell, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
