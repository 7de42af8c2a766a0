"""Best-fit packing of token sequences: bounded-space online best-fit.

Each task packs its own pieces as they come. A fixed number of bins is open; a bitset keyed by free space finds the
fullest bin that still takes a piece, and when a bin must be opened beyond the fixed number, the fullest closes first.
The pieces of what is open at a task's end are loose again: groups of tasks, as many as keep MERGE_ROWS pieces in each, pack
them anew by best-fit, the longest first, so that neither the space lost nor what a task began badly adds up over tasks.
Placements and digests are rows; token ids are not shuffled. `sequences` gives the ids themselves.
Null texts count as empty (they hold the closing id only), repeated rows are packed each, other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, slices
from foliant.llm.pretoken import KEEP_WORDS, token_ids

TOKENIZER, CAPACITY, END_ID = "word_bpe_49k.json", 4096, 1
#: Open bins of a packer; loose pieces that one merging task packs; tokens free below which a bin is done at a task's end.
OPEN_BINS, MERGE_ROWS, NEARLY_FULL = 128, 50_000, 41
#: Rows of loose pieces up to which they are broadcast (24 bytes each); beyond, a shuffled join does the same.
BROADCAST_ROWS = 1_000_000


class BestFit:
    """Online best-fit with at most `most` open bins of one capacity."""

    def __init__(self, capacity: int, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f is set if an open bin has f units free
        self.bins: dict[int, list[int]] = {}
        self.open = self.made = 0

    def take(self, free: int) -> int:
        own = self.bins[free]
        k = own.pop()
        if not own:
            del self.bins[free]
            self.free &= ~(1 << free)
        self.open -= 1
        return k

    def put(self, k: int, free: int) -> None:
        self.bins.setdefault(free, []).append(k)
        self.free |= 1 << free
        self.open += 1

    def add(self, size: int) -> tuple[int, int]:
        """The bin that takes the item, and the item's offset in it."""
        fit = self.free >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            k = self.take(free)
        else:
            if self.open == self.most:
                self.take((self.free & -self.free).bit_length() - 1)
            k, free = self.made, self.capacity
            self.made += 1
        if free > size:
            self.put(k, free - size)
        return k, self.capacity - free

    def left(self) -> Iterator[tuple[int, int]]:
        """Open bins and what they hold."""
        for free, own in self.bins.items():
            for k in own:
                yield k, self.capacity - free


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, keep: int = KEEP_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each document.

    keep: pre-tokens that a worker keeps; it changes memory and time, not the result."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    kind = dict(texts.dtypes)["doc_id"]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "task", "used"]
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        bins, end, ids_of = BestFit(capacity), np.array([end_id], "<u4").tobytes(), pa.null()
        for batch in batches:
            ids_of = batch.column("doc_id").type
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), token_ids(tokenizer, chain.from_iterable(slices(batch.column("raw"))), keep)):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    k, offset = bins.add(size)
                    rows.append((doc_id, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), (task << 32) + k, offset, task, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t or ids_of) for x, t in zip(zip(*rows) if rows else [()] * 9, types)], names)
        left = [(None, None, None, None, None, (task << 32) + k, None, task, used) for k, used in bins.left() if capacity - used >= min(NEARLY_FULL, capacity // 2)]
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(x, t or ids_of) for x, t in zip(zip(*left), types)], names)

    def merge(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        bins = BestFit(capacity, len(group) + 1)
        items = sorted(zip(*(group.column(c).to_pylist() for c in ("length", "bin", "offset"))), reverse=True)
        out = [(k, at, -1 - (part << 32) - into, offset) for (size, k, at), (into, offset) in ((x, bins.add(x[0])) for x in items)]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("bin", "offset", "sequence_id", "moved"), zip(*out))})

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    rows = checkpoint(texts.mapInArrow(pack, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, task long, used long"))
    pieces = rows.where("used is null")
    loose = checkpoint(pieces.join(few(rows.where("used is not null").select("bin")), "bin").select("bin", "offset", "length", "task"))
    parts = max(1, -(-loose.count() // MERGE_ROWS))
    moved = checkpoint(loose.withColumn("part", F.pmod("task", F.lit(parts))).groupBy("part").applyInArrow(merge, "bin long, offset long, sequence_id long, moved long"))
    placed = pieces.join(few(moved), ["bin", "offset"], "left")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), F.coalesce("moved", "offset").alias("offset"))


def sequences(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """sequence_id, ids (array of int): the packed sequences themselves, for documents with distinct ids."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[*np.frombuffer(x, "<u4").tolist(), end_id] for x in token_ids(tokenizer, batch.column("raw").to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "all_ids": pa.array(ids, pa.list_(pa.int32()))})

    encoded = texts.mapInArrow(encode, f"doc_id {dict(texts.dtypes)['doc_id']}, all_ids array<int>")
    pieces = placed.join(encoded, "doc_id").select("sequence_id", F.struct("offset", F.expr("slice(all_ids, int(start + 1), int(length))").alias("ids")).alias("piece"))
    return pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces")).select("sequence_id", F.flatten("pieces.ids").alias("ids"))
