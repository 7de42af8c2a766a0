"""Language-model scoring with a log-frequency Bloom filter.

fit() counts words and word pairs of the training texts in full. Counts are quantised on a log scale, and each n-gram is put
into the filter once for each level up to its own; a lookup probes level after level until one is missing. The filter is cut
into blocks, one for each bucket of hashes, built in parallel; a block's bits follow its own insertions, so that the filter
never overfills, whatever the size of the texts. The model is a table with a row for each bucket, which can be written and
read again, and scores any documents.

apply() scores documents. A filter of at most BROADCAST_BYTES is broadcast, and each chunk of documents probes it where it
is. A larger one stays with its buckets: each chunk sends its distinct words and pairs to those buckets that have any of
them, which probe their block and answer. Scores are the same either way.

    P(w | v) = L * c(v, w) / c(v) + (1 - L) * P(w),    P(w) = (c(w) + 1) / (N + V + 1)

with c read from the filter, and L the leave-one-out share of training tokens whose pair occurs elsewhere too; after a
word that the filter lacks, P(w) alone counts. The add-one base score needs exact counts of words, which the buckets always
answer. What is shuffled grows with the texts: distinct n-grams of each chunk and their counts, and the chunk's tokens as
compressed places among its words, never texts.
Null texts count as empty (one end token), repeated rows count and are scored each, other columns are left out. With no
training text N and V are 0 and every probability is 1.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import WordHashes, buckets_for, checkpoint, mix, text_bytes

#: Counts c are of level 1 + floor(log c / log STEP).
STEP, LEVELS = 1.5, 64
#: Bits for each insertion, probes of each lookup.
BITS, PROBES = 10, 5
#: Bytes of text for each bucket; of each chunk of documents.
BUCKET_BYTES, CHUNK_BYTES = 16 << 20, 6 << 20
#: Words that are hashed together.
AT_ONCE = 100_000
#: Bytes of a filter up to which it is broadcast; a larger one is asked by bucket.
BROADCAST_BYTES = 128 << 20
END, BEGIN = b"\n", b"\n\n"  # no word holds a line feed
PAIR = np.uint64(0x9E3779B97F4A7C15)
LOW48 = np.uint64((1 << 48) - 1)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Even parts of the range of hashes, by the top 24 bits."""
    return ((h >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(counts) / math.log(STEP) + 1e-9).astype(np.int64), LEVELS)


@functools.cache
def level_values() -> np.ndarray:
    """The count that a level stands for: the middle of its integers; level 0: none."""
    lows = [math.ceil(STEP ** (k - 1) - 1e-9) for k in range(1, LEVELS + 2)]
    return np.array([0.0] + [max(a, (a + b - 1) / 2) for a, b in zip(lows, lows[1:])])


def positions(keys: np.ndarray, level: int, probe: int, bits: int | np.ndarray) -> np.ndarray:
    """Places of mixed keys, by double hashing: the upper half of key + k * (key with its halves swapped), spread over the bits."""
    swapped = (keys << np.uint64(32)) | (keys >> np.uint64(32)) | np.uint64(1)
    x = (keys + swapped * np.uint64(level * PROBES + probe)) >> np.uint64(32)
    return ((x * np.asarray(bits, np.uint64)) >> np.uint64(32)).astype(np.int64)


class Filter:
    """Blocks side by side, by bucket; a key's block is its bucket. bits: of each block (0: it is empty), or of all alike."""

    def __init__(self, blocks: np.ndarray, bits: int | np.ndarray):
        own = np.asarray(bits, np.uint64)
        self.set, self.bits = blocks, own if own.ndim else np.full(len(blocks) * 8 // bits, own)
        self.base = (np.cumsum(self.bits) - self.bits).astype(np.int64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        if not len(self.bits):
            return np.zeros(len(h), np.int64)
        bucket = bucket_of(h, len(self.bits))
        at = bucket.astype(np.int64)
        return probed(self.set, (h & LOW48) | (bucket << np.uint64(48)), self.base[at], self.bits[at])


def probed(blocks: np.ndarray, keys: np.ndarray, base: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Levels of keys (low 48 bits of the hash, then the bucket) in the blocks that start at the bits base."""
    found = np.zeros(len(keys), np.int64)
    at = np.flatnonzero(bits)
    keys, base, bits = mix(keys)[at], base[at], bits[at]
    for level in range(1, LEVELS + 1):
        for probe in range(PROBES):
            place = base + positions(keys, level, probe, bits)
            here = np.flatnonzero((blocks[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            if len(here) < len(at):
                at, keys, base, bits = at[here], keys[here], base[here], bits[here]
        if not len(at):
            break
        found[at] = level
    return found


def block(bucket: int, words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, bits: int) -> np.ndarray:
    low = np.concatenate([words & LOW48, pairs]) | (np.uint64(bucket) << np.uint64(48))
    levels = level_of(np.concatenate([word_counts, pair_counts]).astype(np.float64)) if len(low) else np.zeros(0, np.int64)
    own, low = np.zeros(bits, bool), mix(low)
    for level in range(1, int(levels.max(initial=0)) + 1):
        if level > 1:
            low, levels = low[levels >= level], levels[levels >= level]
        for probe in range(PROBES):
            own[positions(low, level, probe, bits)] = True
    return np.packbits(own, bitorder="little")


def pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sums of their counts."""
    if not len(h):
        return h, n
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n, first)


class Reader:
    """Texts to word hashes, each text closed by the end token."""

    def __init__(self):
        self.hashes = WordHashes()
        self.end, self.begin = self.hashes([END, BEGIN])

    def __call__(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all tokens one after the other, and the number of tokens of each text."""
        words: list[bytes] = []
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(raws), np.int64)
        for k, raw in enumerate(raws):
            own = raw.lower().split()
            words += own
            words.append(END)
            sizes[k] = len(own) + 1
            if len(words) > AT_ONCE:  # words as objects take ten times the memory of their hashes
                parts.append(self.hashes(words))
                words.clear()
        return np.concatenate([*parts, self.hashes(words)]), sizes

    def before(self, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        v = np.empty_like(h)
        v[1:] = h[:-1]
        v[np.concatenate([[0], np.cumsum(sizes)[:-1]])[: len(sizes)].astype(np.int64)] = self.begin
        return v


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v * PAIR) + w)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Rows in runs of about size bytes of column raw, over batches' borders."""
    held, n_bytes = [], 0
    for batch in batches:
        ends, start = np.cumsum(pa.compute.binary_length(batch.column("raw")).to_numpy()), 0
        while start < len(ends):
            done = int(ends[start - 1]) if start else 0
            upto = min(len(ends), int(np.searchsorted(ends, done + size - n_bytes)) + 1)
            held.append(batch.slice(start, upto - start))
            n_bytes += int(ends[upto - 1]) - done
            start = upto
            if n_bytes >= size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_bucket(h: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has any, and the places of its hashes."""
    b = bucket_of(h, n_buckets).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(b[part[0]]), part


def packed(numbers: np.ndarray, width: int = 4) -> bytes:
    """Byte planes of unsigned numbers of that many bytes, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), "zstd", asbytes=True) if len(numbers) else b""


def unpacked(raw: bytes, n: int, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, width * n, "zstd", asbytes=True) if n else b"", np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


COUNTED = "bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"
MODEL = "bucket int, n_buckets int, bits long, block binary, words binary, counts binary, n_tokens long, n_words long, kept long"
SENT = "bucket int, chunk long, words binary, pairs binary, places binary, held binary"
ANSWERED = "bucket int, chunk long, n long, words binary, counts binary, levels binary, pair_levels binary, places binary, held binary"


def batches_of(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[start : start + 512]), schema.types)], schema=schema)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(list(batches_of(rows, schema)), schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def fit(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The model of the texts: for each bucket of hashes its block of the filter, the exact counts of its words (by hash), and sums."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    n_buckets = buckets_for(text_bytes(docs, text_col), BUCKET_BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        none = np.zeros(0, np.int64)
        for part in chunks(batches):
            h, sizes = read(part.column("raw").to_pylist())
            words, n = np.unique(h, return_counts=True)
            pairs, m = np.unique(pair_hash(read.before(h, sizes), h), return_counts=True)
            own, more = dict(by_bucket(words, n_buckets)), dict(by_bucket(pairs, n_buckets))
            rows = []
            for b in sorted(own.keys() | more.keys()):
                w, p = own.get(b, none), more.get(b, none)
                rows.append((b, words[w].astype("<u8").tobytes(), packed(n[w]), pack48(pairs[p]), packed(m[p])))
            yield from batches_of(rows, arrow_schema(COUNTED))

    def build(group: pa.Table) -> pa.Table:
        buckets, words, n, pairs, m = (x.to_pylist() for x in group.columns)
        words, pairs = [np.frombuffer(x, "<u8") for x in words], [unpack48(x) for x in pairs]

        def total(keys: list[np.ndarray], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate(keys), np.concatenate([unpacked(c, len(k)) for c, k in zip(counts, keys)]).astype(np.int64))

        (h, c), (q, d) = total(words, n), total(pairs, m)
        inserted = sum(int(level_of(x.astype(float)).sum()) for x in (c, d) if len(x))
        bits = max(64, -(-inserted * BITS // 8) * 8)
        own = block(buckets[0], h, c, q, d, bits)
        return table_of([(buckets[0], n_buckets, bits, own.tobytes(), h.astype("<u8").tobytes(), packed(c, 8), int(c.sum()), len(h), int((d - 1).sum()))], arrow_schema(MODEL))

    return checkpoint(texts.mapInArrow(count, COUNTED).groupBy("bucket").applyInArrow(build, MODEL))


def smoothed(sizes: np.ndarray, c_w: np.ndarray, c_end: float, pair: np.ndarray, share: float, total: int) -> np.ndarray:
    """The log10 probability of each text, from the counts of its tokens and of the pairs that they close."""
    c_v = np.empty_like(c_w)
    c_v[1:] = c_w[:-1]
    c_v[np.cumsum(sizes) - sizes] = c_end  # as many texts begin as end
    share = np.where(c_v > 0, share, 0)
    p = share * np.minimum(pair / np.maximum(c_v, 1), 1) + (1 - share) * (c_w + 1) / total
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), np.log10(np.minimum(p, 1.0)), len(sizes))


def whole_filter(model: DataFrame, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks side by side and the bits of each; only for filters whose size was looked at."""
    bits, blocks = np.zeros(n_buckets, np.uint64), [b""] * n_buckets
    for r in model.select("bucket", "bits", "block").toLocalIterator():
        bits[r["bucket"]], blocks[r["bucket"]] = r["bits"], bytes(r["block"])
    return np.frombuffer(b"".join(blocks), np.uint8), bits


def apply(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out (as given), n_tokens, n_known, train_tokens, base_score, score of each row by a model that fit() made."""
    texts = docs.select(F.col(id_col).alias("doc_id"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    kind = dict(texts.dtypes)["doc_id"]
    known = model.agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_words", "kept")], F.max("n_buckets").alias("n_buckets"), F.sum(F.length("block")).alias("n_bytes")).first()
    n_train, n_buckets = known["n_tokens"] or 0, known["n_buckets"] or 1
    total, share = n_train + (known["n_words"] or 0) + 1, min(0.95, (known["kept"] or 0) / max(1, n_train))
    near = (known["n_bytes"] or 0) <= BROADCAST_BYTES
    sent_filter = texts.sparkSession.sparkContext.broadcast(whole_filter(model, n_buckets)) if near else None

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, number = Reader(), 0
        own = Filter(*sent_filter.value) if near else None
        task, none = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for part in chunks(batches):
            h, sizes = read(part.column("raw").to_pylist())
            words, at, n = np.unique(h, return_inverse=True, return_counts=True)
            pair = pair_hash(read.before(h, sizes), h)
            held = pa.table({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": sizes})
            if near:
                pairs, pair_at = np.unique(pair, return_inverse=True)
                count = level_values()[own.levels(words)]
                lm = smoothed(sizes, count[at], count[np.searchsorted(words, read.end)], level_values()[own.levels(pairs)][pair_at], share, total)
                held, pairs = held.append_column("score", pa.array(lm)), pairs[:0]
            else:
                pairs = np.unique(pair)
            # frequent words get small places, which compress
            order = np.argsort(-n, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            chunk = (task << 32) + number
            number += 1
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(held)
            names = packed(order) if near else words[order].astype("<u8").tobytes()
            # first chunks of tasks would share a bucket, were they not spread
            rows = [(int(mix(np.array([chunk]))[0] % np.uint64(n_buckets)), chunk, names, None, packed(rank[at]), sink.getvalue().to_pybytes())]
            word_parts, pair_parts = dict(by_bucket(words, n_buckets)), dict(by_bucket(pairs, n_buckets))
            for b in sorted(word_parts.keys() | pair_parts.keys()):
                rows.append((b, chunk, words[word_parts.get(b, none)].astype("<u8").tobytes(), pack48(pairs[pair_parts.get(b, none)]), None, None))
            yield from batches_of(rows, arrow_schema(SENT))

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        """For each chunk, in the order it sent them: exact counts of words, and levels of words and pairs unless it has the filter. What a chunk holds goes through."""
        has = own.to_pylist()  # one row, or none if nothing was learned here
        h = np.frombuffer(has[0]["words"], "<u8") if has else np.zeros(0, np.uint64)
        c = unpacked(has[0]["counts"], len(h), 8).astype(np.int64) if has else np.zeros(0, np.int64)
        blocks, bits = (np.frombuffer(has[0]["block"], np.uint8), has[0]["bits"]) if has and not near else (None, 0)

        def levels(bucket: int, keys: np.ndarray) -> bytes:
            return probed(blocks, (keys & LOW48) | (np.uint64(bucket) << np.uint64(48)), np.zeros(len(keys), np.int64), np.full(len(keys), bits, np.uint64)).astype(np.uint8).tobytes()

        out = []
        for bucket, chunk, words, pairs, places, held in zip(*[x.to_pylist() for x in asked.columns]):
            if held is not None:
                out.append((None, chunk, None, words, None, None, None, places, held))
                continue
            w = np.frombuffer(words, "<u8")
            at = np.minimum(np.searchsorted(h, w), max(0, len(h) - 1))
            n = np.where(h[at] == w, c[at], 0) if len(h) else np.zeros(len(w), np.int64)
            out.append((bucket, chunk, len(w), None, packed(n, 8), None if near else levels(bucket, w), None if near else levels(bucket, unpack48(pairs)), None, None))
        return table_of(out, arrow_schema(ANSWERED))

    def close(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*[x.to_pylist() for x in group.columns]), key=lambda x: -1 if x[0] is None else x[0])
        (*_, names, _, _, _, places, held), answers = rows[0], rows[1:]
        t = pa.ipc.open_stream(held).read_all()
        sizes = t.column("n_tokens").to_numpy()
        # answers come in the order of buckets and, within each, of hashes: that of all hashes
        n = np.concatenate([unpacked(x[4], x[2], 8) for x in answers]).astype(np.int64)
        words = None if near else np.sort(np.frombuffer(names, "<u8"))
        order = unpacked(names, len(n)) if near else np.searchsorted(words, np.frombuffer(names, "<u8"))
        at = order[unpacked(places, int(sizes.sum()))]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        base = np.bincount(doc, np.log10(n + 1.0)[at] - math.log10(total), len(sizes))
        found = np.bincount(doc, n[at] > 0, len(sizes)).astype(np.int64)
        if near:
            lm = t.column("score").to_numpy()
        else:
            read, h = Reader(), words[at]
            count = level_values()[np.frombuffer(b"".join(x[5] for x in answers), np.uint8)]
            pair = level_values()[np.frombuffer(b"".join(x[6] for x in answers), np.uint8)][np.unique(pair_hash(read.before(h, sizes), h), return_inverse=True)[1]]
            lm = smoothed(sizes, count[at], count[np.searchsorted(words, read.end)], pair, share, total)
        return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": t.column("n_tokens"), "n_known": pa.array(found, pa.int64()), "train_tokens": pa.array([n_train] * len(t), pa.int64()), "base_score": base, "score": lm})

    own = model.select("bucket", "words", "counts", *([] if near else ["block", "bits"]))
    answers = texts.mapInArrow(look, SENT).groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(answer, ANSWERED)
    return answers.groupBy("chunk").applyInArrow(close, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from the rows that are not held out."""
    return apply(docs, fit(docs.where(~held_out), text_col), id_col, text_col, held_out)
