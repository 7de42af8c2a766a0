"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Not every suffix is sorted. Each 50-byte window is represented by its anchor: the place in it whose 24 bytes have the
least hash (leftmost of equals), so equal windows have equal anchors at equal offsets, and one suffix in about 14 does.
Shorter grams would need fewer suffixes, but recur by chance, the more so the larger the corpus.
A first pass tells which anchors occur in several documents: chunks of texts send the hashes of their anchors to buckets,
each bucket answers each chunk, and the chunk, its texts sent along compressed, goes on with the shared ones only. Their
suffixes, with the bytes that their windows take in before and after, go to ranges by their leading bytes; the splitters
come from a sample of the texts. Each range sorts its suffixes by multikey quicksort on 8-byte keys. Equal ones stand
together: all but those of the least document are wholly covered. Of the rest, each window meets the least document of
its equals, found by hash and compared byte by byte. Splitters lie between distinct leading keys of GRAM bytes, which
equal windows share, so windows to be compared never lie on two sides of a boundary. Copies within a chunk are settled
there and only the first is sent, so hot passages cost each chunk one suffix.

Null texts count as empty. Rows with a null id lose nothing and take nothing from others. Repeated rows of an id are one
document: they take nothing from each other, and lose the same. Matches never cross documents. Ids are integers; others are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import buckets_for, checkpoint, mix, require_integer_ids, text_bytes

MATCH, GRAM = 50, 24
WINDOWS = MATCH - GRAM + 1  # places of a gram in a match
SPAN = MATCH + WINDOWS - 1  # bytes that an anchor's windows can take in
#: Bytes of text worked on at once; of text for each bucket; of texts sampled for splitters, and most splitters.
BLOCK_BYTES, BUCKET_BYTES, SAMPLE_BYTES, SPLITTERS = 2 << 20, 8 << 20, 64 << 20, 1 << 18
#: Bytes of removed spans up to which they are broadcast; beyond, a shuffled join does the same.
BROADCAST_BYTES = 8 << 20


class Runs:
    """The runs of windows with one anchor, over texts laid end to end."""

    def __init__(self, raws: list[bytes]):
        self.sizes = np.array([len(r) for r in raws], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) if raws else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(raws) + bytes(SPAN + 16), np.uint8)
        n = int(self.sizes.sum())
        words = np.ndarray((n + SPAN,), "<u8", self.data, 0, (1,)).astype(np.uint64)
        x = words[: n + WINDOWS] * np.uint64(0x9E3779B97F4A7C15)
        x += words[8 : n + WINDOWS + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        x += words[16 : n + WINDOWS + 16] * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        least = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOWS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (WINDOWS - width)], least[WINDOWS - width :])
        # a window may start anywhere up to MATCH bytes before its document's end
        fits = np.zeros(n + 1, np.int32)
        whole = self.sizes >= MATCH
        np.add.at(fits, self.begins[whole], 1)
        np.add.at(fits, (self.begins + self.sizes)[whole] - MATCH + 1, -1)
        starts = np.flatnonzero(np.cumsum(fits[:n]))
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(starts) != 1)])) if len(starts) else np.zeros(0, np.int64)
        self.first, self.anchor = starts[new], at[new]
        self.last = starts[np.concatenate([new[1:], [len(starts)]]) - 1] if len(new) else starts[:0]
        self.doc = np.searchsorted(self.begins + self.sizes, self.first, "right")
        self.gram = x[self.anchor]

    def keep(self, mask: np.ndarray) -> None:
        for c in ("first", "anchor", "last", "doc", "gram"):
            setattr(self, c, getattr(self, c)[mask])

    def lead(self) -> np.ndarray:
        """The bytes at each anchor, in byte order."""
        return np.lib.stride_tricks.sliding_window_view(self.data, GRAM)[self.anchor].copy().view(f"S{GRAM}").ravel()


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of rows with an id, about BLOCK_BYTES together."""
    ids, raws, size = [], [], 0
    for batch in batches:
        for d, r in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist()):
            if d is not None:
                ids.append(d), raws.append(r)
                size += len(r)
                if size >= BLOCK_BYTES:
                    yield ids, raws
                    ids, raws, size = [], [], 0
    if ids:
        yield ids, raws


def split_by(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else [0]
    columns = [c[order] for c in columns]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(key[a]), *(c[a:b] for c in columns)


def split_points(texts: DataFrame, n_bytes: int, n_ranges: int) -> np.ndarray:
    """Leading bytes that part the suffixes at anchors into about n_ranges even ranges, by a sample of the texts."""
    fraction = min(1.0, SAMPLE_BYTES / max(1, n_bytes))
    n = min(n_ranges, SPLITTERS)
    part = texts.sample(fraction, seed=5) if fraction < 1 else texts
    share = 4 * n / max(1, min(n_bytes, SAMPLE_BYTES))  # wanted for each byte sampled

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raws in blocks(batches):
            lead = Runs(raws).lead()
            want = max(1, int(share * sum(map(len, raws))))
            yield pa.RecordBatch.from_pydict({"lead": pa.array([lead[:: max(1, len(lead) // want)].tobytes()], pa.binary())})

    lead = np.frombuffer(b"".join(bytes(r["lead"]) for r in part.mapInArrow(take, "lead binary").collect()), f"S{GRAM}")  # about 4 for each range
    lead = np.sort(lead)
    return np.unique(lead[:: max(1, len(lead) // n)])


def sent_order(gram: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, low half) of the distinct anchors by bucket, then low half; the first place of each, and each anchor's place among them."""
    bucket, low = bucket_of(gram, n_buckets), (gram & np.uint64(0xFFFFFFFF)).astype(np.int64)
    key, first, back = np.unique(bucket << 32 | low, return_index=True, return_inverse=True)
    return key >> 32, (key & 0xFFFFFFFF).astype("<u4"), first, back


ASKED = "bucket int, chunk long, low binary, several binary, held binary"
ANSWERED = "bucket int, chunk long, shared binary, held binary"


def shared_anchors(texts: DataFrame, n_buckets: int) -> DataFrame:
    """ANSWERED: for each chunk its texts (held) once, and for each bucket which of its anchors occur in several documents."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (ids, raws) in enumerate(blocks(batches)):
            runs, chunk = Runs(raws), (task << 32) + number
            bucket, low, first, back = sent_order(runs.gram, n_buckets)
            doc = np.unique(np.array(ids, np.int64), return_inverse=True)[1][runs.doc]
            several = np.zeros(len(low), bool)
            several[back[doc != doc[first][back]]] = True
            rows = [(chunk % n_buckets, chunk, None, None, pack_texts(ids, raws))]
            rows += [(b, chunk, own.tobytes(), np.packbits(s).tobytes(), None) for b, own, s in split_by(bucket, low, several)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), pa.int64(), *[pa.binary()] * 3])], ["bucket", "chunk", "low", "several", "held"])

    def answer(group: pa.Table) -> pa.Table:
        buckets, chunks, lows, severals, held = (x.to_pylist() for x in group.columns)
        asked = [k for k, x in enumerate(lows) if x is not None]
        own = [np.frombuffer(lows[k], "<u4") for k in asked]
        once = np.sort(np.concatenate([np.zeros(0, "<u4"), *own]))
        again = [once[1:][once[1:] == once[:-1]], *[x[np.unpackbits(np.frombuffer(severals[k], np.uint8), count=len(x)).view(bool)] for k, x in zip(asked, own)]]
        again = np.append(np.unique(np.concatenate(again)), np.uint64(1 << 32))
        out = [(buckets[k], chunks[k], None, held[k]) for k in range(len(chunks)) if held[k] is not None]
        out += [(buckets[k], chunks[k], np.packbits(again[np.searchsorted(again, x)] == x).tobytes(), None) for k, x in zip(asked, own)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), [pa.int32(), pa.int64(), pa.binary(), pa.binary()])], ["bucket", "chunk", "shared", "held"])

    return texts.mapInArrow(ask, ASKED).groupBy("bucket").applyInArrow(answer, ANSWERED)


def pack_texts(ids: list[int], raws: list[bytes]) -> bytes:
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "raw": pa.array(raws, pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def multikey_order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns in turn, and the group of equals of each place: only rows still tied look at the next column."""
    n = len(columns[0])
    order = np.argsort(columns[0], kind="stable")
    group = np.cumsum(np.concatenate([[0], columns[0][order][1:] != columns[0][order][:-1]])) if n else np.zeros(0, np.int64)
    for col in columns[1:]:
        size = np.bincount(group) if n else np.zeros(0, np.int64)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        again = np.lexsort((col[order[tied]], group[tied]))
        order[tied] = order[tied][again]
        v = col[order]
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | ((v[1:] != v[:-1]) & (group[1:] == group[:-1]))]))
    return order, group


RECORD = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("first", "<u4"), ("before", "u1"), ("size", "u1")])
INTERVAL = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("end", "<u4")])


def record_columns(rows: np.ndarray, before: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Keys in suffix order: from the anchor on first, then what stands before it, then the lengths; rows: SPAN bytes each."""
    n = len(rows)
    wide = np.zeros((n, 2 * SPAN + 8), np.uint8)
    wide[:, :SPAN] = rows
    idx = before[:, None].astype(np.int64) + np.arange(56)
    right = np.take_along_axis(wide, idx, 1)
    right[np.arange(56) >= (size.astype(np.int64) - before)[:, None]] = 0
    left = wide[:, :40].copy()
    left[np.arange(40) >= before[:, None]] = 0
    cols = [np.ascontiguousarray(right[:, k : k + 8]).view(">u8").ravel().astype(np.uint64) for k in range(0, 56, 8)]
    cols += [np.ascontiguousarray(left[:, k : k + 8]).view(">u8").ravel().astype(np.uint64) for k in range(0, 40, 8)]
    return [*cols, before.astype(np.uint64) << np.uint64(8) | size.astype(np.uint64)]


def settle(records: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Among suffix records: those wholly covered by an equal one of a lesser document (mask), and an order with equals together."""
    order, group = multikey_order(record_columns(rows, records["before"], records["size"]))
    doc = records["doc"][order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(order) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(doc, starts)[group] if len(order) else doc
    covered = np.zeros(len(records), bool)
    covered[order] = doc > least
    number = np.zeros(len(records), np.int64)
    number[order] = group
    return covered, number


def window_hashes(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of all MATCH-byte windows of each row, by a rolling polynomial over mixed bytes."""
    base = np.uint64(0xD1342543DE82EF95)
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    prefix = np.zeros((SPAN + 1, len(rows)), np.uint64)
    for k in range(SPAN):
        prefix[k + 1] = prefix[k] * base + table[rows[:, k]]
    power = np.uint64(pow(int(base), MATCH, 1 << 64))
    return mix(prefix[MATCH:] - prefix[:-MATCH] * power)


def covered_windows(records: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(records, WINDOWS) mask: windows that also start in a lesser document among these records."""
    h = window_hashes(rows).T
    valid = np.arange(WINDOWS) <= (records["size"].astype(np.int64) - MATCH)[:, None]
    r, w = np.nonzero(valid)
    out = np.zeros(valid.shape, bool)
    if not len(r):
        return out
    flat, doc = h[r, w], records["doc"][r]
    order = np.lexsort((doc, flat))
    flat, doc, r, w = flat[order], doc[order], r[order], w[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    rep = np.repeat(starts, np.diff(np.append(starts, len(flat))))
    hit = np.flatnonzero(doc[rep] < doc)
    # bytes are compared run by run: windows one after the other that meet the same record at the same shift
    r1, w1, r2, w2 = r[hit], w[hit], r[rep[hit]], w[rep[hit]]
    o = np.lexsort((w1, w2 - w1, r2, r1))
    r1, w1, r2, w2 = r1[o], w1[o], r2[o], w2[o]
    new = np.concatenate([[True], (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1]) | (w2[1:] - w1[1:] != w2[:-1] - w1[:-1]) | (w1[1:] != w1[:-1] + 1)])[: len(r1)]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(r1))) + MATCH - 1
    span = np.arange(SPAN)
    a, b = np.minimum(w1[first][:, None] + span, SPAN - 1), np.minimum(w2[first][:, None] + span, SPAN - 1)
    same = ((rows[r1[first][:, None], a] == rows[r2[first][:, None], b]) | (span >= size[:, None])).all(1)
    sure = same[np.cumsum(new) - 1]
    out[r1[sure], w1[sure]] = True
    for k in np.flatnonzero(~sure).tolist():  # one hash for different windows
        own = rows[r1[k], w1[k] : w1[k] + MATCH]
        for x in np.flatnonzero((flat == h[r1[k], w1[k]]) & (doc < records["doc"][r1[k]])).tolist():
            out[r1[k], w1[k]] |= bool((rows[r[x], w[x] : w[x] + MATCH] == own).all())
    return out


def intervals_of(records: np.ndarray, covered: np.ndarray, windows: np.ndarray | None) -> np.ndarray:
    """INTERVAL rows: whole records, and the runs of covered windows of the others."""
    whole = np.zeros(int(covered.sum()), INTERVAL)
    for c in ("doc", "tag"):
        whole[c] = records[c][covered]
    whole["start"], whole["end"] = records["first"][covered], records["first"][covered] + records["size"][covered]
    if windows is None:
        return whole
    pad = np.zeros((len(windows), WINDOWS + 2), np.int8)
    pad[:, 1:-1] = windows
    step = np.diff(pad, axis=1)
    r, a = np.nonzero(step == 1)
    b = np.nonzero(step == -1)[1]
    part = np.zeros(len(r), INTERVAL)
    for c in ("doc", "tag"):
        part[c] = records[c][r]
    part["start"], part["end"] = records["first"][r] + a, records["first"][r] + b - 1 + MATCH
    return np.concatenate([whole, part])


def removed_spans(texts: DataFrame, n_bytes: int) -> DataFrame:
    """doc_id, tag, spans (packed starts and ends, merged and sorted) from texts (doc_id, raw)."""
    n_buckets = buckets_for(n_bytes, BUCKET_BYTES)
    shared = texts.sparkSession.sparkContext.broadcast(split_points(texts, n_bytes, n_buckets))  # SPLITTERS at most
    schema = "bucket int, records binary, bytes binary, intervals binary"
    names = ["bucket", "records", "bytes", "intervals"]

    def by_doc(found: np.ndarray) -> list[tuple]:
        key = (mix(found["doc"].astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % n_buckets
        return [(-1 - b, None, None, part.tobytes()) for b, part in split_by(key, found)]

    def table(rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, [pa.int32(), *[pa.binary()] * 3])], names)

    def send(group: pa.Table) -> pa.Table:
        import xxhash

        splitters, out = shared.value, []
        answers = sorted(zip(*(group.column(c).to_pylist() for c in ("bucket", "shared"))), key=lambda x: x[0])
        held = pa.ipc.open_stream(next(x for x in group.column("held").to_pylist() if x is not None)).read_all()
        ids, raws = held.column("doc_id").to_pylist(), held.column("raw").to_pylist()
        runs = Runs(raws)
        if len(runs.gram):
            bucket, _, _, back = sent_order(runs.gram, n_buckets)
            sizes = np.unique(bucket, return_counts=True)[1]
            seen = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).view(bool) for (_, x), n in zip([a for a in answers if a[1] is not None], sizes.tolist())]
            runs.keep(np.concatenate(seen)[back])
        if len(runs.first):
            rec = np.zeros(len(runs.first), RECORD)
            tags = np.array([xxhash.xxh32_intdigest(r) for r in raws], np.uint32)
            rec["doc"], rec["tag"] = np.array(ids, np.int64)[runs.doc], tags[runs.doc]
            rec["first"], rec["before"], rec["size"] = runs.first - runs.begins[runs.doc], runs.anchor - runs.first, runs.last + MATCH - runs.first
            rows = np.lib.stride_tricks.sliding_window_view(runs.data, SPAN)[runs.first].copy()
            rows[np.arange(SPAN) >= rec["size"][:, None]] = 0
            covered, number = settle(rec, rows)
            out = by_doc(intervals_of(rec, covered, None)) if covered.any() else []
            stay = ~covered
            where = np.searchsorted(splitters, runs.lead()[stay], "right")
            order = np.lexsort((number[stay], where))
            rec, rows, where = rec[stay][order], rows[stay][order], where[order]
            for b, r, x in split_by(where, rec, rows):
                out.append((b, r.tobytes(), pa.compress(x.tobytes(), "zstd", asbytes=True), None))
        return table(out)

    def compare(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            return group.select(names)
        rec = np.concatenate([np.frombuffer(x, RECORD) for x in group.column("records").to_pylist()])
        rows = np.concatenate([np.frombuffer(pa.decompress(x, len(r) // RECORD.itemsize * SPAN, "zstd"), np.uint8).reshape(-1, SPAN) for r, x in zip(group.column("records").to_pylist(), group.column("bytes").to_pylist())])
        covered, number = settle(rec, rows)
        rest, rest_rows, number = rec[~covered], rows[~covered], number[~covered]
        # equals of one document stand for each other
        first, back = np.unique(number, return_index=True, return_inverse=True)[1:]
        windows = covered_windows(rest[first], rest_rows[first])[back] if len(rest) else np.zeros((0, WINDOWS), bool)
        found = intervals_of(rec, covered, None)
        return table(by_doc(np.concatenate([found, intervals_of(rest, np.zeros(len(rest), bool), windows)])))

    def merge(group: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x, INTERVAL) for x in group.column("intervals").to_pylist()])
        e = e[np.lexsort((e["start"], e["tag"], e["doc"]))]
        new = np.concatenate([[True], (e["doc"][1:] != e["doc"][:-1]) | (e["tag"][1:] != e["tag"][:-1])])
        docs, tags, spans = [], [], []
        for own in np.split(e, np.flatnonzero(new)[1:]):
            upto = np.maximum.accumulate(own["end"])
            cut = np.flatnonzero(np.concatenate([[True], own["start"][1:] > upto[:-1]]))
            docs.append(int(own["doc"][0])), tags.append(int(own["tag"][0]))
            spans.append(np.stack([own["start"][cut], upto[np.append(cut[1:], len(own)) - 1]], 1).astype("<u4").tobytes())
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "tag": pa.array(tags, pa.int64()), "spans": pa.array(spans, pa.binary())})

    sent = shared_anchors(texts, n_buckets).groupBy("chunk").applyInArrow(send, schema)
    found = sent.groupBy("bucket").applyInArrow(compare, schema)
    return found.groupBy("bucket").applyInArrow(merge, "doc_id long, tag long, spans binary")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (packed starts and ends of the maximal removed runs; null: none), kept (binary)."""
    require_integer_ids(docs, id_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    spans = checkpoint(removed_spans(texts, text_bytes(docs, text_col)))
    size = spans.select(F.sum(F.length("spans") + 24).alias("n")).first()["n"] or 0
    joined = texts.join(F.broadcast(spans.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "spans")).alias("cuts"))) if size <= BROADCAST_BYTES else spans.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "spans")).alias("cuts")), "doc_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            raws, own, kept = batch.column("raw").to_pylist(), [], []
            for raw, cuts in zip(raws, batch.column("cuts").to_pylist()):
                tag = xxhash.xxh32_intdigest(raw) if cuts else 0
                spans = next((c["spans"] for c in cuts or () if c["tag"] == tag), None)
                own.append(spans)
                if spans is None:
                    kept.append(raw)
                    continue
                flat = [0, *np.frombuffer(spans, "<u4").tolist(), len(raw)]
                kept.append(b"".join([raw[flat[k] : flat[k + 1]] for k in range(0, len(flat), 2)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array(own, pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.select("doc_id", "raw", "cuts").mapInArrow(cut, "doc_id long, n_bytes long, spans binary, kept binary")


def summary(docs: DataFrame, **names: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    d = dedup(docs, **names)
    return d.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.coalesce(F.length("spans") / 8, F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
