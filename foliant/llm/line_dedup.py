"""Line dedup by a segment-partition edit join.

A line is removed if an earlier line of the corpus (by doc_id, then place) is equal to it and not blank, or, from
MIN_CHARS characters on, within TAU edits of it; whether that one is itself removed does not matter. A line within TAU
edits of another holds one of the other's TAU + 1 segments unchanged, at a place that the lengths allow: segments are
indexed, the allowed substrings of lines of the same or up to TAU more characters are probes, both by 64-bit keys, dealt
to buckets as packed arrays. An edit turns at most four character pairs, so lines whose pair parities (64 bits, carried
along) differ in more than 4 * TAU places are ruled out where a key's lines meet. Of the earlier lines left there, a line
is given the first few only; they are verified on the texts, with a banded bit-parallel edit distance, and the lines for
which none of them holds are then compared with the others of their keys. Lines themselves are fetched only for
candidates, from the documents that hold them.

Null texts stay null and have no lines; empty texts have one empty line. Documents with a null id are left as they are
and take no line from others. Repeated rows of one id are one document: their lines stay or go alike.
Ids are integers; others are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import buckets_for, checkpoint, require_integer_ids, slices, text_bytes, worker_cache

TAU, MIN_CHARS = 2, 24
#: Bytes of text for each bucket of keys; entries that a task gathers before it hands them on.
BUCKET_BYTES, FLUSH = 8 << 20, 400_000
#: Characters of distinct lines that a task gathers before it makes their entries; lines whose parities are reckoned together.
GATHER, AT_ONCE = 4_000_000, 4096
#: Candidates that a line is given at once under a key.
FEW = 2
#: Rows of pairs of numbers, and bytes of removed places, up to which they are broadcast; beyond, a shuffled join does the same.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
SEED = 42  # of the built-in xxhash64


def segments(n: int, tau: int) -> list[tuple[int, int]]:
    """The tau + 1 even parts of a length, as (start, end)."""
    k = tau + 1
    short, longer = n // k, n % k
    cuts = [0]
    for i in range(k):
        cuts.append(cuts[-1] + short + (i >= k - longer))
    return list(zip(cuts, cuts[1:]))


def probes(n: int, tau: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, end) of a line's substrings that may equal a segment of a line up to tau shorter."""
    found = []
    for low in range(max(tau + 1, n - tau), n + 1):
        more = n - low
        for i, (a, b) in enumerate(segments(low, tau)):
            left, right = i, tau - i  # edits there can be before the segment, and after it
            for start in range(max(0, a - left, a + more - right), min(n - (b - a), a + left, a + more + right) + 1):
                found.append((low, i, start, start + b - a))
    return found


def edit_distance_within(a: str, b: str, most: int) -> bool:
    """Whether two lines are within most edits, by a bit-parallel scan of the band of 2 * most + 1 diagonals (Hyyro 2003)."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a:
        return len(b) <= most
    # bit k of a column stands for the row (column + k - most); rows above the first are padding that never matches
    width = 2 * most + 1
    mask, top = (1 << width) - 1, 1 << width - 1
    where: dict[str, int] = {}
    for k, c in enumerate(a[:most]):
        where[c] = where.get(c, 0) | 1 << k + most + 1
    vp, vn = mask << most & mask, 0
    score = most  # of the lowest row of the band; rows below the last are padding too
    m, n = len(a), len(b)
    for j in range(n):
        where = {c: bits >> 1 for c, bits in where.items() if bits > 1}  # the band slides down one row
        if j + most < m:
            c = a[j + most]
            where[c] = where.get(c, 0) | top
        eq = where.get(b[j], 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        score += not d0 & top
        if score > 3 * most:
            return False
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
    # up from the band's lowest row to the last row, by vertical differences
    below = ((1 << 2 * most) - 1) & ~((1 << m - n + most) - 1)
    return score - (vp & below).bit_count() + (vn & below).bit_count() <= most


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, place, line for lines that are long enough or not blank, of documents with an id."""
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.where((F.length("line") >= min_chars) | F.col("line").rlike(r"\S"))


ENTRY = np.dtype([("key", "<u8"), ("line", "<i8"), ("doc", "<i8"), ("place", "<u4"), ("probe", "u1"), ("sig", "<u8")])


def pair_parities(lines: list[str]) -> np.ndarray:
    """For each line, 64 parities of its character pairs, by hash."""
    sizes = np.array([len(x) for x in lines], np.int64)
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    chars = np.append(chars, np.uint64(0))
    ends = np.cumsum(sizes)
    pair = (chars[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xBF58476D1CE4E5B9)
    bit = np.uint64(1) << (pair >> np.uint64(58))
    bit[ends[sizes > 0] - 1] = 0  # the last character of a line begins no pair
    out = np.zeros(len(lines), np.uint64)
    if len(bit):
        out[sizes > 0] = np.bitwise_xor.reduceat(bit, (ends - sizes)[sizes > 0])
    return out



def entries(docs: DataFrame, n_buckets: int, tau: int, min_chars: int) -> DataFrame:
    """bucket, entries (packed ENTRY): keys of all lines, each line once for each GATHER characters of a task, at its first place there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        worker_cache("lines")
        digest, h64 = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        plans: dict[int, tuple] = {}
        first: dict[int, tuple] = {}
        held = 0
        keys, lines, counts, kinds = [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            own = np.zeros(len(keys), ENTRY)
            own["key"], own["probe"] = np.array(keys, np.uint64), np.array(kinds, np.uint8)
            each = np.repeat(np.arange(len(lines)), counts)
            own["line"], own["doc"], own["place"] = np.array([x[0] for x in lines], np.uint64).view(np.int64)[each], np.array([x[1] for x in lines], np.int64)[each], np.array([x[2] for x in lines], np.uint32)[each]
            sigs = [pair_parities([x[3] for x in lines[k : k + AT_ONCE]]) for k in range(0, len(lines), AT_ONCE)]
            own["sig"] = np.concatenate([np.zeros(0, np.uint64), *sigs])[each]
            bucket = ((own["key"] >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            own, bucket = own[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            parts = np.split(own, cuts) if len(own) else []
            ids = bucket[np.concatenate([[0], cuts])].tolist() if len(own) else []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "entries"])
            for x in (keys, lines, counts, kinds):
                x.clear()

        def make() -> Iterator[pa.RecordBatch]:
            for h, (doc, place, line) in first.items():
                n = len(line)
                if n not in plans:
                    own = [(n, i, a, b) for i, (a, b) in enumerate(segments(n, tau))]
                    more = probes(n, tau)
                    plans[n] = [(low * (tau + 1) + i, a, b) for low, i, a, b in own + more], bytes(len(own)) + b"\1" * len(more)
                raw = line.encode() if line.isascii() else None
                plan, kind = plans[n]
                if raw is None:
                    keys.extend([digest(line[a:b].encode("utf-8", "surrogatepass"), seed) for seed, a, b in plan])
                else:
                    keys.extend([digest(raw[a:b], seed) for seed, a, b in plan])
                kinds.extend(kind)
                counts.append(len(plan)), lines.append((h, doc, place, line))
                if len(keys) > FLUSH:
                    yield from flush()
            yield from flush()
            first.clear()

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), chain.from_iterable(slices(batch.column("text")))):
                if doc is None or text is None:
                    continue
                for place, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars:
                        h = h64(line.encode(), SEED)
                        if h not in first:
                            held += len(line)
                        elif (doc, place) >= first[h][:2]:
                            continue
                        first[h] = doc, place, line
                if held > GATHER:
                    yield from make()
                    held = 0
        yield from make()

    return docs.select("doc_id", "text").mapInArrow(work, "bucket int, entries binary")


PAIR = "line long, doc long, place int, line2 long, doc2 long, place2 int"


def matched(found: DataFrame, tau: int) -> DataFrame:
    """Candidates (key null): a line and one of the first earlier lines that it may be near under a key, FEW at most.

    Where a line has more, the rows of its key (line, doc, place, probe, sig), with more set on the lines that have."""

    def work(group: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x, ENTRY) for x in group.column("entries").to_pylist()])
        e = e[np.lexsort((e["place"], e["doc"], e["key"]))]
        cut = np.flatnonzero(np.diff(e["key"])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(e)]])
        probes_ = np.add.reduceat(e["probe"].astype(np.int64), starts)
        low, high = np.minimum.reduceat(e["line"], starts), np.maximum.reduceat(e["line"], starts)
        real = (probes_ > 0) & (probes_ < ends - starts) & (low != high)
        two = real & (ends - starts == 2)
        two &= np.bitwise_count(e["sig"][starts] ^ e["sig"][ends - 1]) <= 4 * tau
        pairs, rest = [(e[ends[two] - 1], e[starts[two]])], []
        for s, t in zip(*(x[real & (ends - starts > 2)].tolist() for x in (starts, ends))):
            run = e[s:t]
            # the same line may come from several tasks: its earliest place counts
            run = run[np.sort(np.unique(np.stack([run["line"], run["probe"].astype(np.int64)]), axis=1, return_index=True)[1])]
            sig, line, probe = run["sig"], run["line"], run["probe"]
            more = np.zeros(len(run), bool)
            for x in range(1, len(run)):
                near = np.flatnonzero((np.bitwise_count(sig[:x] ^ sig[x]) <= 4 * tau) & (probe[:x] != probe[x]) & (line[:x] != line[x]))
                if len(near):
                    pairs.append((run[[x] * min(FEW, len(near))], run[near[:FEW]]))
                    more[x] = len(near) > FEW
            if more.any():
                rest.append((run, more))
        a, b = (np.concatenate([x[k] for x in pairs]) for k in (0, 1))
        run = np.concatenate([a, *[x[0] for x in rest]])
        flag = np.concatenate([np.zeros(len(a), bool), *[x[1] for x in rest]])
        no, is_pair = np.zeros(len(run) - len(a), np.int64), np.arange(len(run)) < len(a)
        cols = [pa.array(run["key"].view(np.int64), mask=is_pair), *[pa.array(run[c].astype(k)) for c, k in (("line", "i8"), ("doc", "i8"), ("place", "i4"), ("probe", "i4"))]]
        cols += [pa.array(np.append(b[c].astype("i8"), no).astype(k), mask=~is_pair) for c, k in (("line", "i8"), ("doc", "i8"), ("place", "i4"))]
        return pa.table([*cols, pa.array(np.ascontiguousarray(run["sig"]).view(np.int64)), pa.array(flag)], ["key", "line", "doc", "place", "probe", "line2", "doc2", "place2", "sig", "more"])

    return found.groupBy("bucket").applyInArrow(work, f"key long, line long, doc long, place int, probe int, {PAIR.split(', ', 3)[3]}, sig long, more boolean")


def verified(docs: DataFrame, pairs: DataFrame, tau: int) -> DataFrame:
    """The rows of pairs (PAIR) whose lines are within tau edits."""
    wanted = pairs.select("line", "doc", "place").unionByName(pairs.select(F.col("line2").alias("line"), F.col("doc2").alias("doc"), F.col("place2").alias("place")))
    wanted = checkpoint(wanted.groupBy("line").agg(F.min(F.struct("doc", "place")).alias("at")).select("line", F.col("at.doc").alias("doc_id"), F.col("at.place").alias("place")))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.join(wanted, "doc_id").select("line", F.get(F.split("text", "\n"), F.col("place")).alias("x")).where(F.xxhash64("x") == F.col("line"))
    texts = checkpoint(texts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = pa.array([edit_distance_within(x, y, tau) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(same) for c in ("line", "line2")], ["line", "line2"])

    joined = pairs.select("line", "line2").join(texts, "line").join(texts.select(F.col("line").alias("line2"), F.col("x").alias("y")), "line2")
    return joined.select("line", "line2", "x", "y").mapInArrow(work, "line long, line2 long")


def near_copies(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """line: hashes of the lines that have another within tau edits at an earlier first place in the corpus."""
    n_buckets = buckets_for(text_bytes(docs), BUCKET_BYTES)
    rows = checkpoint(matched(entries(docs, n_buckets, tau, min_chars), tau))
    pair = ["line", "doc", "place", "line2", "doc2", "place2"]
    pairs = checkpoint(rows.where("key is null").select(*pair).dropDuplicates(["line", "line2"]))
    done = checkpoint(verified(docs, pairs, tau))
    # lines that none of their first candidates is near, against all others under those keys
    rows = rows.where("key is not null").select("key", "line", "doc", "place", "probe", "sig", "more")
    left = rows.where("more").join(done.select("line").distinct(), "line", "left_anti").drop("more")
    other = rows.select("key", *[F.col(c).alias(f"{c}2") for c in ("line", "doc", "place", "probe", "sig")])
    earlier = (F.col("doc2") < F.col("doc")) | ((F.col("doc2") == F.col("doc")) & (F.col("place2") < F.col("place")))
    near = F.bit_count(F.col("sig").bitwiseXOR(F.col("sig2"))) <= 4 * tau
    rest = left.join(other, (left["key"] == other["key"]) & (F.col("probe") != F.col("probe2")) & (F.col("line") != F.col("line2")) & earlier & near)
    rest = rest.select(*pair).dropDuplicates(["line", "line2"]).join(pairs.select("line", "line2"), ["line", "line2"], "left_anti")
    return done.unionByName(verified(docs, checkpoint(rest), tau)).select("line").distinct()


def removed_places(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, gone (array of places): lines that an earlier equal or near line takes away."""
    lines = lines_of(docs, min_chars).select("doc_id", "place", F.xxhash64("line").alias("line"), F.xxhash64(F.lit(1), "line").alias("more"))
    first = lines.groupBy("line", "more").agg(F.min(F.struct("doc_id", "place")).alias("at"), F.count("*").alias("n"))
    near = checkpoint(near_copies(docs, tau, min_chars)).withColumn("near", F.lit(True))
    first = first.join(F.broadcast(near) if near.count() <= BROADCAST_ROWS else near, "line", "left").where("near or n > 1")
    gone = lines.join(first, ["line", "more"]).where("near is not null or struct(doc_id, place) <> at")
    return gone.groupBy("doc_id").agg(F.collect_set("place").alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """row (struct of all columns of docs, the text less its removed lines), n_lines, n_removed (long)."""
    require_integer_ids(docs, id_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = checkpoint(removed_places(own, tau, min_chars))
    size = gone.agg(F.sum(24 + 4 * F.size("gone")).alias("n")).first()["n"] or 0
    rows = docs.select(F.col(id_col).alias("doc_id"), F.struct(*docs.columns).alias("row"))
    joined = rows.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, "doc_id", "left")
    text = F.col("row")[text_col]
    joined = joined.select("row", F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), "gone", text.alias("text"))
    kept = F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains("gone", k))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.size(F.filter("gone", lambda k: k < F.col("n_lines"))), F.lit(0)).cast("long")
    return joined.select(F.col("row").withField(text_col, kept).alias("row"), "n_lines", F.when(F.col("gone").isNull() | F.col("text").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars (left), kept_sha256 of the text that stays (null: of the empty text)."""
    d = dedup(docs.select(id_col, text_col), id_col, text_col, **limits)
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    return d.select(F.col("row")[id_col].alias("doc_id"), "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **limits: int) -> DataFrame:
    """The documents with their texts less removed lines (and lengths to match); those left without a word are dropped."""
    d = dedup(docs, id_col, text_col, **limits)
    d = d.where((F.col("n_removed") == 0) | F.col("row")[text_col].rlike(r"\S"))
    row = F.col("row")
    if length_col in docs.columns:
        kind = dict(docs.dtypes)[length_col]
        row = row.withField(length_col, F.when(F.col("n_removed") > 0, F.length(row[text_col]).cast(kind)).otherwise(row[length_col]))
    return d.select(row.alias("row")).select("row.*")
