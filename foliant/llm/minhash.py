"""MinHash near-duplicates, with odd sketches between banding and verification.

A document's set is its distinct word shingles; equal sets are one class. A class has BANDS x ROWS MinHash samples, and a
name for each band of ROWS samples. Classes with a band's name in common are candidates: sets at the least similarity
wanted share none with probability (1 - 0.8^ROWS)^BANDS, 7e-10 with four rows and 40 bands at 0.8. The samples are also
folded into an odd sketch, a bitmap in which each (sample, value) turns one bit over: bits that differ between two
sketches are twice the samples that differ, less what falls together, so their number tells high similarities precisely.
Pairs whose sketches differ in more bits than such sets do but once in 10^9 go no further, nor do those whose whole sets,
folded the same way, differ in more bits than such sets differ in shingles, which no such pair does. The others are
confirmed on their full sets, fetched only for the documents that have such a pair.

A band's classes meet in one list. A task hands on a spanning forest of the list's candidate pairs, not all of them, so
that near copies, however many, give fewer pairs than classes. Lists with a pair that did not hold, and lists of several
blocks, go on with the components known so far: long lists are first met by one class of each component, and at last
every candidate pair across components is confirmed. No link between components is lost to the forests.

Null, empty and wordless texts have an empty set and link with nothing; texts with fewer words than a shingle have one
shingle, the whole. The least non-null id of a component names it. Rows with a null id follow equal texts and link with nothing
else; they are kept only if no row with an id stands for them. Repeated rows are copies of each other, and each is kept
whose id is the component's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, mix
from foliant.llm.jaccard_join import Sets, fetch_sets, near_join, roots_of, set_key

SHINGLE, PERCENT = 2, 80
#: Bands, and samples in each.
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, of samples or of a set.
BITS = 1024
#: How seldom a pair at the threshold may be ruled out by its sketches.
LOSS = 1e-9
#: Classes of a list, or of a block of a longer one, that one task compares; rows of lists for each task.
BLOCK, TASK_ROWS = 4096, 60_000
#: Rows of pairs or keys up to which they are broadcast (16 bytes each).
BROADCAST_ROWS = 200_000
#: Shingles a worker hashes at a time.
CHUNK = 512

_R = np.random.default_rng(20_240_229)
_MULTIPLY = (_R.integers(1, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1))[None, :]
_ADD = _R.integers(0, 2**32, SAMPLES, dtype=np.uint32)[None, :]
_PLACE = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))
_BAND = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


def samples(s: np.ndarray) -> np.ndarray:
    """The least value of a set of 64-bit hashes under each of SAMPLES permutations of their upper halves."""
    h = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(SAMPLES, 2**32 - 1, np.uint32)
    for at in range(0, len(h), CHUNK):
        np.minimum(least, (h[at : at + CHUNK] * _MULTIPLY + _ADD).min(0), out=least)
    return least


def band_names(least: np.ndarray) -> np.ndarray:
    """A 64-bit name of each band of each row of samples."""
    x = np.broadcast_to(_BAND, (len(least), BANDS)).copy()
    parts = least.astype(np.uint64).reshape(len(least), BANDS, ROWS)
    for k in range(ROWS):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return x.view(np.int64)


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """For each row of samples BITS parities, packed: each (sample, value) turns one bit over."""
    bit = mix(least.astype(np.uint64) + _PLACE[None, :]) % np.uint64(BITS)
    flat = (bit + (np.arange(len(least), dtype=np.uint64) * np.uint64(BITS))[:, None]).astype(np.int64).ravel()
    return np.packbits((np.bincount(flat, minlength=len(least) * BITS) & 1).astype(np.uint8).reshape(-1, BITS), axis=1)


def set_sketch(s: np.ndarray) -> np.ndarray:
    """BITS parities of a set, packed: each shingle turns one bit over, so sets differ in as many shingles at least as in bits."""
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8))


def estimate(differing: int, bits: int = BITS, k: int = SAMPLES) -> float:
    """Similarity that a number of differing bits of two sketches speaks for: twice the differing samples fell on them."""
    if 2 * differing >= bits:
        return 0.0
    return 1 + bits / (4 * k) * math.log(1 - 2 * differing / bits)


def most_differing(percent: int, loss: float = LOSS) -> int:
    """Bits in which sketches of sets at the similarity differ more than with probability `loss` at most.

    Exact: of binomially many differing samples each turns two bits, and the odd ones are followed bit by bit."""
    p = 1 - percent / 100
    odds = np.zeros(2 * SAMPLES + 1)  # of the number of odd bits after t samples differ
    odds[0] = 1.0
    total = np.zeros_like(odds)
    place = np.arange(len(odds))
    for t in range(SAMPLES + 1):
        total += math.comb(SAMPLES, t) * p**t * (1 - p) ** (SAMPLES - t) * odds
        for _ in range(2):
            down, up = odds * place / BITS, odds * (1 - place / BITS)
            odds = np.concatenate([down[1:], [0.0]]) + np.concatenate([[0.0], up[:-1]])
    return int(np.argmax(np.cumsum(total[::-1])[::-1] <= loss)) - 1


# -- classes and lists -------------------------------------------------------------------------------------------------


def documents_with_samples(texts: DataFrame, size: int) -> DataFrame:
    """doc_id, key, n, sketch (of the samples, then of the set), bands (names, packed): null, 0 and nulls without a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch in chain.from_iterable((whole.slice(at, 256) for at in range(0, len(whole), 256)) for whole in batches):
            own = [sets(raw) for raw in batch.column("raw").to_pylist()]
            least = np.stack([samples(s) for s in own])
            names, bits = band_names(least), np.hstack([odd_sketches(least), np.stack([set_sketch(s) for s in own])])
            packed = lambda rows: pa.array([r.tobytes() if len(s) else None for r, s in zip(rows, own)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([set_key(s) if len(s) else None for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int64()), packed(bits), packed(names)], ["doc_id", "key", "n", "sketch", "bands"])

    return texts.mapInArrow(work, f"doc_id {dict(texts.dtypes)['doc_id']}, key long, n long, sketch binary, bands binary")


def list_rows(classes: DataFrame) -> DataFrame:
    """token, key, m: the classes of each band's name that several have; m: how many."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.repeat(batch.column("key").to_numpy(), BANDS))], ["token", "key"])

    entries = classes.select("key", "bands").mapInArrow(work, "token long, key long")
    several = entries.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    return entries.join(several, "token")


# -- candidate pairs ---------------------------------------------------------------------------------------------------


def candidates(percent: int, most: int, every: bool):
    """From the rows of slots, (token, a, b): a spanning forest of the candidate pairs of two roots; every: all of those pairs."""

    def near(n: np.ndarray, bits: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
        alike = 100 * np.minimum(n[x], n[others]) >= percent * np.maximum(n[x], n[others])
        others = others[alike]
        differ = np.bitwise_count(bits[others] ^ bits[x]).reshape(len(others), 2, BITS // 64).sum(2, dtype=np.int64)
        total = n[x] + n[others]
        return others[(differ[:, 0] <= most) & ((100 + percent) * (total - differ[:, 1]) >= 2 * percent * total)]

    def pairs(n: np.ndarray, bits: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, int]]:
        if every:
            for x in range(len(n)):
                others = np.arange(x + 1, len(n))
                yield from ((x, y) for y in near(n, bits, x, others[root[others] != root[x]]).tolist())
            return
        _, back = np.unique(root, return_inverse=True)
        own = np.split(np.argsort(back, kind="stable"), np.cumsum(np.bincount(back))[:-1])
        left = np.ones(len(n), bool)
        for seed in range(len(n)):
            if not left[seed]:
                continue
            queue = own[back[seed]].tolist()
            left[queue] = False
            while queue and left.any():
                x = queue.pop()
                for y in near(n, bits, x, np.flatnonzero(left)).tolist():
                    if left[y]:
                        more = own[back[y]].tolist()
                        left[more] = False
                        queue += more
                        yield x, y

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by([("slot", "ascending"), ("key", "ascending")])
        slot, token, key, n, root = (group.column(c).to_numpy() for c in ("slot", "token", "key", "n", "root"))
        bits = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u8").reshape(len(group), -1)
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)]
        out = [(int(token[s]), int(key[s + x]), int(key[s + y])) for s, t in zip(cuts, cuts[1:]) for x, y in pairs(n[s:t], bits[s:t], root[s:t])]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 3)], ["token", "a", "b"])

    return work


def confirmed(texts: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose full sets reach the similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                s, t = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(s, t, assume_unique=True))
                hold.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(hold, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    keys = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    wanted = checkpoint(near_join(classes.select("key", "doc_id"), keys, keys.count(), "key", "left_semi"))
    sets = fetch_sets(texts, F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, size)
    sets = checkpoint(sets.dropDuplicates(["key"]))
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def component_roots(texts: DataFrame, classes: DataFrame, size: int, percent: int, block: int = BLOCK) -> DataFrame | None:
    """key, root of the classes that link with others; None if none does."""
    rows = checkpoint(list_rows(classes))
    n_rows, most = rows.count(), most_differing(percent)
    if not n_rows:
        return None
    rows = checkpoint(rows.join(classes.select("key", "n", "sketch"), "key"))
    tried = links = roots = None
    n_links = n_roots = 0
    k = F.ceil(F.col("m") / block)
    place = F.pmod(F.xxhash64(F.lit(13), "key"), k)
    for turn in ("blocks", "components", "all"):
        if turn == "blocks":
            own = rows.withColumn("root", F.col("key")).withColumn("slot", F.xxhash64("token", place))
        else:
            # lists with a pair that did not hold, and those of several blocks, while they hold several components
            todo = edges.join(links, ["a", "b"], "left_anti").select("token").unionByName(rows.where(F.col("m") > block).select("token"))  # noqa: F821
            todo = checkpoint(todo.distinct())
            n_todo = todo.count()
            if not n_todo:
                break
            own = near_join(near_join(rows, todo, n_todo, "token", "left_semi"), roots, n_roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
            own = checkpoint(own)
            own = own.join(own.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token"), "token")
            if turn == "components":
                one = own.where(F.col("m") > block).groupBy("token", "root").agg(F.min_by(F.struct("key", "n", "sketch", "m"), F.xxhash64("key")).alias("one"))
                own = one.select("token", "root", "one.*")
                parts = F.ceil(F.col("roots") / block)
                own = own.join(own.groupBy("token").agg(F.count("*").alias("roots")), "token").withColumn("slot", F.xxhash64("token", F.pmod(F.xxhash64(F.lit(17), "key"), parts)))
            else:
                own = own.withColumn("x", place).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), k - 1))).withColumn("slot", F.xxhash64("token", F.least("x", "y"), F.greatest("x", "y")))
        own = own.select("slot", "token", "key", "n", "sketch", "root")
        met = own.withColumn("bucket", F.pmod("slot", F.lit(max(64, n_rows // TASK_ROWS)))).groupBy("bucket").applyInArrow(candidates(percent, most, turn == "all"), "token long, a long, b long")
        met = checkpoint(met)
        edges = met if turn == "blocks" else edges.unionByName(met)  # noqa: F821
        pairs = met.select("a", "b").distinct()
        pairs = checkpoint(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        if pairs.count():
            found = checkpoint(confirmed(texts, classes, pairs, size, percent))
            links = found if links is None else links.unionByName(found)
            n_links += found.count()
            roots = checkpoint(roots_of(links, n_links))
            n_roots = roots.count()
        if links is None:
            return None
    return roots if n_roots else None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included), kept (component_id is its own)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    rows = checkpoint(documents_with_samples(texts, size))
    classes = checkpoint(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "sketch", "bands")]))
    roots = component_roots(texts, classes.where("doc_id is not null"), size, percent, block)
    named = classes.select("key", "doc_id", F.col("key").alias("root")) if roots is None else classes.select("key", "doc_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = named.join(least, "root").select("key", "component_id")
    out = rows.select("doc_id", "key", "n").join(names, "key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
