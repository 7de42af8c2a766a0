"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct word shingles. Shingles are ordered by rarity; two sets that reach the similarity share
one of their first n - ceil(t * n) + 1 shingles. Documents with the same prefix and size form one group, and equal sets
one class within it. Rarity comes from a sketch of fixed size (counts by hash): any total order gives right results, a
rarity order gives few candidates.

Groups that share a prefix shingle meet in that shingle's list. A task holds whole lists (long ones cut into blocks): it
rules out pairs of groups by size and by the shingle's places, expands the pairs left to their members, one for each
distinct set, and rules out members by parity bitmaps, about a bit for each shingle: two sets differ in as many shingles
at least as their bitmaps in bits. Of the members' pairs left it hands on a spanning forest only, so a list gives fewer
pairs than it has rows, however many of its sets are alike. Pairs are verified on the sets themselves, fetched only for
the documents that have such pairs. Where all of a forest's pairs hold, its list is done: no other pair of it can join
components. The other lists, and the lists of several blocks, go on, their members joined by the links known so far:
blocks are first met by one member of each component, then by pairs of blocks, and at last every pair across components
that was not verified yet is. So no link between components is missed, and none within them is looked for.

Null, empty and wordless texts have an empty set and link with nothing; texts with fewer words than a shingle have one
shingle, the whole; rows with a null id follow equal texts and link with nothing else; the least non-null id names a component;
repeated rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import WordHashes, checkpoint, mix, slices, worker_cache
from foliant.llm.components import components

SHINGLE, PERCENT = 3, 90
#: Cells of the rarity sketch (fixed), and rows it is dealt out in.
CELLS, PARTS = 1 << 20, 64
#: 64-bit words of a folded parity bitmap.
BITMAP = 8
#: Rows of a list (or of a block of a longer one) that one task compares; rows of lists for each task.
BLOCK, TASK_ROWS = 2048, 60_000
#: Tasks whose sketches one task adds up.
FAN_IN = 64
#: Rows of keys or pairs up to which they are broadcast; links up to which one task joins them into components (16 bytes each).
BROADCAST_ROWS, TASK_LINKS = 200_000, 500_000


class Sets:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, size: int):
        self.size, self.hashes = size, WordHashes()

    def __call__(self, raw: bytes) -> np.ndarray:
        words = raw.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self.hashes(words)
        n = max(1, len(h) - self.size + 1)
        s = np.full(n, min(len(h), self.size), np.uint64)
        for k in range(min(len(h), self.size)):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(s)


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    x = np.array([np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA0761D6478BD642F))), s.sum(dtype=np.uint64), len(s)], np.uint64)
    x = mix(x)
    return int(mix(x[:1] + x[1:2] * np.uint64(3) + x[2:])[0].astype(np.int64))


def cells_of(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(CELLS - 1)).astype(np.int64)


def rarity(texts: DataFrame, size: int) -> np.ndarray:
    """For each cell, how many shingles of all sets fall in it, on a log scale (one byte)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("sets")
        own, sets = np.zeros(CELLS, np.int64), Sets(size)
        for batch in batches:
            for raws in slices(batch.column("raw")):
                own += np.bincount(cells_of(np.concatenate([sets(r) for r in raws])), minlength=CELLS)
        parts = own.astype("<u8").reshape(PARTS, -1)
        # most counts are small: bytes do for a part whose counts all fit
        rows = [(p, x.astype("<u1").tobytes() if x.max() < 256 else x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes()) for p, x in enumerate(parts) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "counts"])

    def read(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, f"<u{len(raw) * PARTS // CELLS}").astype("<u8")

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // PARTS, "<u8")
        for raw in group.column("counts").to_pylist():
            total += read(raw)
        return pa.table({"part": group.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    level = texts.select("raw").mapInArrow(count, "part int, counts binary").withColumn("task", F.spark_partition_id())
    tasks = max(1, texts.rdd.getNumPartitions())
    while True:
        tasks = -(-tasks // FAN_IN)
        level = level.withColumn("task", F.col("task") % tasks).groupBy("part", "task").applyInArrow(add, "part int, counts binary")
        if tasks == 1:
            break
        level = level.withColumn("task", F.spark_partition_id())
    out = np.zeros((PARTS, CELLS // PARTS), np.uint8)
    for r in level.collect():  # 64 rows of fixed size
        out[r["part"]] += np.round(8 * np.log2(read(r["counts"]) + 1.0)).clip(0, 255).astype(np.uint8)
    return out.ravel()


def bitmap(s: np.ndarray) -> np.ndarray:
    """For a power of two of bits, not fewer than the shingles, whether an odd number of shingles falls on each; in 64-bit words."""
    bits = 64 * BITMAP << max(0, (len(s) - 1).bit_length() - (64 * BITMAP - 1).bit_length())
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """The bitmap of n words (powers of two): parities add up."""
    return np.bitwise_xor.reduce(words.reshape(-1, n), axis=0)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def documents_and_entries(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """A row for each document (key, grp, n, bits, folded and wide; prefix: its group's, given once for each task and group)."""
    order = texts.sparkSession.sparkContext.broadcast(rarity(texts, size))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sets, told = order.value, Sets(size), set()
        for batch in chain.from_iterable((whole.slice(at, 1024) for at in range(0, len(whole), 1024)) for whole in batches):
            keys, groups, sizes, bits, wide, prefixes = [], [], [], [], [], []
            for raw in batch.column("raw").to_pylist():
                s = sets(raw)
                n = len(s)
                sizes.append(n)
                if not n:
                    keys.append(None), groups.append(None), bits.append(None), wide.append(None), prefixes.append(None)
                    continue
                p = prefix_length(n, percent)
                rank = cells[cells_of(s)].astype(np.uint64)
                first = s[np.lexsort((s, rank))[:p]]
                g = set_key(np.append(first, np.uint64(n)))
                own = bitmap(s)
                keys.append(set_key(s)), groups.append(g), bits.append(fold(own, BITMAP).tobytes()), wide.append(own.tobytes())
                prefixes.append(None if g in told else first.view(np.int64).tolist())
                if len(told) > 200_000:
                    told.clear()
                told.add(g)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": pa.array(keys, pa.int64()), "grp": pa.array(groups, pa.int64()), "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.binary()), "wide": pa.array(wide, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64()))})

    return texts.mapInArrow(work, f"doc_id {dict(texts.dtypes)['doc_id']}, key long, grp long, n long, bits binary, wide binary, prefix array<long>")


def fetch_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """key, shingles (packed, sorted) of the wanted documents (one doc_id for each key)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch in chain.from_iterable((whole.slice(at, 1024) for at in range(0, len(whole), 1024)) for whole in batches):
            own = [sets(r) for r in batch.column("raw").to_pylist()]
            mask = pa.array([set_key(s) == k for s, k in zip(own, batch.column("key").to_pylist())], pa.bool_())  # repeated ids may have other texts
            yield pa.RecordBatch.from_arrays([batch.column("key").filter(mask), pa.array([s.tobytes() for s in own], pa.binary()).filter(mask)], ["key", "shingles"])

    return texts.join(wanted, "doc_id").select("key", "raw").mapInArrow(work, "key long, shingles binary")


def verify(texts: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets reach the similarity."""

    def near(x: bytes, y: bytes, n: int, m: int) -> bool:
        s, t = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")  # unsigned: bits of a negative number are not its value's
        k = min(len(s), len(t))
        differing = int(np.bitwise_count(fold(s, k) ^ fold(t, k)).sum())
        return (100 + percent) * (n + m - differing) >= 2 * percent * (n + m)

    def linked(x: bytes, y: bytes, n: int, m: int) -> bool:
        both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
        return 100 * both >= percent * (n + m - both)

    def passing(pairs: DataFrame, rows: DataFrame, test) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = pa.array([test(*x) for x in zip(*[batch.column(c).to_pylist() for c in ("x", "y", "n", "m")])], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

        few = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
        joined = few.join(rows.select(F.col("key").alias("a"), F.col("value").alias("x"), "n"), "a").join(rows.select(F.col("key").alias("b"), F.col("value").alias("y"), F.col("n").alias("m")), "b")
        return joined.select("a", "b", "x", "y", "n", "m").mapInArrow(work, "a long, b long")

    def of(pairs: DataFrame, cols: list) -> DataFrame:
        keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        return classes.select("key", *cols).join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "key")

    pairs = checkpoint(passing(pairs, of(pairs, ["n", F.col("wide").alias("value")]), near))
    wanted = checkpoint(of(pairs, ["doc_id"]))
    sets = fetch_sets(texts, F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, size)
    return passing(pairs, checkpoint(sets.dropDuplicates(["key"])).select("key", F.col("shingles").alias("value"), (F.octet_length("shingles") / 8).cast("long").alias("n")), linked)


ENTRY = "slot long, token long, grp long, key long, n long, pos int, bits binary, root long"


def forest(percent: int, every: bool):
    """From the rows of slots, (slot, token, a, b): a spanning forest of the pairs that may link and join two roots; every: all of those pairs.

    Rows with a null grp are pairs (key, root) known not to link."""

    def lists(group: pa.Table) -> Iterator[tuple]:
        group = group.sort_by([("slot", "ascending"), ("n", "ascending"), ("key", "ascending")])
        slot, token, grp, key, n, root = (group.column(c).to_numpy() for c in ("slot", "token", "grp", "key", "n", "root"))
        pos = group.column("pos").to_numpy()
        bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), "<u8").reshape(-1, BITMAP)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(slot)) + 1, [len(slot)]])
        for s, t in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(slot[s]), int(token[s]), grp[s:t], key[s:t], n[s:t], pos[s:t], bits[s:t], root[s:t]

    def groups_near(n, pos, x: int, others: np.ndarray) -> np.ndarray:
        """Which of the others' groups the group of x may link with, by size and by the shingle's places."""
        m, q = n[others], pos[others]
        most = np.minimum(pos[x], q) + 1 + np.minimum(n[x] - pos[x], m - q) - 1
        return (100 * np.minimum(n[x], m) >= percent * np.maximum(n[x], m)) & ((100 + percent) * most >= percent * (n[x] + m))

    def members_near(n, bits, x: int, others: np.ndarray) -> np.ndarray:
        """Which of the others bitmaps leave in: sets share (a + b - differing bits) / 2 at most."""
        total = n[x] + n[others]
        return (100 + percent) * (total - np.bitwise_count(bits[others] ^ bits[x]).sum(1, dtype=np.int64)) >= 2 * percent * total

    def near(part: tuple, x: int, others: np.ndarray, bad: dict) -> np.ndarray:
        _, _, grp, key, n, pos, bits, _ = part
        if len(others) > 64:  # whole groups first
            g, back = np.unique(grp[others], return_inverse=True)
            one = np.empty(len(g), np.int64)
            one[back] = others
            others = others[groups_near(n, pos, x, one)[back]]
        else:
            others = others[groups_near(n, pos, x, others)]
        others = others[members_near(n, bits, x, others)]
        no = bad.get(int(key[x]))
        return others[[int(k) not in no for k in key[others]]] if no else others

    def pairs(part: tuple, bad: dict) -> Iterator[tuple[int, int]]:
        key, root = part[3], part[7]
        if every:
            for x in range(len(key)):
                others = np.arange(x + 1, len(key))
                for y in near(part, x, others[root[others] != root[x]], bad).tolist():
                    yield x, y
            return
        roots, back = np.unique(root, return_inverse=True)
        own = np.split(np.argsort(back, kind="stable"), np.cumsum(np.bincount(back))[:-1]) if len(roots) < len(root) else None
        left = np.ones(len(key), bool)
        for seed in range(len(key)):
            if not left[seed]:
                continue
            queue = own[back[seed]].tolist() if own else [seed]
            left[queue] = False
            while queue and left.any():
                x = queue.pop()
                for y in near(part, x, np.flatnonzero(left), bad).tolist():
                    if left[y]:
                        more = own[back[y]].tolist() if own else [y]
                        left[more] = False
                        queue += more
                        yield x, y

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        known, rows = group.filter(pa.compute.is_null(group.column("grp"))), group.filter(pa.compute.is_valid(group.column("grp")))
        failed: dict[int, dict] = {}
        for slot, a, b in zip(*(known.column(c).to_pylist() for c in ("slot", "key", "root"))):
            own = failed.setdefault(slot, {})
            own.setdefault(a, set()).add(b), own.setdefault(b, set()).add(a)
        out = []
        for part in lists(rows) if len(rows) else ():
            key = part[3]
            out += [(part[0], part[1], int(min(key[x], key[y])), int(max(key[x], key[y]))) for x, y in pairs(part, failed.get(part[0], {}))]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 4)], ["slot", "token", "a", "b"])

    return work


def roots_of(links: DataFrame, n: int) -> DataFrame:
    """key, root for every key of the links (a, b): one task's union-find while their number n is bounded, rounds of joins beyond."""
    if n > TASK_LINKS:
        return components(links).withColumnRenamed("node", "key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        keys = list(up)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "root": pa.array([top(k) for k in keys], pa.int64())})

    return links.select("a", "b").coalesce(1).mapInArrow(work, "key long, root long")


def near_join(df: DataFrame, other: DataFrame, n: int, on, how: str) -> DataFrame:
    """A join that broadcasts the other side if its n rows are few."""
    return df.join(F.broadcast(other) if n <= BROADCAST_ROWS else other, on, how)


def list_rows(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """A row for each class in each list that holds several: token, grp, key, n, pos, bits, m (the list's rows)."""
    entries = rows.where("prefix is not null").select("grp", F.posexplode("prefix").alias("pos", "token"))
    # lists of several groups; and for groups of several classes, the list of their first shingle
    lists = entries.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high").select("token")
    several = classes.groupBy("grp").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("grp")
    own = rows.where("prefix is not null").select("grp", F.col("prefix")[0].alias("token")).join(several, "grp", "left_semi").select("token")
    entries = entries.join(lists.unionByName(own).distinct(), "token").select("token", "grp", "pos").distinct()
    entries = checkpoint(entries.join(classes.groupBy("grp").agg(F.count("*").alias("members")), "grp"))
    entries = entries.join(entries.groupBy("token").agg(F.sum("members").alias("m")), "token")
    return entries.join(classes.select("grp", "key", "n", "bits"), "grp").select("token", "grp", "key", "n", "pos", "bits", "m")


def link_components(rows: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame | None:
    """key, root for the classes that link with others; None if none does."""
    entries = checkpoint(list_rows(rows, classes))
    n_rows = entries.count()
    roots = links = tried = edges = None
    n_roots = n_links = 0

    def block(key: str, k) -> Column:
        return F.pmod(F.xxhash64(F.lit(7), key), k)

    k = F.ceil(F.col("m") / BLOCK)
    for turn in ("blocks", "components", "pairs", "all"):
        if turn != "blocks":
            # lists with a pair that did not hold, and those of several blocks, as long as they hold several components
            failed = checkpoint(edges.join(links, ["a", "b"], "left_anti").select("token", "a", "b").distinct())
            todo = failed.select("token")
            if turn != "all":
                todo = todo.unionByName(entries.where(F.col("m") > BLOCK).select("token"))
            todo = checkpoint(todo.distinct())
            n_todo = todo.count()
            if not n_todo:
                break
            own = near_join(near_join(entries.drop("root"), todo, n_todo, "token", "left_semi"), roots, n_roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
            own = checkpoint(own)
            still = own.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count_distinct("root").alias("n_roots")).where("low <> high").select("token", "n_roots")
            known = failed.join(own.select("token", "m").distinct(), "token")
            own = own.join(still, "token")
        else:
            own, known = entries.withColumn("root", F.col("key")), None
        if turn == "blocks":
            own = own.withColumn("slot", F.xxhash64("token", block("key", k)))
        elif turn == "components":
            long = own.where(F.col("m") > BLOCK)
            long = long.groupBy("token", "root", "n_roots").agg(F.min_by(F.struct("grp", "key", "n", "pos", "bits", "m"), F.xxhash64("key")).alias("one")).select("token", "root", "n_roots", "one.*")
            long = long.withColumn("slot", F.xxhash64("token", block("root", F.ceil(F.col("n_roots") / BLOCK))))
            own = own.where(F.col("m") <= BLOCK).withColumn("slot", F.xxhash64("token", F.lit(0).cast("long"))).unionByName(long)
            known = known.withColumn("slot", F.xxhash64("token", F.lit(0).cast("long")))
        else:
            other = F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
            own = own.withColumn("x", block("key", k)).withColumn("y", other).withColumn("slot", F.xxhash64("token", F.least("x", "y"), F.greatest("x", "y")))
            known = known.withColumn("x", block("a", k)).withColumn("y", block("b", k)).withColumn("slot", F.xxhash64("token", F.least("x", "y"), F.greatest("x", "y")))
        names = [x.split()[0] for x in ENTRY.split(", ")]
        own = own.select(*names)
        if known is not None:
            known = known.select("slot", "token", F.lit(None).cast("long").alias("grp"), F.col("a").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("pos"), F.lit(b"").alias("bits"), F.col("b").alias("root"))
            own = own.unionByName(known)
        buckets = max(64, n_rows // TASK_ROWS)
        edges = own.withColumn("bucket", F.pmod("slot", F.lit(buckets))).groupBy("bucket").applyInArrow(forest(percent, turn == "all"), "slot long, token long, a long, b long")
        edges = checkpoint(edges)
        pairs = edges.select("a", "b").distinct()
        pairs = checkpoint(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = checkpoint(verify(texts, classes, pairs, size, percent))
        links = found if links is None else links.unionByName(found)
        n_links += found.count()
        roots = checkpoint(roots_of(links, n_links))
        n_roots = roots.count()
    return roots if n_roots else None


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable by links, itself included."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    rows = checkpoint(documents_and_entries(texts, size, percent))
    # classes of equal sets; a class is named by its key
    classes = checkpoint(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("grp", "n", "bits", "wide")]))
    roots = link_components(rows, classes, texts, size, percent)
    if roots is None:
        named = classes.withColumn("root", F.col("key"))
    else:
        named = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = named.join(least, "root").select("key", "component_id")
    out = rows.select("doc_id", "key", "n").join(names, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that name their component (the least id), with all their columns; of rows with the same id one stays, and those with a null id all do."""
    rows = checkpoint(link(docs, id_col, text_col, size, percent))
    gone = rows.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    n = rows.agg(F.count("doc_id").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count(F.when(F.col("doc_id") != F.col("component_id"), 1)).alias("gone")).first()
    kept = docs.join(F.broadcast(gone) if n["gone"] <= BROADCAST_ROWS else gone, id_col, "left_anti")
    if n["rows"] > n["ids"]:
        kept = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))
    return kept
