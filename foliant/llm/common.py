"""What the training-data operators share: table reading, cut lineage, text and hashing helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words of the white-space kind: anything but space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def fewer_rows_a_batch(spark: SparkSession) -> None:
    """Texts are long, and a batch is held off the heap and in the worker at once: 1,000 rows, unless the session has a setting of its own."""
    if spark.conf.get(ROWS_A_BATCH, "10000") == "10000":
        spark.conf.set(ROWS_A_BATCH, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    fewer_rows_a_batch(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder named by spark.checkpoint.dir; a folder of our own only in local mode, where it is unset."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-checkpoint-"))
    return df.checkpoint()


def require_integer_ids(docs: DataFrame, id_col: str) -> None:
    """Operators that pack ids into arrays take integer ids only, and say so before any work."""
    kind = dict(docs.select(id_col).dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; this operator needs integer ids, so number the documents first")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. All-ASCII texts take the fast built-in; others are translated letter by letter."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of separators; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    return df.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def buckets_for(n_bytes: int, per_bucket: int, least: int = 256) -> int:
    """How many buckets keep each one's share of n_bytes of input near per_bucket bytes."""
    return max(least, -(-n_bytes // per_bucket))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants): spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ascii_lower_bytes(raw: bytes) -> bytes:
    """bytes.lower() changes A-Z only, as the contracts want."""
    return raw.lower()


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """This worker process's cache of one operator; it outlives tasks, and goes when another operator begins."""
    if owner not in _CACHES:
        _CACHES.clear()
        pa.default_memory_pool().release_unused()
    return _CACHES.setdefault(owner, {})


def slices(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """A batch's values as Python objects, few at a time: a batch may hold thousands of long texts."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


class WordHashes:
    """64-bit hashes of words with a bounded cache; the cache is cleared when full, so memory stays bounded."""

    def __init__(self, limit: int = 200_000):
        import xxhash

        self.known: dict[bytes, int] = {}
        self.limit = limit
        self.hash = xxhash.xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            own = self.hash
            for w in words:
                if w not in known:
                    known[w] = own(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
