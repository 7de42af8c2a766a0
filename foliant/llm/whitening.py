"""Whitening of embeddings from an exact integer scatter.

Entries become integers by a fixed scale and shift. The shift is taken off again, and tasks add up the rest exactly: the
sums S and the cross-products X'X, as integers of any length, in blocks of rows whose float products are exact. Partial
sums meet by matrix row, a bounded number at a time. The driver gets one d x d matrix, forms n X'X - SS' in integers,
and only then turns it into floats, each rounded once, and decomposes it (eigh).

Rows with a null vector, or with null or non-finite entries, go; so do rows whose length is not the most common one (the
longer of equals) and rows with an entry that no long holds. Repeated rows count each; null ids stay. A component whose eigenvalue is
not above rounding (rows that lie in fewer dimensions, or all alike) has a null whitened value; with no spread at all
explained is null as well. A deviation that no long holds is null in the query; the operator gives it as a decimal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint

SCALE = 1024
COMPONENTS = 8
#: Partial sums that one task adds up.
FAN_IN = 64
#: Rows a task multiplies at a time, and bits of a limb: products of limbs, summed over the rows, are exact in a double.
BLOCK, LIMB = 4096, 20
#: Largest size of an entry as an integer.
MOST = 2**62


def to_integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * entry): the integer less its shift, which is a constant that no deviation, product or mean apart depends on."""
    return np.floor(values * scale).astype(np.int64)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of d doubles, of a list column without nulls inside."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def exact_products(y: np.ndarray) -> np.ndarray:
    """Y'Y in Python integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    limbs = []
    rest, k = y, 0
    while True:  # the last limb keeps the sign
        if int(np.abs(rest).max(initial=0)) < 2**LIMB:
            limbs.append(rest.astype(np.float64))
            break
        limbs.append((rest & (2**LIMB - 1)).astype(np.float64))
        rest, k = rest >> LIMB, k + 1
    total = np.zeros((y.shape[1],) * 2, object)
    for i, p in enumerate(limbs):
        for j, q in enumerate(limbs):
            total = total + ((p.T @ q).astype(np.int64).astype(object) << (LIMB * (i + j)))
    return total


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, v (doubles), less rows that are null or hold nulls or non-finite or outsized entries."""
    own = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= MOST / scale))
    return own.where((F.size("v") > 0) & ~bad)


def common_size(valid: DataFrame) -> int:
    sizes = valid.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return first[0]["d"] if first else 0


def scatter(valid: DataFrame, d: int, scale: int = SCALE) -> tuple[int, list[int], np.ndarray]:
    """n, sums and cross-products of the integers less the shift, all exact."""

    def words(values) -> str:
        return ",".join(map(str, values))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                y = to_integers(matrix(batch.column("v").slice(at, BLOCK), d), scale)
                small = int(np.abs(y).max()) * len(y) < MOST
                n, sums, products = n + len(y), sums + (y if small else y.astype(object)).sum(0), products + exact_products(y)
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "sums": [str(x) for x in sums], "products": [words(x) for x in products]})

    def add(group: pa.Table) -> pa.Table:
        numbers = lambda s: np.array([int(x) for x in s.split(",")], object)
        products = sum(map(numbers, group.column("products").to_pylist()))
        return pa.table({"part": group.column("part").slice(0, 1), "n": pa.array([sum(group.column("n").to_pylist())], pa.int64()), "sums": [str(sum(map(int, group.column("sums").to_pylist())))], "products": [words(products)]})

    schema = "part int, n long, sums string, products string"
    level, tasks = valid.select("v").mapInArrow(work, schema), max(1, valid.rdd.getNumPartitions())
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        level = level.withColumn("task", F.spark_partition_id() % tasks).groupBy("part", "task").applyInArrow(add, schema)
    got = sorted(level.collect(), key=lambda r: r["part"])  # d rows of d numbers
    return got[0]["n"], [int(r["sums"]) for r in got], np.array([[int(x) for x in r["products"].split(",")] for r in got], object)


def decompose(n: int, sums: list[int], products: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, list[float | None]]:
    """The k largest eigenvalues of the covariance, their unit vectors (columns; the largest entry is positive), and shares of the trace.

    Eigenvalues that rounding could have made are given as 0."""
    s = np.array(sums, object)
    spread = n * products - np.outer(s, s)
    covariance = np.array([[x / (n * n) for x in row] for row in spread.tolist()])  # of integers: rounded once
    trace = int(np.trace(spread)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    values = np.where(values > len(s) * np.finfo(float).eps * max(values[0], 0.0), values, 0.0)
    return values, vectors, [float(v) / trace if trace > 0 else None for v in values]


def whitened_rows(valid: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, deviation (decimal), w: the row's whitened values, null where the component has no spread."""
    s, d = np.array(sums, object), len(sums)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = vectors / np.where(values > 0, np.sqrt(values), 1.0) / n
        flat = values <= 0
        small = np.array(sums, np.int64) if max(map(abs, sums)) < MOST else None
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                y = to_integers(matrix(batch.column("v").slice(at, BLOCK), d), scale)
                most = n * int(np.abs(y).max()) + max(map(abs, sums))
                if small is not None and most * most * d < 2**63:
                    apart = n * y - small
                    deviation = (apart * apart).sum(1).tolist()
                else:
                    apart = n * y.astype(object) - s
                    deviation = (apart * apart).sum(1).tolist()
                w = apart.astype(np.float64) @ factor
                ids = batch.column("vec_id").slice(at, BLOCK)
                texts = pa.array([str(x) for x in deviation], pa.string())
                yield pa.RecordBatch.from_arrays([ids, texts, pa.array([[None if z else x for x, z in zip(row, flat)] for row in w.tolist()], pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    rows = valid.mapInArrow(work, f"vec_id {dict(valid.dtypes)['vec_id']}, deviation string, w array<double>")
    return rows.withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))


def identity_error(rows: DataFrame, values: np.ndarray) -> float | None:
    """Largest entry, by size, of the whitened values' covariance less the identity; Spark's covar_pop centres before it multiplies."""
    used = [k for k in range(len(values)) if values[k] > 0]
    if not used:
        return None
    w = F.col("w")
    pairs = [(i, j) for i in used for j in used if i <= j]
    got = rows.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(x - (i == j)) for x, (i, j) in zip(got, pairs))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each vector and component."""
    valid = valid_vectors(rows, id_col, vector_col, scale)
    d = common_size(valid)
    valid = valid.where(F.size("v") == d)
    columns = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not d:
        return valid.sparkSession.createDataFrame([], f"vec_id {dict(valid.dtypes)['vec_id']}, {columns}")
    n, sums, products = scatter(valid, d, scale)
    values, vectors, explained = decompose(n, sums, products, k)
    done = checkpoint(whitened_rows(valid, n, sums, values, vectors, scale))
    error = identity_error(done, values)
    shares = F.array(*[F.lit(x).cast("double") for x in explained])
    each = done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def summary(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """whiten(), with deviation as a long."""
    return whiten(rows, id_col, vector_col).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
