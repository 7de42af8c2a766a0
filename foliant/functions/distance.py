"""Edit distances over characters and words, and error rates.

Short strings use the built-in levenshtein. Pages are long, so there the distance is bit-parallel (Myers 1999, Hyyro
2003) on Python integers inside an Arrow UDF, after equal ends are cut off; it takes characters or words. Where one side
is the other with more between, or the distance's bounds meet, these are it; else a band of diagonals is doubled
(Ukkonen 1985) until it holds the distance, so the cost is length times distance. Equal sides are settled by a built-in
and do not reach Python.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliant.functions import text as T


#: Symbols up to which whole columns cost less than the bookkeeping of a band.
SHORT = 1024


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Unit-cost insertions, deletions and substitutions."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    a, b = without_ends(a, b)
    if not a:
        return len(b)
    if isinstance(a, str) and a in b:
        return len(b) - len(a)
    if len(a) == len(b) and not isinstance(a, str) and (high := sum(map(operator.ne, a, b))) <= 2:
        return high  # one symbol alone would have been all that is left
    low, high = bounds(a, b)
    if low == high or low == len(b) - len(a) and is_within(a, b):
        return low
    band = max(low, 8)
    while SHORT < len(a) and 2 * band + 1 < len(a):
        found = banded(a, b, min(band, high))
        if found is not None:
            return found
        band *= 2
    where: dict = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    # vertical differences of a column: plus and minus one; their sum in the last column, under n deletions, is the distance
    mask = (1 << len(a)) - 1
    plus, minus, get = mask, 0, where.get
    for x in b:
        eq = get(x, 0)
        same = (((eq & plus) + plus) ^ plus) | eq | minus
        up = (minus | ~(same | plus)) << 1 | 1
        plus, minus = ((same & plus) << 1 | ~(same | up)) & mask, up & same & mask
    return len(b) + plus.bit_count() - minus.bit_count()


def without_ends(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """Less what both begin with, and then what both end with; a is not longer than b. Looked for by slices, each twice the last while they are equal."""
    start, step = 0, 16
    while step and start < len(a):
        if a[start : start + step] == b[start : start + step]:
            start, step = start + step, step * 2
        else:
            step //= 2
    start = min(start, len(a))
    a, b = a[start:], b[start:]
    end, step, more = 0, 16, len(b) - len(a)
    while step and end < len(a):
        low = max(len(a) - end - step, 0)
        if a[low : len(a) - end] == b[low + more : len(b) - end]:
            end, step = end + step, step * 2
        else:
            step //= 2
    end = min(end, len(a))
    return a[: len(a) - end], b[: len(b) - end]


def is_within(a: Sequence, b: Sequence) -> bool:
    """Whether b is a with more symbols between: then these are the distance."""
    rest = iter(b)
    return all(map(operator.contains, repeat(rest), a))


#: Characters from which a text is compared by numpy, and code points up to which characters are counted by it.
LONG, CODES = 256, 0x3000


def bounds(a: Sequence, b: Sequence) -> tuple[int, int]:
    """What the distance is at least (symbols that one side has more of), and at most (place by place)."""
    if isinstance(a, str) and isinstance(b, str) and len(a) > LONG:
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
        high = int(np.count_nonzero(x != y[: len(x)])) + len(b) - len(a)
        if max(x.max(), y.max()) < CODES:
            more, less = (np.bincount(t, minlength=CODES) for t in (x, y))
            return len(b) - int(np.minimum(more, less).sum()), high
    else:
        high = sum(map(operator.ne, a, b)) + len(b) - len(a)
    more, less = Counter(a), Counter(b)
    return len(b) - sum([min(n, less[x]) for x, n in more.items() if x in less]), high


def banded(a: Sequence, b: Sequence, most: int) -> int | None:
    """The distance if it is at most `most`, from the 2 * most + 1 diagonals around the main one; a is not longer than b."""
    m, n = len(a), len(b)
    if n - m > most:
        return None
    # bit k of a column stands for row (column + k - most); rows above the first are padding that never matches
    width = 2 * most + 1
    mask, top = (1 << width) - 1, 1 << width - 1
    where: dict = {}  # symbol: its rows as seen from a column, and that column
    for k, c in enumerate(a[:most]):
        bits, _ = where.get(c, (0, 0))
        where[c] = bits | 1 << k + most + 1, -1
    plus, minus, score = mask << most & mask, 0, most  # score: of the band's lowest row
    for j, y in enumerate(b):
        if j + most < m:
            c = a[j + most]
            bits, seen = where.get(c, (0, j))
            where[c] = bits >> j - seen | top, j
        bits, seen = where.get(y, (0, j))
        eq = bits >> j - seen
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & mask
        up = (minus | ~(d0 | plus)) & mask
        down = d0 & plus
        score += not d0 & top
        if score > 3 * most:
            return None
        plus = (down | ~((d0 >> 1) | up)) & mask
        minus = (d0 >> 1) & up
    # up from the band's lowest row to the last row, by vertical differences
    below = ((1 << 2 * most) - 1) & ~((1 << m - n + most) - 1)
    score += (minus & below).bit_count() - (plus & below).bit_count()
    return score if score <= most else None


@F.pandas_udf(LongType())
def _chars(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else edit_distance(a, b) for a, b in zip(left, right)], dtype="Int64")


@F.pandas_udf(LongType())
def _words(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else edit_distance(list(a), list(b)) for a, b in zip(left, right)], dtype="Int64")


DISTANCES = StructType([StructField("chars", LongType()), StructField("words", LongType())])


@F.arrow_udf(DISTANCES)
def _both(left: pa.Array, right: pa.Array) -> pa.Array:
    found = [None if a is None or b is None else {"chars": edit_distance(a, b), "words": edit_distance(a.split(), b.split())} for a, b in zip(left.to_pylist(), right.to_pylist())]
    return pa.array(found, pa.struct([("chars", pa.int64()), ("words", pa.int64())]))


def unless_equal(udf: Callable[[Column, Column], Column], left: Column, right: Column, of_equals: Column) -> Column:
    """udf(left, right), which gives null for null sides, where the sides differ; of_equals where they are the same."""
    differ = left != right
    return F.when(left == right, of_equals).otherwise(udf(F.when(differ, left), F.when(differ, right)))


def char_distance(left: Column, right: Column) -> Column:
    return unless_equal(_chars, left, right, F.lit(0).cast("long"))


def word_distance(left: Column, right: Column) -> Column:
    """Over arrays of words."""
    return unless_equal(_words, left, right, F.lit(0).cast("long"))


def distances(left: Column, right: Column) -> Column:
    """(chars, words): both distances of two texts, which go to Python once; words are split at white space there."""
    return unless_equal(_both, left, right, F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("words")))


def error_rate(distance: Column, length: Column) -> Column:
    """distance / length; of an empty truth 0 if nothing was written, else 1."""
    return F.when(length == 0, F.when(distance == 0, 0.0).otherwise(1.0)).otherwise(distance / length)


def one_edit_apart(a: Column, b: Column) -> Column:
    """At most one substitution, insertion or deletion; beyond the threshold the built-in gives -1."""
    return F.levenshtein(a, b, 1) >= 0


def word_count(text: Column) -> Column:
    return F.size(T.words(text)).cast("long")
