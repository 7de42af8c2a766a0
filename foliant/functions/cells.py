"""Tables of many pages at once: what tables.py reads off one text, by Arrow's kernels and numpy, for a batch of texts that Spark hands over.

A batch's cells stand in flat columns, so that nothing is done cell by cell. Rows, amounts and blanks are those of tables.py."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from foliant.functions.tables import LINE_END, NOT_PLAIN
from foliant.functions.text import WHITE_CHARS

#: As html_rows has them: up to the first closing tag, but without a look for it at each character.
TABLE_ROW, TABLE_CELL = (re.compile(rf"(?i)<{tag}[^>]*>([^<]*+(?:<(?!/{tag}>)[^<]*+)*+)</{tag}>") for tag in ("tr", "t[dh]"))
#: White space and digits as Arrow's patterns name them.
BLANKS = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
AMOUNT_CELL = r"^\$?\p{Nd}[\p{Nd},]*\.\p{Nd}{2}(?:[\t-\r\x{85}\p{Z}]*Cr)?\n?$"


class Cells(NamedTuple):
    """Of each cell, in order: its page, its row (numbered over all pages), and what is in it; start: the first cell of each row."""

    page: np.ndarray
    row: np.ndarray
    value: pa.Array
    start: np.ndarray

    @property
    def col(self) -> np.ndarray:
        return np.arange(len(self.row)) - self.start[self.row]

    @property
    def width(self) -> np.ndarray:
        return np.diff(self.start, append=len(self.row))


def _true(mask: pa.Array) -> np.ndarray:
    return mask.to_numpy(zero_copy_only=False)


def _trim(values: pa.Array) -> pa.Array:
    return pc.utf8_trim(values, WHITE_CHARS)


def _split(texts: pa.Array, at: str, pattern: bool = False) -> tuple[np.ndarray, pa.Array]:
    """The parts of all texts, and which text each is of."""
    found = (pc.split_pattern_regex if pattern else pc.split_pattern)(texts, at)
    return pc.list_parent_indices(found).to_numpy(), found.flatten()


def _pipe_cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    page = np.flatnonzero(_true(pc.match_substring(texts, "|")))
    texts = texts.take(pa.array(page))
    other = bool(pc.any(pc.match_substring_regex(texts, NOT_PLAIN)).as_py())
    of, lines = _split(texts, LINE_END if other else "\n", other)
    lines = _trim(lines)
    rows = pc.starts_with(lines, "|")
    lines, page = lines.filter(rows), page[of[_true(rows)]]
    row, value = _split(pc.utf8_trim(lines, "|"), "|")
    value = _trim(value)
    # rows of nothing but blanks and rules are looked for among lines that have no other character
    doubtful = ~_true(pc.match_substring_regex(lines, rf"[^-:|{BLANKS}]"))
    at = np.flatnonzero(doubtful[row])
    some = value.take(pa.array(at))
    filled = ~_true(pc.or_(pc.equal(some, ""), pc.match_substring_regex(some, r"^[: ]*-[-: ]*$")))
    doubtful[row[at[filled]]] = False
    keep = ~doubtful[row]
    return page[row][keep], row[keep], value.filter(pa.array(keep))


def _html_cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    page, row, value, n = [], [], [], 0
    found = np.flatnonzero(_true(pc.match_substring(texts, "<")))
    for k, text in zip(found.tolist(), texts.take(pa.array(found)).to_pylist()):
        for r in TABLE_ROW.findall(text):
            cells = TABLE_CELL.findall(r)
            value += cells
            page += [k] * len(cells)
            row += [n] * len(cells)
            n += 1
    values = pa.array(value, texts.type)
    if pc.any(pc.match_substring(values, "<")).as_py():
        values = pc.replace_substring_regex(values, "<[^>]+>", "")
    return np.array(page, np.int64), np.array(row, np.int64), _trim(values)


def read(texts: pa.Array) -> Cells:
    """A page's HTML rows first, then its pipe rows, as table_rows."""
    texts = pc.fill_null(texts, "")
    page, row, value = _pipe_cells(texts)
    own, first, cells = _html_cells(texts)
    if len(own):
        page, row, value = np.concatenate([own, page]), np.concatenate([first, row + first[-1] + 1]), pa.concat_arrays([cells, value])
        order = np.argsort(page, kind="stable")
        page, row, value = page[order], row[order], value.take(pa.array(order))
    new = np.diff(row, prepend=-1) != 0
    return Cells(page, np.cumsum(new) - 1, value, np.flatnonzero(new))


def _numbered(keys: pa.Array | np.ndarray) -> np.ndarray:
    """Each distinct key's number."""
    return pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)


class Keys(NamedTuple):
    """What bags hold, as numbers below `base`, of pages' entries."""

    page: np.ndarray
    number: np.ndarray
    base: int
    truth: np.ndarray

    def and_(self, more: np.ndarray) -> Keys:
        """The pairs of what there is with another number; numbered anew where 62 bits would not hold them."""
        number, base, size = self.number, self.base, int(more.max(initial=0)) + 1
        if (int(self.page.max(initial=0)) + 1) * base * size >= 1 << 62:
            number = _numbered(number)
            base = len(number) + 1
        return self._replace(number=number * size + more, base=base * size)

    def where(self, mask: np.ndarray) -> Keys:
        return Keys(self.page[mask], self.number[mask], self.base, self.truth[mask])

    def shared(self, n: int) -> pa.Array:
        """Of n pages, the size of the bag intersection of what is the truth's with what is not."""
        both = np.sort((self.page * self.base + self.number) * 2 + self.truth)
        start = np.flatnonzero(np.diff(both >> 1, prepend=-1) != 0)
        true = np.diff(np.concatenate([[0], np.cumsum(both & 1)])[np.append(start, len(both))])
        times = np.diff(start, append=len(both))
        found = np.bincount((both[start] >> 1) // self.base, weights=np.minimum(true, times - true), minlength=n)
        return pa.array(found.astype(np.int64))


def bag_keys(own: tuple[np.ndarray, pa.Array], other: tuple[np.ndarray, pa.Array]) -> Keys:
    """The values of the truth's side and of the other, each with their pages."""
    number = _numbered(pa.concat_arrays([own[1], other[1].cast(own[1].type)]))
    return Keys(np.concatenate([own[0], other[0]]).astype(np.int64), number, len(number) + 1, np.arange(len(number)) < len(own[0]))


def _modal_width(n: int, page: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Of the rows of n pages the most common width, the first met of equals; 0 without rows."""
    base = width.max(initial=0) + 1
    keys, first, times = np.unique(page * base + width, return_index=True, return_counts=True)
    order = np.lexsort((first, -times, keys // base))
    pages, at = np.unique((keys // base)[order], return_index=True)
    found = np.zeros(n, np.int32)
    found[pages] = (keys % base)[order][at]
    return found


def lists(n: int, page: np.ndarray, values: pa.Array) -> pa.Array:
    """The values of each of n pages; they stand by page."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(page, np.arange(n + 1)), pa.int32()), values)


# -- amounts by their columns ------------------------------------------------------------------------------------------

PLACED = StructType([StructField("amount", StringType()), StructField("col", LongType()), StructField("row_key", StringType()), StructField("in_body", BooleanType())])


def _placed(c: Cells) -> tuple[np.ndarray, list[pa.Array]]:
    """Of each cell that is an amount: its page; the amount, its column, its row's first cell, and whether its row is not the page's first."""
    at = np.flatnonzero(_true(pc.match_substring(c.value, ".")))
    at = at[_true(pc.match_substring_regex(c.value.take(pa.array(at)), AMOUNT_CELL))]
    page, start = c.page[at], c.start[c.row[at]]
    header = np.searchsorted(c.page, page)  # each page's first cell
    return page, [c.value.take(pa.array(at)), pa.array(c.col[at]), c.value.take(pa.array(start)), pa.array(start != header)]


@F.arrow_udf(StructType([StructField("amounts", ArrayType(PLACED)), StructField("width", IntegerType())]))
def _placed_amounts(text: pa.Array) -> pa.Array:
    return placed_among(len(text), read(text))


def placed_among(n: int, c: Cells) -> pa.Array:
    """(amounts, width) of n pages' cells."""
    page, fields = _placed(c)
    amounts = lists(n, page, pa.StructArray.from_arrays(fields, PLACED.names))
    return pa.StructArray.from_arrays([amounts, pa.array(_modal_width(n, c.page[c.start], c.width))], ["amounts", "width"])


def placed_amounts(text: Column) -> Column:
    """(amounts, width) of a page's tables: the amounts as placements() has them, and the most common width of its rows."""
    return _placed_amounts(text)


FOUND = StructType([StructField(k, LongType()) for k in ("read", "placed", "attributable")] + [StructField("width", IntegerType())])


@F.arrow_udf(FOUND)
def _found_amounts(truth: pa.Array, prediction: pa.Array) -> pa.Array:
    return found_among(truth, read(prediction))


def found_among(truth: pa.Array, c: Cells) -> pa.Array:
    """FOUND of as many pages' cells as there are lists of the truth's amounts."""
    n = len(truth)
    wanted, own = truth.flatten(), pc.list_parent_indices(truth).to_numpy()
    page, fields = _placed(c)
    _, col, key, body = (pa.concat_arrays([pc.struct_field(wanted, name), x.cast(wanted.type.field(name).type)]) for name, x in zip(PLACED.names, fields))
    amount = bag_keys((own, pc.struct_field(wanted, "amount")), (page, fields[0]))
    placed = amount.and_(col.to_numpy())
    attributable = placed.and_(_numbered(key)).where(_true(body))
    counts = [amount.shared(n), placed.shared(n), attributable.shared(n)]
    return pa.StructArray.from_arrays([*counts, pa.array(_modal_width(n, c.page[c.start], c.width))], FOUND.names)


def found_amounts(truth: Column, prediction: Column) -> Column:
    """(read, placed, attributable, width) of a page: how many of the truth's amounts (placed_amounts) it has at all, in their columns,
    and there in rows of the same first cell below the first row; and its rows' most common width."""
    return _found_amounts(truth, prediction)


# -- cells and rows ----------------------------------------------------------------------------------------------------


def _squeezed(values: pa.Array) -> pa.Array:
    """Trimmed values with one space for each run of blanks."""
    odd = pc.match_substring_regex(values, "[^ -~]|  ")
    if not pc.any(odd).as_py():
        return values
    return pc.replace_with_mask(values, odd, pc.replace_substring_regex(values.filter(odd), f"[{BLANKS}]+", " "))


def _cell_values(c: Cells) -> tuple[np.ndarray, pa.Array]:
    """Which cells are not blank, and these as cell_values() has them."""
    filled = _true(pc.not_equal(c.value, ""))
    return filled, _squeezed(c.value.filter(pa.array(filled)))


STRUCTURE = StructType([StructField("signatures", ArrayType(StringType())), StructField("fragments", LongType()), StructField("width_breaks", LongType())])


@F.arrow_udf(ArrayType(StringType()))
def _values(text: pa.Array) -> pa.Array:
    return values_among(len(text), read(text))


def values_among(n: int, c: Cells) -> pa.Array:
    """Of n pages' cells those that are not blank."""
    filled, values = _cell_values(c)
    return lists(n, c.page[filled], values)


@F.arrow_udf(STRUCTURE)
def _structure(text: pa.Array) -> pa.Array:
    return structure_of(len(text), read(text))


def structure_of(n: int, c: Cells) -> pa.Array:
    """STRUCTURE of n pages' cells."""
    filled, values = _cell_values(c)
    page, width = c.page[c.start], c.width
    times = np.bincount(c.row[filled], minlength=len(page))
    ends = np.concatenate([[0], np.cumsum(times)])
    signatures = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), "\u0001")
    count = lambda rows: pa.array(np.bincount(page[rows], minlength=n).astype(np.int64))
    return pa.StructArray.from_arrays([lists(n, page, signatures), count((times == 1) & filled[c.start]), count(width != _modal_width(n, page, width)[page])], STRUCTURE.names)


@F.arrow_udf(LongType())
def _recalled(truth: pa.Array, prediction: pa.Array) -> pa.Array:
    return recalled_among(truth, read(prediction))


def recalled_among(truth: pa.Array, c: Cells) -> pa.Array:
    """Of each list of the truth's cells how many are among a page's."""
    filled, values = _cell_values(c)
    return bag_keys((pc.list_parent_indices(truth).to_numpy(), truth.flatten()), (c.page[filled], values)).shared(len(truth))


def cell_values(text: Column) -> Column:
    """All cells of a page's tables that are not blank, inner white space squeezed."""
    return _values(text)


def structure(text: Column) -> Column:
    """(signatures, fragments, width_breaks): of a page's rows, what identifies each, and how many are fragments or of another width than most."""
    return _structure(text)


def recalled(truth: Column, prediction: Column) -> Column:
    """How many of the truth's cells (cell_values) a page has."""
    return _recalled(truth, prediction)
