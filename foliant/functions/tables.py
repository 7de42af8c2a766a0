"""Tables in text: rows of either dialect as array<array<string>>, and what can be read off them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import WHITE, let, squeeze, trim

#: Where a line ends, as Python's splitlines sees it.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: A cell that is an amount: optional dollar sign, grouped digits, two decimals, optional credit mark.
AMOUNT_CELL = r"(?U)^\$?\d[\d,]*\.\d{2}(?:\s*Cr)?\n?\z"


#: What no plain text has: anything but printable ASCII and newlines. Of plain texts, blanks are all that there is to trim.
NOT_PLAIN = r"[^\n -~]"
#: In a page's cells, each followed by U+0001: white space that squeezing would change.
NOT_SQUEEZED = r"[^\x01 -~]|  |\x01 | \x01|\A "
NO_ROWS = "array<array<string>>"


def html_rows(text: Column) -> Column:
    return F.when(text.contains("<"), _html_rows(text)).when(text.isNotNull(), F.array().cast(NO_ROWS))


def _html_rows(text: Column) -> Column:
    rows = F.regexp_extract_all(text, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: trim(F.when(c.contains("<"), F.regexp_replace(c, "<[^>]+>", "")).otherwise(c))))
    return F.filter(cells, lambda r: F.size(r) > 0)


def pipe_rows(text: Column) -> Column:
    """All outer pipes go. Rows of nothing but rules are no rows, nor are rows of nothing at all."""
    return F.when(~text.contains("|"), F.array().cast(NO_ROWS)).when(text.rlike(NOT_PLAIN), _pipe_rows(text, LINE_END, trim)).otherwise(_pipe_rows(text, "\n", F.trim))


def _pipe_rows(text: Column, line_end: str, strip: Callable[[Column], Column]) -> Column:
    lines = F.filter(F.transform(F.split(text, line_end), lambda x: strip(x)), lambda x: x.startswith("|"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.trim(x, F.lit("|")), r"\|"), lambda c: strip(c)))
    return F.filter(cells, lambda r: F.exists(r, lambda c: (c != "") & ~(c.contains("-") & c.rlike(r"\A[-: ]+\z"))))


def table_rows(text: Column) -> Column:
    """HTML rows first, whatever the order in the document, then pipe rows."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.concat(html_rows(t), pipe_rows(t)))


def modal_width(rows: Column) -> Column:
    """The most common row width, the first met of equals; 0 without rows."""

    def of(widths: Column) -> Column:
        counted = F.transform(F.array_distinct(widths), lambda w: F.struct(F.size(F.filter(widths, lambda x: x == w)).alias("n"), (-F.array_position(widths, w)).alias("first"), w.alias("width")))
        return F.when(F.size(F.array_distinct(widths)) == 1, F.get(widths, F.lit(0))).otherwise(F.coalesce(F.array_max(counted)["width"], F.lit(0)))

    return let(F.transform(rows, F.size), of)


def _is_amount(cell: Column) -> Column:
    return cell.contains(".") & cell.rlike(AMOUNT_CELL)


def placements(rows: Column) -> Column:
    """(amount, col, row_key, row_idx) of every cell that is an amount. The key is the row's first cell."""

    def of(r: Column, i: Column) -> Column:
        found = F.array_compact(F.transform(r, lambda c, j: F.when(_is_amount(c), F.struct(c.alias("amount"), j.alias("col")))))
        return F.transform(found, lambda x: F.struct(x["amount"].alias("amount"), x["col"].alias("col"), trim(r[0]).alias("row_key"), i.alias("row_idx")))

    return F.flatten(F.transform(rows, of))


def placed_amounts(rows: Column) -> Column:
    """(amount, placed, attributed, row_idx) of every placement: the amount alone, with its column, and with its row's key too."""
    end = F.lit("\u0001")

    def of(x: Column) -> Column:
        return let(F.concat(x["amount"], end, x["col"].cast("string")), lambda placed: F.struct(x["amount"].alias("amount"), placed.alias("placed"), F.concat(placed, end, x["row_key"]).alias("attributed"), x["row_idx"].alias("row_idx")))

    return F.transform(placements(rows), of)


def is_fragment(row: Column) -> Column:
    """Text in the first cell and nowhere else: the tail of a wrapped cell."""
    filled = lambda c: c.rlike("[!-~]") | (trim(c) != "")
    return filled(row[0]) & ~F.exists(F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))), filled)


def fragments(rows: Column) -> Column:
    return F.size(F.filter(rows, is_fragment)).cast("long")


def width_breaks(rows: Column) -> Column:
    return let(modal_width(rows), lambda width: F.size(F.filter(rows, lambda r: F.size(r) != width)).cast("long"))


def squeezed(rows: Column) -> Column:
    """Whether squeezing leaves all cells as they are; told in one look at all of them."""
    return ~F.concat(F.array_join(F.flatten(rows), "\u0001"), F.lit("\u0001")).rlike(NOT_SQUEEZED)


def cell_values(rows: Column) -> Column:
    """All non-blank cells, inner white space squeezed."""
    cells = F.flatten(rows)
    return F.array_remove(F.when(squeezed(rows), cells).otherwise(F.transform(cells, squeeze)), "")


def row_signatures(rows: Column) -> Column:
    """The signature of each row."""
    return F.when(squeezed(rows), F.transform(rows, lambda r: F.array_join(F.array_remove(r, ""), "\u0001"))).otherwise(F.transform(rows, row_signature))


def row_signature(row: Column) -> Column:
    """What identifies a row: its non-blank cells, joined by U+0001 so that cell borders stay apart."""
    return F.array_join(F.array_remove(F.transform(row, squeeze), ""), "\u0001")


def split_row(line: Column) -> Column:
    """The viewer's split: one outer pipe on each side goes, so blank outer cells stay."""
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(trim(line), r"\A\|", ""), r"\|\z", ""), r"\|"), trim)
