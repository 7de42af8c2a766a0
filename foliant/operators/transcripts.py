"""Pages' event logs: written out as restricted Markdown, and held against what was drawn."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.errors import Refusal, some
from foliant.operators.bags import difference

#: A log: page, seq, kind, text, meta (map of strings: label, value, column_key, header).
LOG = ["page", "seq", "kind", "text", "meta"]
#: Structure that leaves no mark on the text.
SILENT = ("panel_open", "panel_close", "split_open", "split_close", "column_open", "column_close")
KINDS = ("title", "line", "pair", "table_open", "row_open", "cell", "cell_sub_line", "row_close", "table_close", *SILENT)


@dataclass(frozen=True)
class Convention:
    """How a log becomes text."""

    pair_separator: str = ": "
    pair_strip_trailing_colon: bool = True
    empty_cell_token: str = ""
    cell_sub_line_join: str = " "
    cell_newline_join: str = " "
    headerless_table: str = "empty_header_row"
    split_order: str = "column_major"
    block_separator: str = "\n\n"

    def __post_init__(self) -> None:
        if self.split_order != "column_major" or self.headerless_table != "empty_header_row":
            raise Refusal(f"split_order {self.split_order!r}, headerless_table {self.headerless_table!r}", "serialisation", "column_major and empty_header_row, which alone are written", "change the convention")


STANDARD = Convention()
_CELL = "struct<key:string,text:string>"
_STATE = f"struct<blocks:array<string>,table:array<string>,header:boolean,width:int,row:array<{_CELL}>,heads:boolean,fault:string>"


def _pipes(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def page_text(log: Column, convention: Convention = STANDARD) -> Column:
    """(text, fault) of an array of (seq, kind, text, meta) in any order: one fold over the log in its order.

    Carried along: the blocks so far, the open table's rows and whether it has drawn a header, and the open row's cells.
    A table without a header gets a blank one, so that its first row is not taken for it. Text is never changed, but for
    line ends within cells. fault names the first event that has no meaning where it stands; text is null then."""
    zero = F.struct(F.array().alias("blocks"), F.lit(None).alias("table"), F.lit(False).alias("header"), F.lit(0).alias("width"), F.lit(None).alias("row"), F.lit(False).alias("heads"), F.lit(None).alias("fault")).cast(_STATE)

    def step(s: Column, e: Column) -> Column:
        kind, text = e["kind"], F.coalesce(e["text"], F.lit(""))
        put = lambda **new: F.struct(*[new.get(c, s[c]).alias(c) for c in ("blocks", "table", "header", "width", "row", "heads", "fault")]).cast(_STATE)
        fault = lambda why: put(fault=F.concat(F.lit(why + " at "), e["seq"].cast("string")))
        block = lambda x: put(blocks=F.concat(s["blocks"], F.array(x)))
        label = F.coalesce(e["meta"]["label"], F.lit(""))
        if convention.pair_strip_trailing_colon:
            label = F.regexp_replace(label, r"[\s:]+\z", "")
        one_line = F.array_join(F.split(text, "\n"), convention.cell_newline_join)
        cell = F.struct(e["meta"]["column_key"].alias("key"), F.when(text == "", convention.empty_cell_token).otherwise(one_line).alias("text"))
        here = lambda c: c["key"].eqNullSafe(e["meta"]["column_key"])
        longer = F.transform(s["row"], lambda c: F.when(here(c), F.struct(c["key"].alias("key"), F.concat(c["text"], F.lit(convention.cell_sub_line_join), one_line).alias("text"))).otherwise(c))
        written = _pipes(F.transform(s["row"], lambda c: c["text"]))
        rule = lambda n: _pipes(F.array_repeat(F.lit("---"), n))
        heads = s["heads"] & (F.size(s["table"]) == 0)
        more = F.when(heads, F.concat(s["table"], F.array(written, rule(F.size(s["row"]))))).otherwise(F.concat(s["table"], F.array(written)))
        blank = F.array(_pipes(F.array_repeat(F.lit(""), s["width"])), rule(s["width"]))
        table = F.array_join(F.when(s["header"], s["table"]).otherwise(F.concat(blank, s["table"])), "\n")
        outside, inside, in_row = s["table"].isNull(), s["table"].isNotNull() & s["row"].isNull(), s["row"].isNotNull()
        return (
            F.when(s["fault"].isNotNull() | kind.isin(*SILENT), s)
            .when(kind == "cell", F.when(in_row, put(row=F.concat(s["row"], F.array(cell)), heads=s["heads"] | F.coalesce(e["meta"]["header"] == "true", F.lit(False)))).otherwise(fault("a cell outside of a row")))
            .when(kind == "row_open", F.when(inside, put(row=F.array().cast(f"array<{_CELL}>"), heads=F.lit(False))).otherwise(fault("a row outside of a table")))
            .when(kind == "row_close", F.when(in_row, put(table=more, header=s["header"] | heads, width=F.greatest(s["width"], F.size(s["row"])), row=F.lit(None))).otherwise(fault("a row closed that is not open")))
            .when(kind == "cell_sub_line", F.when(F.coalesce(F.exists(s["row"], here), F.lit(False)), put(row=longer)).otherwise(fault("a sub-line without its cell")))
            .when(kind == "title", F.when(outside, block(F.concat(F.lit("# "), text))).otherwise(fault("a title inside a table")))
            .when(kind == "line", F.when(outside, block(text)).otherwise(fault("a line inside a table")))
            .when(kind == "pair", F.when(outside, block(F.concat(label, F.lit(convention.pair_separator), F.coalesce(e["meta"]["value"], F.lit(""))))).otherwise(fault("a pair inside a table")))
            .when(kind == "table_open", F.when(outside, put(table=F.array().cast("array<string>"), header=F.lit(False), width=F.lit(0))).otherwise(fault("a table inside a table")))
            .when(kind == "table_close", F.when(inside, put(blocks=F.concat(s["blocks"], F.array(table)), table=F.lit(None))).otherwise(fault("a table closed that is not open")))
            .otherwise(put(fault=F.concat(F.lit("the unknown kind "), F.coalesce(kind, F.lit("null")), F.lit(" at "), e["seq"].cast("string"))))
        )

    def finish(s: Column) -> Column:
        fault = F.coalesce(s["fault"], F.when(s["table"].isNotNull(), "a table that is never closed"))
        return F.struct(F.when(fault.isNull(), F.array_join(s["blocks"], convention.block_separator)).alias("text"), fault.alias("fault"))

    return F.aggregate(F.array_sort(log), zero, step, finish)


def serialised(events: DataFrame, convention: Convention = STANDARD) -> DataFrame:
    """page, text, fault: each page's log written out, by one shuffle of the events; a page's log is bounded by the page."""
    # maps are not ordered, so a log is sorted by seq and place, and meta goes along as entries
    log = F.collect_list(F.struct("seq", "kind", "text", F.array_sort(F.map_entries(F.coalesce("meta", F.create_map().cast("map<string,string>")))).alias("entries")))
    logs = events.groupBy("page").agg(log.alias("log"))
    ordered = F.transform("log", lambda e: F.struct(e["seq"].alias("seq"), e["kind"].alias("kind"), e["text"].alias("text"), F.struct(*[_meta(e["entries"], k).alias(k) for k in ("label", "value", "column_key", "header")]).alias("meta")))
    return logs.select("page", page_text(ordered, convention).alias("t")).select("page", "t.text", "t.fault")


def _meta(entries: Column, key: str) -> Column:
    return F.get(F.filter(entries, lambda x: x["key"] == key), F.lit(0))["value"]


def serialise(events: DataFrame, convention: Convention = STANDARD) -> DataFrame:
    """page, text; logs with a fault are refused."""
    pages = serialised(events, convention)
    bad = pages.where("fault is not null").select("page", "fault").limit(6).collect()
    if bad:
        raise Refusal(f"logs that can not be written: {some([f'{r["page"]} ({r["fault"]})' for r in bad], len(bad))}", "serialisation", f"kinds {', '.join(KINDS)}, tables and rows opened and closed in turn", "mend what made the log, or give the kind a rule")
    return pages.select("page", "text")


# -- coverage ----------------------------------------------------------------------------------------------------------


def authorised(events: DataFrame) -> DataFrame:
    """page, seq, text: each piece of text that an event lets a page draw; a pair lets two, its label and its value."""
    own = F.when(F.col("kind") == "pair", F.array(F.col("meta")["label"], F.col("meta")["value"])).otherwise(F.array("text"))
    return events.select("page", "seq", F.explode(own).alias("text")).where("text <> ''")


def untagged(drawn: DataFrame, events: DataFrame) -> DataFrame:
    """What was drawn (page, seq, text, decoration) with no event of its page behind it; decoration needs none."""
    return drawn.where(~F.coalesce("decoration", F.lit(False))).join(events.select("page", "seq"), ["page", "seq"], "left_anti")


def uncovered(drawn: DataFrame, events: DataFrame) -> DataFrame:
    """page, text, surplus: texts drawn more often (or, below zero, less often) than a page's events say, decoration left out."""
    ink = drawn.where(~F.coalesce("decoration", F.lit(False))).select("page", "text")
    return difference(ink, authorised(events).select("page", "text"))


def refuse_uncovered(drawn: DataFrame, events: DataFrame) -> None:
    bad = uncovered(drawn, events)
    first = bad.limit(6).collect()
    if first:
        names = [f"{r['page']}: {r['text']!r} {r['surplus']:+d}" for r in first]
        raise Refusal(f"pages show what their events do not say, or the other way: {some(names, bad.count())}", "coverage", "each text drawn has one event, each event's text is drawn", "emit an event before drawing, or mark it as decoration")
