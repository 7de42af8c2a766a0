"""Text normalisation as Column expressions. Steps do not commute; their order is part of the meaning."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.policy import Policy

# fixed values: the characters that count as dashes and quotes, and the table elements
DASHES = "‐‑‒–—―−"
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟″"
TABLE_ELEMENTS = "table|thead|tbody|tfoot|caption|colgroup|col|tr|td|th"

#: White space as Python's str methods see it: Java's Unicode white space, and four separators.
WHITE = r"[\s\x1c-\x1f\x85]"
ASCII_WHITE = r"[\s\x1c-\x1f]"
#: The same as WHITE, one by one.
WHITE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TABLE_TAG = rf"(?iU)</?(?:{TABLE_ELEMENTS})(?:{WHITE}[^<>]*)?/?>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def where(has: str, text: Column, step: Callable[[Column], Column]) -> Column:
    """step(text) for texts with one of the characters, without which it changes nothing; others are left as they are."""
    return let(text, lambda t: F.when(t.rlike(f"[{has}]"), step(t)).otherwise(t))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def _python_step(form: str, unescape: bool) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def step(texts: pd.Series) -> pd.Series:
        found = texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")
        return found.map(html.unescape, na_action="ignore") if unescape else found

    def apart(text: Column) -> Column:
        """ASCII texts are in every form; without an ampersand they hold no entity, and stay in the JVM."""
        plain = is_ascii(text) & ~text.contains("&") if unescape else is_ascii(text)
        return F.when(plain, text).otherwise(step(F.when(~plain, text)))

    return apart


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


def casefold(text: Column) -> Column:
    """ASCII texts by the built-in."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(_casefold(F.when(~is_ascii(text), text)))


def trim(text: Column) -> Column:
    """Without white space, as Python sees it, at the ends."""
    return F.trim(text, F.lit(WHITE_CHARS))


def by_alphabet(text: Column, ascii_step: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """Patterns over Unicode classes cost several times those over ASCII ones, which do for ASCII texts."""
    return let(text, lambda t: F.when(is_ascii(t), ascii_step(t)).otherwise(step(t)))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(by_alphabet(text, lambda t: F.regexp_replace(t, f"{ASCII_WHITE}+", " "), lambda t: F.regexp_replace(t, rf"(?U){WHITE}+", " ")))


def words(text: Column) -> Column:
    """White-space separated words, none empty."""
    return F.array_remove(by_alphabet(text, lambda t: F.split(t, f"{ASCII_WHITE}+"), lambda t: F.split(t, rf"(?U){WHITE}+")), "")


def fold_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def fold_quotes(text: Column) -> Column:
    return F.translate(text, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


def strip_emphasis(text: Column) -> Column:
    """Paired marks only; a lone mark is content."""
    strong = F.regexp_replace(text, rf"(?sU)(\*\*|__)(?!{WHITE})(.+?)(?<!{WHITE})\1", "$2")
    return F.regexp_replace(strong, rf"(?sU)(?<![\w*_])([*_])(?!{WHITE})(.+?)(?<!{WHITE})\1(?![\w*_])", "$2")


def strip_headings(text: Column) -> Column:
    return F.regexp_replace(text, r"(?md)^ {0,3}#{1,6}(?:[ \t]+|$)", "")


def strip_pipe_tables(text: Column) -> Column:
    """Rule rows go; in other table rows pipes become spaces. Prose with a pipe inside is left alone."""
    rule = lambda x: x.contains("-") & trim(x).rlike(r"\A\|[|:\- \t]*\z")
    lines = F.filter(F.split(text, "\n"), lambda x: ~rule(x))
    return F.array_join(F.transform(lines, lambda x: F.when(trim(x).startswith("|"), F.replace(x, F.lit("|"), F.lit(" "))).otherwise(x)), "\n")


def strip_html_tables(text: Column) -> Column:
    return F.regexp_replace(text, TABLE_TAG, " ")


def pad_html_tables(text: Column) -> Column:
    """Each table tag becomes a word of its own."""
    return F.when(text.contains("<"), F.regexp_replace(text, f"({TABLE_TAG})", " $1 ")).otherwise(text)


def strip_blockquotes(text: Column) -> Column:
    return F.regexp_replace(text, "(?md)^ {0,3}> ?", "")


def fold_trailing_colons(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U):(?={WHITE}|\z)", "")


def normalise(text: Column, policy: Policy) -> Column:
    """The policy's steps, in their fixed order; a step that is off never enters the plan."""
    text = _python_step(policy.unicode_form, policy.unescape_html_entities)(text)
    for on, step in (
        (policy.fold_dashes, lambda t: by_alphabet(t, lambda x: x, fold_dashes)),
        (policy.fold_quotes, lambda t: by_alphabet(t, lambda x: x, fold_quotes)),
        (policy.strip_emphasis, lambda t: where("*_", t, strip_emphasis)),
        (policy.strip_heading_marks, lambda t: where("#", t, strip_headings)),
        (policy.strip_table_marks, lambda t: where("|", t, strip_pipe_tables)),
        (policy.strip_html_table_marks, lambda t: where("<", t, strip_html_tables)),
        (policy.strip_blockquote_marks, lambda t: where(">", t, strip_blockquotes)),
        (policy.fold_trailing_colons, lambda t: where(":", t, fold_trailing_colons)),
        (policy.collapse_whitespace, squeeze),
        (policy.fold_case, casefold),
    ):
        text = step(text) if on else text
    return text


# -- the same in a task, for plain texts -----------------------------------------------------------------------------

#: The patterns above as the standard library has them; of ASCII characters, words and white space are the same in both.
_STRONG = re.compile(r"(\*\*|__)(?!\s)(.+?)(?<!\s)\1", re.DOTALL)
_EMPHASIS = re.compile(r"(?<![\w*_])([*_])(?!\s)(.+?)(?<!\s)\1(?![\w*_])", re.DOTALL)
_HEADING, _QUOTED = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+|$)", re.MULTILINE), re.compile(r"^ {0,3}> ?", re.MULTILINE)
_TAG = re.compile(rf"</?(?:{TABLE_ELEMENTS})(?:\s[^<>]*)?/?>", re.IGNORECASE)
_RULE, _COLON = re.compile(r"\|[|:\- \t]*"), re.compile(r":(?=\s|\Z)")


def _without_pipes(text: str) -> str:
    rows = ((x, x.strip()) for x in text.split("\n"))
    return "\n".join([x.replace("|", " ") if bare.startswith("|") else x for x, bare in rows if not ("-" in x and _RULE.fullmatch(bare))])


def is_plain(text: str, policy: Policy) -> bool:
    """Whether plainly_normalised() takes the text: of ASCII characters alone, without what may be an entity."""
    return text.isascii() and not (policy.unescape_html_entities and "&" in text)


def unless_plain(text: Column, policy: Policy) -> Column:
    """normalise() of texts that are not plain; null for plain ones."""
    plain = is_ascii(text) & ~text.contains("&") if policy.unescape_html_entities else is_ascii(text)
    return normalise(F.when(~plain, text), policy)


@lru_cache(4096)
def plainly_normalised(text: str, policy: Policy) -> str:
    """As normalise(), of one plain text, which has no dashes, quotes or forms to fold."""
    if policy.strip_emphasis and ("*" in text or "_" in text):
        text = _EMPHASIS.sub(r"\2", _STRONG.sub(r"\2", text))
    if policy.strip_heading_marks and "#" in text:
        text = _HEADING.sub("", text)
    if policy.strip_table_marks and "|" in text:
        text = _without_pipes(text)
    if policy.strip_html_table_marks and "<" in text:
        text = _TAG.sub(" ", text)
    if policy.strip_blockquote_marks and ">" in text:
        text = _QUOTED.sub("", text)
    if policy.fold_trailing_colons:
        text = _COLON.sub("", text)
    if policy.collapse_whitespace:
        text = " ".join(text.split())
    return text.casefold() if policy.fold_case else text
