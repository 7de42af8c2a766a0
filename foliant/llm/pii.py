"""Personal data with offset-preserving deobfuscation.

Plain identifiers come from the base patterns on the source text. Then transducers rewrite disguises, keeping for each
normalised character the source span that it came from: homoglyphs and compatibility forms to ASCII letters and digits,
zero-width characters to nothing, spelled digits to digits, and at/dot disguises to @ and dots. The same detectors read
the normalised text; a find that covers a rewritten character and overlaps no base span is mapped back and added.
Null texts count as empty. Each row is looked at by itself, so nothing is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A number's first digit follows no digit: starts inside a run of digits fail or succeed as the run's start does.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """As the pattern's leftmost matches: the run of local characters before an @, then a domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def numbers(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m[0])) <= 15:
                yield "phone", *m.span()


def detect(text: str) -> list[Span]:
    """Spans by kind as listed, then start; ends exclusive, in code points."""
    found = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        found += numbers(text)
    return found


# -- transducers ------------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУԁԛԝаесіјорԛѕхуһӏɡɩοανρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "ABESIJKMHOPCTXYdqwaecijopqsxyhlgioavptuikABEZHIKMNOPTYX",
        strict=True,
    )
)
#: Full stops of other scripts.
STOPS = frozenset("。｡．﹒․")
#: Characters without width.
NOTHING = frozenset("­​‌‍‎‏⁠﻿")
#: Spelled digits of the languages at hand, and the signs said between them.
SPELLED = {
    w: str(n % 10)
    for words in (
        "zero one two three four five six seven eight nine",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for n, w in enumerate(words.split())
} | {"oh": "0", "zwo": "2"}
SIGNS = {"plus": "+", "más": "+", "dash": "-", "hyphen": "-", "dot": ".", "point": ".", "punkt": ".", "punto": "."}
UNIT = "|".join(sorted(SPELLED, key=len, reverse=True))
SIGN = "|".join(sorted(SIGNS, key=len, reverse=True))
GAP = r"(?:[ ,]{1,2}|-|\n)"
#: At least four units in a row, one or more of them spelled; the first may be a plus.
SAID = re.compile(rf"(?i)(?<!\w)(?:(?:plus|más){GAP}|\+ ?)?(?:{UNIT}|[0-9]+)(?:{GAP}(?:(?:{SIGN}){GAP})?(?:{UNIT}|[0-9]+)){{3,}}(?!\w)")
SAID_TOKEN = re.compile(rf"(?i)(?P<unit>\b(?:{UNIT})\b)|(?P<sign>\b(?:{SIGN})\b)|(?P<gap>[ ,\n-]+)")
HINT = re.compile(rf"\b(?:{UNIT})\b")  # of lower-cased text

OPEN, CLOSE = r"[(\[{<]", r"[)\]}>]"
#: White space before a bracket or word is matched from its first character on only, so long runs of it cost no more than their length.
RUN, RUN_OF_ONE = r"(?:(?<!\s)\s*+)", r"(?:(?<!\s)\s++)"
#: A dot between blanks is one only before what ends an address; fixed values, the commonest.
TOP = r"(?=(?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu)(?![a-z0-9]))"
DOT_WORD = rf"(?:\s*+{OPEN}\s*+(?:dot|point|punkt|punto|\.)\s*+{CLOSE}\s*+|\s++(?:dot|punkt|punto)\s++|\s++\.\s++{TOP}|_dot_|-dot-)"
DOT_HERE = re.compile(rf"(?i){DOT_WORD}")
AT_BRACKET = rf"{RUN}{OPEN}\s*+(?:at|arroba|@)\s*+{CLOSE}\s*+"
BLANK = r"(?<![ \t])[ \t]"
#: said: an at that only a domain with a said dot makes one (see Domains.said_dot).
AT = re.compile(rf"(?i){AT_BRACKET}|(?P<said>{RUN_OF_ONE}(?:at|arroba)\s++|_at_|-at-)|{BLANK}++@[ \t]*+|{BLANK}*+@[ \t]++|@")
#: One of these is in every text with a disguised address.
AT_HINT = re.compile(r"(?i)dot|@|at\s*+[)\]}>]|arroba|punkt|punto")
LABEL_RUN = re.compile("(?i)[a-z0-9-]+")
DISGUISED_DOMAIN = re.compile(rf"(?i)[a-z0-9-]+?(?:(?:{DOT_WORD}|\.)[a-z0-9-]+?)+(?![a-z0-9]|-(?!dot))")
#: Read from its end to its start, as far as it goes.
DISGUISED_LOCAL = regex.compile(rf"(?ri)(?:(?<![a-z0-9._%+-])[a-z0-9._%+-]+{DOT_WORD.replace('*+', '*').replace('++', '+')})*[a-z0-9._%+-]+")
DOT = re.compile(rf"(?i)(?:{RUN}{OPEN}\s*+(?:dot|point|punkt|punto|\.)\s*+{CLOSE}\s*+|{RUN_OF_ONE}(?:dot|punkt|punto)\s++|{RUN_OF_ONE}\.\s++{TOP}|_dot_|-dot-)")
#: Dots in brackets between the parts of a number.
DOT_IN_NUMBER = re.compile(rf"(?i)(?<=[0-9])\s*+{OPEN}\s*+(?:dot|point|punkt|punto|\.)\s*+{CLOSE}\s*+(?=[0-9])")


@functools.cache
def fold(c: str) -> str:
    """One character's ASCII look, or itself."""
    if c <= "\x7f":
        return c
    if c in NOTHING:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c in STOPS:
        return "."
    if unicodedata.decimal(c, None) is not None:
        return str(unicodedata.decimal(c))
    k = unicodedata.normalize("NFKC", c)
    return k if k.isascii() and k.strip() and not c.isspace() else c


class Tape:
    """A text, and for each of its characters the source span and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.new = text, range(len(text)), range(1, len(text) + 1), bytes(len(text))

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the sorted, separate spans; a replacement's characters all stand for the whole span."""
        if not edits:
            return
        text, starts, ends, new, at = [], [], [], bytearray(), 0
        for a, b, put in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            new += self.new[at:a]
            if put:
                text.append(put)
                starts.extend([self.starts[a]] * len(put))
                ends.extend([self.ends[b - 1]] * len(put))
                new += b"\1" * len(put)
            at = b
        self.text, self.starts, self.ends, self.new = "".join(text), starts, ends, bytes(new)


def fold_characters(tape: Tape) -> None:
    if tape.text.isascii() or not any(fold(c) != c for c in set(tape.text)):
        return
    tape.edit([(k, k + 1, fold(c)) for k, c in enumerate(tape.text) if c > "\x7f" and fold(c) != c])


class Domains:
    """Of a text, asked from left to right: whether a run of labels from a place on is followed by, or holds, a said dot.

    What is known of a run serves every place in it, so long runs with many at signs cost no more than their length."""

    def __init__(self, text: str):
        self.text, self.low, self.end, self.dot_after, self.inside = text, text.lower(), -1, False, -1

    def said_dot(self, at: int) -> bool:
        if at >= self.end:
            run = LABEL_RUN.match(self.text, at)
            if not run:
                return False
            self.end = run.end()
            self.dot_after = DOT_HERE.match(self.text, self.end) is not None
        if self.dot_after:
            return True
        if self.inside <= at:  # a dot within the run, after one character at least
            found = self.low.find("-dot-", at + 1)
            self.inside = found if found >= 0 else len(self.low)
        return self.inside < self.end


def join_at_and_dot(tape: Tape) -> None:
    edits: list[tuple[int, int, str]] = []
    upto = at = 0
    domains = Domains(tape.text)
    while m := AT.search(tape.text, at):
        if m["said"] and not domains.said_dot(m.end()):
            at = m.start() + 1
            continue
        at = m.end()
        if m.start() < upto:
            continue
        domain = DISGUISED_DOMAIN.match(tape.text, m.end())
        local = DISGUISED_LOCAL.match(tape.text, upto, m.start()) if domain else None
        if not local or not domain or (m[0] == "@" and not DOT.search(domain[0]) and not DOT.search(local[0])):
            continue
        edits += [(local.start() + x.start(), local.start() + x.end(), ".") for x in DOT.finditer(local[0])]
        edits += [(*m.span(), "@")] if m[0] != "@" else []
        edits += [(domain.start() + x.start(), domain.start() + x.end(), ".") for x in DOT.finditer(domain[0])]
        upto = domain.end()
    tape.edit(edits)


def join_bracketed_dots(tape: Tape) -> None:
    tape.edit([(*m.span(), ".") for m in DOT_IN_NUMBER.finditer(tape.text)])


def join_spelled_digits(tape: Tape) -> None:
    edits: list[tuple[int, int, str]] = []
    for m in SAID.finditer(tape.text):
        if not HINT.search(m[0].lower()):
            continue
        for x in SAID_TOKEN.finditer(tape.text, *m.span()):
            put = SPELLED.get(x[0].lower(), "") if x["unit"] else SIGNS.get(x[0].lower(), "") if x["sign"] else ""
            edits.append((*x.span(), put))
    tape.edit(edits)


def deobfuscated(text: str, base: list[Span]) -> list[Span]:
    """The spans that the transducers add."""
    tape = Tape(text)
    fold_characters(tape)
    if AT_HINT.search(tape.text):
        join_at_and_dot(tape)
    if DIGIT.search(tape.text):
        join_bracketed_dots(tape)
    if HINT.search(tape.text.lower()):
        join_spelled_digits(tape)
    if tape.text == text:
        return []
    # strictly inside of spans known so far, and how far those go that begin at a place
    inside, longest = bytearray(len(text) + 1), {}

    def take(a: int, b: int) -> None:
        inside[a + 1 : b] = b"\1" * (b - a - 1)
        longest[a] = max(b, longest.get(a, b))

    for _, a, b in base:
        take(a, b)
    added = []
    for kind, a, b in detect(tape.text):
        start, end = tape.starts[a], tape.ends[b - 1]
        changed = 1 in tape.new[a:b] or end - start != b - a
        # what lies apart from all spans known, or holds more than those it meets
        if changed and not inside[start] and not inside[end] and longest.get(start, -1) < end:
            added.append((kind, start, end))
            take(start, end)
    return added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end, disguised) for every row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = detect(text)
                rows.append([(k, a, b, False) for k, a, b in base] + [(k, a, b, True) for k, a, b in deobfuscated(text, base)])
            rows = [[dict(zip(("kind", "start", "end", "disguised"), x)) for x in r] for r in rows]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(rows, pa.list_(span))})

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(find, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long, disguised: boolean>>")


def summary(docs: DataFrame, **names: str) -> DataFrame:
    """doc_id, n_<kind> (all spans of the kind), base_sha256, spans."""
    s = find_spans(docs, **names)
    order = "case s.kind " + " ".join(f"when '{k}' then {n}" for n, k in enumerate(KINDS)) + " end"
    s = s.withColumn("ordered", F.expr(f"array_sort(transform(spans, s -> struct({order} as k, s.start as start, s.end as end, s.kind as kind, s.disguised as disguised)))"))
    text = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return s.select("doc_id", *counts, F.sha2(F.expr(text.format("filter(ordered, s -> not s.disguised)")), 256).alias("base_sha256"), F.expr(text.format("ordered")).alias("spans"))


def base_digest(text: str) -> str:
    return hashlib.sha256(joined(detect(text)).encode()).hexdigest()
