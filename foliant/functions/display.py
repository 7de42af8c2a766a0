"""Numbers as text. The exact binary value is rounded, ties to even, as reports have it: 2.675 is 2.67 and 0.125 is 0.12.

Spark's round and format_string round the shortest decimal that reads back as the number, half up, so they give 2.68 and
0.13; format_number with a pattern goes by the binary value. This holds for numbers shown with up to 15 digits in all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """With so many decimals; null of null."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def rounded(x: Column, digits: int) -> Column:
    """The double next to the rounded value."""
    return fixed(x, digits).cast("double")


def signed(x: Column, digits: int) -> Column:
    """With a sign in any case."""
    text = fixed(x, digits)
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def right(text: Column, width: int) -> Column:
    """Filled from the left, never cut."""
    return F.format_string(f"%{width}s", text)


def left(text: Column, width: int) -> Column:
    return F.format_string(f"%-{width}s", text)
