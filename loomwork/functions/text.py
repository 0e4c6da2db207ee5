"""String expressions shared by the corpus and trace operators."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    front = F.regexp_replace(text, f"(?U)^{_BLANK}+", "")
    return F.regexp_replace(front, f"(?U){_BLANK}+$", "")


def has_ink(text: Column) -> Column:
    """Whether a character is no white space, so that a line is left in standard form."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def lines(text: Column) -> Column:
    """Stripped, non-empty lines in order."""

    def stripped(line: Column) -> Column:
        # most lines have no white space at their ends, which is told from two characters
        ends = F.concat(F.substring(line, 1, 1), F.substring(line, -1, 1))
        return F.when(ends.rlike(f"(?U){_BLANK}"), strip(line)).otherwise(line)

    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda s: F.length(s) > 0)


def standard_text(text: Column) -> Column:
    return F.array_join(lines(text), "\n")


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def char_counts(texts: pd.Series) -> pd.Series:
    """Map from each character (code point) to how often it occurs.

    One linear pass per text. Built-in expressions need a pass per distinct character, or a
    row per character; both were measured to be several times slower.
    """
    return texts.map(lambda text: None if text is None else dict(Counter(text)))


def shared_chars(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two character maps."""
    least = F.map_zip_with(
        a, b, lambda k, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))
    )
    return F.aggregate(F.map_values(least), F.lit(0), lambda s, n: s + n)


def quick_ratio(a: Column, b: Column, len_a: Column, len_b: Column) -> Column:
    """2 * shared / total characters; 1.0 when both texts are empty."""
    total = len_a + len_b
    return F.when(total == 0, F.lit(1.0)).otherwise(
        F.lit(2.0) * shared_chars(a, b) / F.when(total > 0, total)
    )


def first_segment(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", 1)


def last_segment(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", -1)
