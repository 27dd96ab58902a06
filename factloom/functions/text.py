"""Column helpers for text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as notes are trimmed by: ASCII, no-break space, byte-order mark and the Unicode spaces.
SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def trim(x: Column) -> Column:
    """x without white space at both ends."""
    return F.regexp_replace(x, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def trim_end(x: Column) -> Column:
    return F.regexp_replace(x, rf"[{SPACE}]+\z", "")


def is_blank(x: Column) -> Column:
    return ~x.rlike(rf"[^{SPACE}]")


def round3(x: Column) -> Column:
    """Three decimals, halves up; not F.round, which works on the decimal text of a double."""
    return F.floor(x * 1000 + 0.5) / 1000


def last_index(x: Column, sign: str) -> Column:
    """Zero-based place of the last `sign` in x, or -1."""
    at = F.instr(F.reverse(x), sign)
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(x) - at)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once a row."""
    return F.transform(F.array(value), body).getItem(0)
