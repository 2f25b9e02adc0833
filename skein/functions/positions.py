"""Columns of source lines: editors count UTF-16 units, files hold UTF-8 bytes. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _before(line: Column, column: Column) -> Column:
    """The part of a line before a column of UTF-16 units, whole characters only: one that the column splits belongs to it. A column past the end gives the line."""
    units = F.encode(line, "UTF-16BE")
    at = F.least(F.greatest(column, F.lit(0)) * 2, F.octet_length(units)).cast("int")
    # The second unit of a pair is 0xDC00 to 0xDFFF.
    splits = F.hex(F.substring(units, at + 1, F.lit(1))).rlike("^D[C-F]$") & (at > 0)
    cut = F.when(splits, at + 2).otherwise(at)
    return F.decode(F.substring(units, F.lit(1), cut), "UTF-16BE")


def byte_of(line: Column, column: Column) -> Column:
    """The byte offset of a column of UTF-16 units, from 0."""
    return F.octet_length(_before(line, column))


def _after(line: Column, column: Column) -> Column:
    return F.substring(line, F.char_length(_before(line, column)) + 1, F.char_length(line))


_WORD = r"[\p{IsAlphabetic}\p{N}_]+"
_ANGLES = "<[^<>]*>"
for _ in range(3):
    _ANGLES = f"<(?:[^<>]|{_ANGLES})*>"


def identifier_at(line: Column, column: Column) -> Column:
    """The identifier that starts at a column, without r# before it; null if none does."""
    name = F.regexp_extract(_after(line, column), f"^(?:r#)?+({_WORD})", 1)
    return F.when(name != "", name)


def is_call(line: Column, column: Column) -> Column:
    """Whether the identifier at a column is called: a round bracket follows, or any bracket after a macro's mark, with type arguments (of four levels at most) before it or not."""
    return _after(line, column).rlike(rf"^{_WORD}\s*(?:!\s*(?:::{_ANGLES}\s*)?[(\[{{]|(?:::{_ANGLES}\s*)?\()")
