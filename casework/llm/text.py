"""Words and case as all operators of this package see them: ASCII white space, ASCII case."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def count_of(text: Column, characters: str) -> Column:
    """How many code points of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))
