"""Little-endian fields of binary records, on hex text so that all stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _offset(off: int | Column) -> Column:
    return F.lit(off) if isinstance(off, int) else off


def mirrored_hex(b: Column) -> Column:
    """Upper-case hex of the bytes in reverse order: little-endian fields become readable numbers.

    One character per byte (ISO-8859-1) makes the string reversal a byte reversal.
    """
    return F.hex(F.encode(F.reverse(F.decode(b, "ISO-8859-1")), "ISO-8859-1"))


def _number(digits: Column, width: int) -> Column:
    return F.conv(digits, 16, 10).cast("bigint" if width <= 4 else "decimal(20,0)")


def mirrored_uint(mirrored: Column, length: int, off: int, width: int) -> Column:
    """Unsigned integer at byte ``off`` of a ``length``-byte block given as mirrored hex."""
    return _number(F.substring(mirrored, 2 * (length - off - width) + 1, 2 * width), width)


def le_hex(b: Column, off: int | Column, width: int) -> Column:
    """Upper-case hex of ``width`` bytes at ``off``, most significant byte first."""
    return mirrored_hex(F.substring(b, (_offset(off) + 1).cast("int"), F.lit(width)))


def le_uint(b: Column, off: int | Column, width: int) -> Column:
    """Unsigned little-endian integer; up to 4 bytes BIGINT, 8 bytes DECIMAL(20,0)."""
    return _number(le_hex(b, off, width), width)


def file_ref(b: Column, off: int | Column, width: int) -> Column:
    """File reference as ``0x`` text: 8 bytes give 16 digits, 16 bytes give 32."""
    return F.concat(F.lit("0x"), le_hex(b, off, width))


def to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def sha256_hex(b: Column) -> Column:
    return F.sha2(b, 256)
