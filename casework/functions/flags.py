"""Bit-flag decoding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Change-journal reason bits.
REASON = {
    0x00000001: "DATA_OVERWRITE",
    0x00000002: "DATA_EXTEND",
    0x00000004: "DATA_TRUNCATION",
    0x00000010: "NAMED_DATA_OVERWRITE",
    0x00000020: "NAMED_DATA_EXTEND",
    0x00000040: "NAMED_DATA_TRUNCATION",
    0x00000100: "FILE_CREATE",
    0x00000200: "FILE_DELETE",
    0x00000400: "EA_CHANGE",
    0x00000800: "SECURITY_CHANGE",
    0x00001000: "RENAME_OLD_NAME",
    0x00002000: "RENAME_NEW_NAME",
    0x00004000: "INDEXABLE_CHANGE",
    0x00008000: "BASIC_INFO_CHANGE",
    0x00010000: "HARD_LINK_CHANGE",
    0x00020000: "COMPRESSION_CHANGE",
    0x00040000: "ENCRYPTION_CHANGE",
    0x00080000: "OBJECT_ID_CHANGE",
    0x00100000: "REPARSE_POINT_CHANGE",
    0x00200000: "STREAM_CHANGE",
    0x00400000: "TRANSACTED_CHANGE",
    0x00800000: "INTEGRITY_CHANGE",
    0x80000000: "CLOSE",
}

# Change-journal source bits.
SOURCE = {
    0x1: "DATA_MANAGEMENT",
    0x2: "AUXILIARY_DATA",
    0x4: "REPLICATION_MANAGEMENT",
    0x8: "CLIENT_REPLICATION_MANAGEMENT",
}

# File attribute bits.
ATTRIBUTE = {
    0x0001: "READONLY",
    0x0002: "HIDDEN",
    0x0004: "SYSTEM",
    0x0010: "DIRECTORY",
    0x0020: "ARCHIVE",
    0x0080: "NORMAL",
    0x0100: "TEMPORARY",
    0x0200: "SPARSE_FILE",
    0x0400: "REPARSE_POINT",
    0x0800: "COMPRESSED",
    0x1000: "OFFLINE",
    0x2000: "NOT_CONTENT_INDEXED",
    0x4000: "ENCRYPTED",
    0x8000: "INTEGRITY_STREAM",
}

# Collector manifests use the same bits in lower case, plus four of the cloud-file bits.
ATTRIBUTE_LOWER = {mask: name.lower() for mask, name in ATTRIBUTE.items()} | {
    0x020000: "no_scrub_data",
    0x080000: "pinned",
    0x100000: "unpinned",
    0x400000: "recall_on_data_access",
}


def present(candidates: list[Column]) -> Column:
    """Array of the non-null candidates.

    The lambda keeps a projection of very many tests out of one whole-stage method, which would grow
    past what the JVM compiles; Spark then splits the tests over small methods instead.
    """
    return F.array_compact(F.array(*candidates))


def decode_flags(mask: Column, table: Mapping[int, str]) -> Column:
    """Names of the set bits in table order; null when none is set."""
    bits = F.array(*[F.struct(F.lit(bit).cast("bigint").alias("bit"), F.lit(name).alias("name")) for bit, name in table.items()])
    wide = mask.cast("bigint")
    names = F.transform(F.filter(bits, lambda b: wide.bitwiseAND(b["bit"]) != 0), lambda b: b["name"])
    known = sum(table)
    return F.when(wide.bitwiseAND(F.lit(known).cast("bigint")) != 0, names)
