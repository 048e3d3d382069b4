"""Small binary artifacts decoded by expressions: INFO2, rp.log, page signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casework.functions import text, time
from casework.functions.binary import le_uint
from casework.operators.shape import settled
from casework.sources.ranges import first_bytes, read_ranges

FILE_KEYS = ["case_id", "os_path"]


def split_errors(decoded: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that decoded, and a diagnostics table of those that did not; bad input never fails a job."""
    decoded = settled(decoded)
    ok = decoded.where(F.col(error).isNull()).drop(error)
    keys = [c for c in ("case_id", "os_path", "record_offset") if c in decoded.columns]
    return ok, decoded.where(F.col(error).isNotNull()).select(*keys, error)


def info2_error(content: Column) -> Column:
    """Why an INFO2 file cannot be read; null when it can."""
    signature, entry = le_uint(content, 0, 4), le_uint(content, 12, 4)
    return (
        F.when(F.length(content) < 20, "file too small")
        .when(signature != 5, F.concat(F.lit("unsupported format signature: "), signature.cast("string")))
        .when(~entry.isin(280, 800), F.concat(F.lit("unsupported file entry size: "), entry.cast("string")))
    )


def decode_info2(files: DataFrame) -> DataFrame:
    """One row per used entry, or one row with ``error`` for an unreadable file."""
    c = F.col("content")
    # settled: a derived content must not be derived again for every entry inside the lambda below
    head = settled(files.select(*FILE_KEYS, "content")).withColumns({"error": info2_error(c), "__size": F.length(c)})
    head = head.withColumns(
        {
            "__count": F.when(F.col("error").isNull(), le_uint(c, 4, 4)),
            "__entry": F.when(F.col("error").isNull(), le_uint(c, 12, 4)),
        }
    )
    fits = F.call_function("div", F.col("__size") - 20, F.col("__entry"))
    # unused entries count against the stated number of entries
    wanted = F.when(F.col("__count") > 0, F.least(fits, F.col("__count"))).otherwise(fits)
    # entries are cut out before the explode, so a file's bytes are not repeated for every entry
    slots = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.when(wanted > 0, wanted - 1)),
        lambda i: F.struct(
            (i * F.col("__entry") + 20).alias("offset"),
            F.substring(c, (i * F.col("__entry") + 21).cast("int"), F.col("__entry").cast("int")).alias("e"),
        ),
    )
    rows = head.select(*FILE_KEYS, "error", "__entry", F.explode_outer(slots).alias("__slot"))
    rows = rows.select(*FILE_KEYS, "error", "__entry", F.col("__slot.offset").alias("offset"), F.col("__slot.e").alias("__e"))
    rows = rows.where(F.col("offset").isNotNull() | F.col("error").isNotNull())
    e = F.col("__e")
    rows = rows.withColumns(
        {
            "__ascii": text.asciiz(F.substring(e, 1, 260)),
            "__wide": F.when(F.col("__entry") > 280, text.null_if_empty(text.utf16z(F.substring(e, 281, 520)))),
            "__ft": le_uint(e, 268, 8),
            "file_size": le_uint(e, 276, 4),
        }
    )
    name = F.coalesce(F.col("__wide"), F.col("__ascii"))
    used = (name != "") | (F.col("file_size") != 0) | (F.col("__ft") != 0)
    return rows.where(F.col("error").isNotNull() | used).select(
        *FILE_KEYS,
        F.lit("windows:metadata:deleted_item").alias("data_type"),
        le_uint(e, 264, 4).alias("drive_number"),
        "file_size",
        "offset",
        name.alias("original_filename"),
        le_uint(e, 260, 4).alias("record_index"),
        time.filetime_text(F.col("__ft")).alias("deletion_time"),
        F.when((F.col("__ascii") != "") & (F.col("__ascii") != name), F.col("__ascii")).alias("short_filename"),
        "error",
    )


def parse_info2(files: DataFrame) -> DataFrame:
    return split_errors(decode_info2(files))[0]


def decode_rp_log(files: DataFrame) -> DataFrame:
    c = F.col("content")
    short = F.length(c) < 24
    body = F.when(~short, c)
    return files.select(
        *FILE_KEYS,
        F.lit("windows:restore_point:info").alias("data_type"),
        text.utf16z(F.substring(body, F.lit(17), F.length(body) - 24)).alias("description"),
        le_uint(body, 0, 4).alias("restore_point_event_type"),
        le_uint(body, 4, 4).alias("restore_point_type"),
        le_uint(body, 8, 8).alias("sequence_number"),
        time.filetime_text(le_uint(body, F.length(body) - 8, 8)).alias("creation_time"),
        F.when(short, "file too small").alias("error"),
    )


def parse_rp_log(files: DataFrame) -> DataFrame:
    return split_errors(decode_rp_log(files))[0]


def _records(content: Column, size: int | Column, limit: int | None) -> Column:
    """Leading four bytes (hex) of each whole record, at most ``limit`` of them."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.call_function("div", F.length(content), size).cast("int")
    n = F.least(n, F.lit(limit)) if limit else n
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.hex(F.substring(content, i * size.cast("int") + 1, F.lit(4))))


def _magic(word: str) -> str:
    return word.encode().hex().upper()


def _count(records: Column, word: str) -> Column:
    return F.size(F.filter(records, lambda r: r == _magic(word))).cast("bigint")


def sample_signatures(streams: DataFrame, record_size: int | Column, n: int = 64) -> DataFrame:
    """Signature counts over the first ``n`` whole records of each stream, with the file-table verdict.

    ``mft_ok``: the first record is FILE. ``log_ok``: at least one log page signature was seen.
    """
    recs = F.col("__recs")
    rows = settled(streams).withColumn("__recs", _records(F.col("content"), record_size, n))
    return rows.select(
        *FILE_KEYS,
        F.size(recs).cast("bigint").alias("sampled"),
        text.utf8_lossy(F.unhex(F.get(recs, F.lit(0)))).alias("first_signature"),
        _count(recs, "FILE").alias("file_count"),
        _count(recs, "BAAD").alias("baad_count"),
        _count(recs, "RSTR").alias("rstr_count"),
        _count(recs, "RCRD").alias("rcrd_count"),
        F.coalesce(F.get(recs, F.lit(0)) == _magic("FILE"), F.lit(False)).alias("mft_ok"),
        ((_count(recs, "RSTR") + _count(recs, "RCRD")) > 0).alias("log_ok"),
    )


def count_page_signatures(streams: DataFrame, page: int = 4096, magic: str = "INDX") -> DataFrame:
    """Pages with at least four bytes left, and how many of them start with ``magic``."""
    c = F.col("content")
    starts = F.when(
        F.length(c) >= 4,
        F.sequence(F.lit(0), F.length(c) - 4, F.lit(page)),
    ).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.hex(F.substring(c, i + 1, F.lit(4))) == _magic(magic))
    return settled(streams.select(*FILE_KEYS, "content")).select(
        *FILE_KEYS,
        F.size(starts).cast("bigint").alias("expected_buffers"),
        F.size(hits).cast("bigint").alias("signature_buffers"),
    )


def sample_file_signatures(files: DataFrame, record_size: int, n: int = 64) -> DataFrame:
    """``sample_signatures`` of listed files (case_id, os_path, size): the bytes of ``n`` records are read of each, whatever its size."""
    return sample_signatures(first_bytes(files, n * record_size).where(F.col("error").isNull()), record_size, n)


def count_file_page_signatures(files: DataFrame, page: int = 4096, magic: str = "INDX") -> DataFrame:
    """``count_page_signatures`` of listed files (case_id, os_path, size) of any size, by many tasks; four bytes a page leave the reader."""
    ranges = files.select(*FILE_KEYS, F.lit(0).alias("seq"), F.lit(0).alias("start"), F.col("size").alias("length"))
    heads = F.regexp_extract_all(F.hex("bytes"), F.lit("(.{8})"), F.lit(1))
    counted = read_ranges(ranges, every=page, take=4).select(*FILE_KEYS, "error", F.size(heads).alias("n"), F.size(F.filter(heads, lambda h: h == _magic(magic))).alias("hits"))
    read = counted.groupBy(*FILE_KEYS).agg(F.sum(F.when(F.col("n") > 0, F.col("n"))).alias("n"), F.sum(F.when(F.col("hits") > 0, F.col("hits"))).alias("hits"), F.max("error").alias("error"))
    whole = files.select(*FILE_KEYS).join(read, FILE_KEYS, "left").where(F.col("error").isNull())
    return whole.select(*FILE_KEYS, F.coalesce("n", F.lit(0)).cast("bigint").alias("expected_buffers"), F.coalesce("hits", F.lit(0)).cast("bigint").alias("signature_buffers"))


def attribute_tally(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Attributes per kind, and expected against signed index buffers."""

    def of(kind: str) -> Column:
        return F.count_if(F.col("attribute") == kind).cast("bigint")

    allocation = F.col("attribute") == "index_allocation"
    return entries.groupBy(*keys).agg(
        F.count("*").cast("bigint").alias("attributes"),
        of("index_root").alias("index_root"),
        of("index_allocation").alias("index_allocation"),
        of("bitmap").alias("bitmap"),
        F.coalesce(F.sum(F.when(allocation, F.col("expected_buffers"))), F.lit(0)).cast("bigint").alias("expected_buffers"),
        F.coalesce(F.sum(F.when(allocation, F.col("signature_buffers"))), F.lit(0)).cast("bigint").alias("signature_buffers"),
    )
