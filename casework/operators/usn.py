"""Change-journal streams: record splitting, header decode, record rows, statistics."""

from __future__ import annotations

import re
import struct
from collections.abc import Generator, Iterator
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from casework.functions import paths, text, time
from casework.functions.binary import mirrored_hex, mirrored_uint
from casework.functions.flags import ATTRIBUTE, REASON, SOURCE, decode_flags
from casework.operators.ranges import coalesce_ranges, parse_window
from casework.operators.shape import settled
from casework.session import shared_dir
from casework.sources.files import CHUNK, open_uri, spread

FILE_KEYS = ["case_id", "os_path"]

# ``head_bytes`` of a record are its header and name: a name lies within 16-bit offset + 16-bit length, so no field
# is ever beyond this many bytes. ``record_length`` is the whole record's.
MAX_USED = 2 * 0xFFFF

_NONZERO = re.compile(rb"[^\x00]")

SPLIT_DDL = (
    "case_id string, os_path string, seq bigint, begin bigint, attempt int, kind string, stream_offset bigint, "
    "amount bigint, head_bytes binary"
)
_SPLIT = pa.schema(
    [("case_id", pa.string()), ("os_path", pa.string()), ("seq", pa.int64()), ("begin", pa.int64()), ("attempt", pa.int32()),
     ("kind", pa.string()), ("stream_offset", pa.int64()), ("amount", pa.int64()), ("head_bytes", pa.binary())]
)


class _Window:
    """Bytes [start, filled) of one range, read in whole chunks counted from the range start."""

    def __init__(self, handle: BinaryIO, origin: int, end: int, at: int) -> None:
        self.handle, self.end = handle, end
        self.start, self.data = at, b""
        self.filled = min(origin + -(-(at - origin) // CHUNK) * CHUNK, end)
        if self.filled > at:
            self.data = self._load(at, self.filled)

    def _load(self, begin: int, upto: int) -> bytes:
        self.handle.seek(begin)
        data = self.handle.read(upto - begin)
        if len(data) < upto - begin:
            raise EOFError("unexpected end of file")
        return data

    def reach(self, at: int, upto: int) -> None:
        """Keep bytes from ``at`` on and read chunks until ``upto`` is covered."""
        filled = self.filled
        while filled < min(upto, self.end):
            filled = min(filled + CHUNK, self.end)
        if at >= self.filled:
            self.data = self._load(at, filled)
        else:
            self.data = self.data[at - self.start:]
            if filled > self.filled:
                self.data += self._load(self.filled, filled)
        self.start, self.filled = at, filled


Part = tuple[str, int, int, bytes | None]


def split_range(
    handle: BinaryIO, start: int, length: int, entry: int | None = None, limit: int | None = None
) -> Generator[Part, None, int]:
    """(kind, offset, amount, record) of one contiguous range, in order; returns where the walk stopped.

    Records are chained by their length, so a range is walked from its start; only the current chunk
    and the current record's used bytes are held. What follows depends on the position alone, so a walk
    may also begin at any ``entry`` the chain passes, and stop at the first position from ``limit`` on.
    """
    end = start + length
    at = start if entry is None else entry
    limit = end if limit is None else limit
    window = _Window(handle, start, end, at)
    while at < limit:
        if window.filled - at < 8:
            if window.filled == end:
                break
            window.reach(at, window.filled + 1)
            continue
        base = at - window.start
        (size,) = struct.unpack_from("<I", window.data, base)
        if size == 0:
            hit = _NONZERO.search(window.data, base)
            if hit is None:
                at = window.filled
                continue
            run = hit.start() - base
            yield "zero_padding", at, run, None
            at += run
        elif size < 8:
            yield "invalid_length", at, size, None
            at += 8
        elif at + size > end:
            break  # never completes inside this range
        else:
            used = min(size, MAX_USED)
            if at + size > window.filled:
                window.reach(at, at + used)
                base = 0
            yield "record", at, size, window.data[base:base + used]
            at += size
            if at > window.filled:
                window.reach(at, at)
    if at < limit:
        rest = end - at
        zeros = rest < 8 and not any(window.data[at - window.start:])
        yield ("zero_tail" if zeros else "trailing"), at, rest, None
        at = end
    return at


LOOK_BACK = 128 * 1024


def _likely_record(data: bytes, at: int) -> bool:
    size, major, minor = struct.unpack_from("<IHH", data, at)
    if size % 8 or not 60 <= size <= MAX_USED or major not in (2, 3) or minor:
        return False
    name_length, name_offset = struct.unpack_from("<HH", data, at + (56 if major == 2 else 72))
    return name_offset in (60, 76) and name_offset + name_length <= size


def guess_entry(handle: BinaryIO, start: int, length: int, boundary: int) -> int:
    """Where the chain probably first stands at or after ``boundary``; a wrong guess is found out later."""
    back = max(start, boundary - LOOK_BACK)
    handle.seek(back)
    data = handle.read(min(boundary + 80, start + length) - back)
    first = next((at for at in range(0, len(data) - 80, 8) if _likely_record(data, at)), 0)
    walk = split_range(handle, start, length, back + first, boundary)
    while True:
        try:
            next(walk)
        except StopIteration as stop:
            return stop.value


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of each listed segment, and one ``segment`` row with the entry and exit of its walk."""
    for batch in batches:
        for row in batch.to_pylist():
            source = (row["case_id"], row["os_path"], row["seq"], row["begin"], row["attempt"])
            start, length, begin, limit, entry = row["start"], row["length"], row["begin"], row["limit"], row["entry"]
            rows: list[tuple] = []
            held = 0
            try:
                with open_uri(row["os_path"]) as handle:
                    if entry is None:
                        entry = start if begin == start else guess_entry(handle, start, length, begin)
                    walk = split_range(handle, start, length, entry, limit)
                    while True:
                        try:
                            part = next(walk)
                            rows.append(source + part)
                            held += len(part[3] or b"")
                        except StopIteration as finished:
                            rows.append(source + ("segment", entry, finished.value, None))
                            break
                        if len(rows) == 4096 or held > 16 * CHUNK:
                            yield _batch(rows)
                            rows, held = [], 0
            except (OSError, EOFError) as error:
                rows.append(source + (f"unreadable: {error}", start, length, None))
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SPLIT)], schema=_SPLIT)


RANGE = [*FILE_KEYS, "seq"]


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _walk(segments: DataFrame) -> DataFrame:
    wanted = segments.select(*RANGE, "start", "length", "begin", "limit", F.col("entry").cast("bigint").alias("entry"), F.col("attempt").cast("int").alias("attempt"))
    return _kept(spread(wanted, "os_path", "begin").mapInArrow(_split_batches, SPLIT_DDL), "journal-walk")


def _exits(walked: DataFrame) -> DataFrame:
    return walked.where(F.col("kind") == "segment").select(
        *RANGE, "begin", "attempt", F.col("stream_offset").alias("entry"), F.col("amount").alias("stop")
    )


def compose(marks: DataFrame) -> DataFrame:
    """What is to be done with each segment, given entry and exit of its last walk: adds ``came``, ``passed`` and ``redo``.

    A segment fits when the one before it stopped at its entry. Where all before it fit, the chain stands at a known place: what
    ends before that place is passed over by one large record. Then the first of any segments that do not fit is to be walked again
    from where the one before it stopped; what comes behind it may fit then.
    """
    along = Window.partitionBy(*RANGE).orderBy("begin")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    came = F.lag("stop").over(along)
    df = marks.withColumn("fits", came.isNull() | (came == F.col("entry")))
    df = df.withColumn("sure", F.min("fits").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    df = df.withColumn("known", F.max(F.when(F.col("sure"), F.col("stop"))).over(whole))
    df = df.withColumn("passed", ~F.col("sure") & (F.col("limit") <= F.col("known")) & (F.col("attempt") >= 0))
    df = df.withColumns({"entry": F.when(F.col("passed"), F.col("known")).otherwise(F.col("entry")), "stop": F.when(F.col("passed"), F.col("known")).otherwise(F.col("stop"))})
    df = df.withColumn("came", came).withColumn("fits", F.col("passed") | F.col("came").isNull() | (F.col("came") == F.col("entry")))
    return df.withColumn("redo", ~F.col("fits") & F.lag("fits").over(along)).drop("fits", "sure", "known")


def walk_ranges(ranges: DataFrame, piece: int) -> tuple[DataFrame, DataFrame]:
    """Parts of all ranges, and their segments with entry, exit and how often each was walked.

    A range longer than ``piece`` is cut into segments. Each is a function from the place where the chain enters it to the place
    where it leaves, of which a first walk, from a guessed entry, finds one value; all segments are walked side by side. Composing
    them finds the guesses that were wrong, and only those segments are walked again. Walks are written once; no part is
    read twice from the stream unless its segment was entered at the wrong place.
    """
    cuts = F.sequence(F.col("start"), F.col("start") + F.col("length") - 1, F.lit(piece).cast("bigint"))
    segments = ranges.where(F.col("length") > 0).select(*RANGE, "start", "length", F.explode(cuts).alias("begin")).withColumns(
        {"limit": F.least(F.col("begin") + piece, F.col("start") + F.col("length")), "entry": F.lit(None), "attempt": F.lit(0)}
    )
    walked = [_walk(segments)]
    failed = walked[0].where(F.col("kind").startswith("unreadable")).select(*RANGE).distinct()
    places = segments.select(*RANGE, "begin", "start", "length", "limit")
    marks = _exits(walked[0]).join(places, [*RANGE, "begin"]).withColumn("walks", F.lit(1))
    broken = not failed.isEmpty()
    if broken:  # its guesses are void: one walk says how far it can be read
        marks = marks.join(failed, RANGE, "left_anti")
    while True:
        plan = _kept(compose(marks), "journal-segments")
        if plan.where("redo OR passed").isEmpty():
            break
        again = plan.where("redo").withColumns({"entry": F.col("came"), "attempt": F.lit(len(walked))})
        walked.append(_walk(again))
        found = _exits(walked[-1]).select(*RANGE, "begin", F.col("entry").alias("e"), F.col("stop").alias("s"), F.col("attempt").alias("a"))
        marks = plan.join(found, [*RANGE, "begin"], "left").select(
            *RANGE, "begin", F.when(F.col("passed"), -1).otherwise(F.coalesce("a", "attempt")).alias("attempt"), F.coalesce("e", "entry").alias("entry"),
            F.coalesce("s", "stop").alias("stop"), "start", "length", "limit", (F.col("walks") + F.when(F.col("redo"), 1).otherwise(0)).alias("walks"),
        )
    parts = walked[0]
    if len(walked) > 1 or not plan.where("attempt < 0").isEmpty():
        right = plan.select(*RANGE, "begin", "attempt")
        parts = reduce(DataFrame.unionByName, walked).join(right, [*RANGE, "begin", "attempt"], "left_semi")
    if broken:
        whole = segments.where(F.col("begin") == F.col("start")).join(failed, RANGE, "left_semi")
        redone = _walk(whole.withColumns({"limit": F.col("start") + F.col("length"), "attempt": F.lit(len(walked))}))
        parts = parts.join(failed, RANGE, "left_anti").unionByName(redone.select(parts.columns))
    return parts.where(F.col("kind") != "segment"), plan


def split_usn(ranges: DataFrame, piece: int = 256 * CHUNK) -> tuple[DataFrame, DataFrame]:
    """(records, diagnostics) of journal ranges ``(case_id, os_path, seq, start, length[, base])``.

    ``piece`` (whole chunks) bounds what one task walks. ``record_offset`` counts from the logical base;
    a tail of fewer than eight zero bytes is silent only at the end of a stream's last range.
    """
    if piece % CHUNK:
        raise ValueError("piece must be a multiple of the read chunk")
    base = F.col("base") if "base" in ranges.columns else F.lit(0).cast("bigint")
    tops = ranges.groupBy(*FILE_KEYS).agg(F.max("seq").alias("__top"), F.max(base).alias("__base"))
    placed = walk_ranges(ranges, piece)[0].join(tops, FILE_KEYS).withColumn(
        "record_offset", F.col("stream_offset") + F.coalesce("__base", F.lit(0))
    )
    records = placed.where(F.col("kind") == "record").select(
        *FILE_KEYS, "seq", "record_offset", F.col("amount").alias("record_length"), "head_bytes"
    )
    silent = (F.col("kind") == "zero_tail") & (F.col("seq") == F.col("__top"))
    diagnostics = placed.where((F.col("kind") != "record") & ~silent).select(
        *FILE_KEYS, "record_offset",
        F.when(F.col("kind") == "zero_tail", "trailing").otherwise(F.col("kind")).alias("problem"), "amount",
    )
    return records, diagnostics


# Header and file reference size by record version. File and parent reference follow the
# eight leading bytes; the remaining fields follow them at the same distances in every version.
HEADER_BYTES = {2: 60, 3: 76}
REFERENCE_BYTES = {2: 8, 3: 16}
TAIL_BYTES = 36
FIELDS = {
    "usn": (0, 8), "timestamp_filetime": (8, 8), "reason": (16, 4), "source_info": (20, 4), "security_id": (24, 4),
    "file_attributes": (28, 4), "file_name_length": (32, 2), "file_name_offset": (34, 2),
}


def decode_usn(records: DataFrame) -> DataFrame:
    """Header fields of split records; ``error`` says why a record cannot be decoded.

    Each block of fixed fields is mirrored once, and every field is then one substring of it.
    """
    r, size, major = F.col("head_bytes"), F.col("record_length"), F.col("major_version")
    df = records.withColumn("__version", mirrored_hex(F.substring(r, 5, 4)))
    df = df.withColumns(
        {
            "major_version": mirrored_uint(F.col("__version"), 4, 0, 2),
            "minor_version": mirrored_uint(F.col("__version"), 4, 2, 2),
        }
    )

    def by_version(table: dict[int, int]) -> Column:
        return F.coalesce(*[F.when(major == v, F.lit(n)) for v, n in table.items()])

    df = df.withColumn("__ref", F.when(size >= by_version(HEADER_BYTES), by_version(REFERENCE_BYTES)))
    ref, known = F.col("__ref"), major.isin(*HEADER_BYTES)
    df = df.withColumns(
        {
            "file_reference_number": F.concat(F.lit("0x"), mirrored_hex(F.substring(r, F.lit(9), ref))),
            "parent_file_reference_number": F.concat(F.lit("0x"), mirrored_hex(F.substring(r, 9 + ref, ref))),
            "__tail": mirrored_hex(F.substring(r, 9 + 2 * ref, F.lit(TAIL_BYTES))),
        }
    )
    df = df.withColumns(
        {name: mirrored_uint(F.col("__tail"), TAIL_BYTES, at, width) for name, (at, width) in FIELDS.items()}
    )
    start, end = F.col("file_name_offset"), F.col("file_name_offset") + F.col("file_name_length")
    error = (
        F.when(~known, F.concat(F.lit("unsupported record version "), major, F.lit("."), F.col("minor_version")))
        .when(start.isNull(), F.concat(F.lit("shorter than header of version "), major))
        .when(
            (start >= size) | (end > size),
            F.concat(F.lit("file name bounds "), start, F.lit(".."), end, F.lit(" exceed record size "), size),
        )
    )
    df = df.withColumn("error", error)
    name = text.utf16z(F.substring(r, (start + 1).cast("int"), F.col("file_name_length").cast("int")))
    df = df.withColumn("file_name", F.when(F.col("error").isNull(), name))
    return settled(df.drop("head_bytes", "__version", "__ref", "__tail"))


def usn_rows(decoded: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Journal rows, with flag names, text time and the volume facts of the stream's sidecar."""
    df = decoded.where(F.col("error").isNull())
    if metadata is not None:
        df = df.join(metadata.select(*FILE_KEYS, "volume", "source_access_method"), FILE_KEYS, "left")
    else:
        none = F.lit(None).cast("string")
        df = df.withColumns({"volume": none, "source_access_method": none})
    return df.select(
        "case_id",
        F.lit("windows:filesystem:usn_journal_record").alias("data_type"),
        "record_offset", "record_length", "major_version", "minor_version",
        "file_reference_number", "parent_file_reference_number", "usn", "timestamp_filetime",
        time.filetime_text(F.col("timestamp_filetime")).alias("timestamp"),
        "reason", decode_flags(F.col("reason"), REASON).alias("reason_flags"),
        "source_info", decode_flags(F.col("source_info"), SOURCE).alias("source_flags"),
        "security_id",
        "file_attributes", decode_flags(F.col("file_attributes"), ATTRIBUTE).alias("file_attribute_flags"),
        "file_name", "file_name_length", "file_name_offset", "os_path",
        text.null_if_empty(F.col("volume")).alias("volume"),
        text.null_if_empty(F.col("source_access_method")).alias("source_access_method"),
    )


def usn_stats(rows: DataFrame, by: str) -> DataFrame:
    """Counts by ``reason`` flag, ``name`` or ``hour``."""
    if by == "reason":
        keyed = rows.select("case_id", F.explode_outer("reason_flags").alias("key"))
    elif by == "name":
        keyed = rows.select("case_id", F.col("file_name").alias("key"))
    elif by == "hour":
        keyed = rows.select("case_id", F.substring("timestamp", 1, 13).alias("key"))
    else:
        raise ValueError(f"unknown grouping: {by}")
    return keyed.groupBy("case_id", "key").agg(F.count("*").cast("bigint").alias("n"))


def attach_sidecar(streams: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Streams with the metadata of their best candidate: lowest ``priority`` wins, none gives nulls.

    Candidates collapse by a combinable aggregate before the join, so many candidates of one stream
    never meet in one task.
    """
    values = [c for c in candidates.columns if c not in (key, "priority")]
    best = candidates.groupBy(key).agg(
        F.min_by(F.struct("priority", *values), "priority").alias("__best")
    )
    return streams.join(best, key, "left").select(*streams.columns, "__best.priority", *[f"__best.{v}" for v in values])


SIDECAR_SCHEMA = (
    "volume string, source_access_method string, output_logical_base bigint, "
    "usn_journal_data struct<first_usn:string,next_usn:string>, "
    "data_runs array<struct<logical_offset:bigint,length:bigint,sparse:boolean>>"
)


def sidecar_key(archive_path: Column) -> Column:
    """Path of the metadata file next to a captured stream."""
    return F.regexp_replace(archive_path, r"\.[^./]*$", ".bin.metadata.json")


def sidecar_paths(streams: DataFrame) -> DataFrame:
    """Where a stream's metadata document may be, by priority: next to it, or in its volume's collector manifest."""
    lower = text.ascii_lower(paths.file_name(F.col("archive_path")))
    legacy = F.upper(F.regexp_extract(lower, r"^(.+)_usn_journal_j\.bin$", 1))
    volume = F.when(lower == "$j.bin", F.substring_index("archive_path", "/", 1)).otherwise(text.null_if_empty(legacy))
    central = paths.manifest_path(volume, F.lit("windows_usn_journal"))
    return streams.select(
        *FILE_KEYS,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("priority"), sidecar_key(F.col("archive_path")).alias("archive_path")),
                F.struct(F.lit(2).alias("priority"), central.alias("archive_path")),
            )
        ).alias("c"),
    ).select(*FILE_KEYS, "c.*")


def stream_metadata(streams: DataFrame, files: DataFrame) -> DataFrame:
    """Each stream's metadata document: the adjacent one first, else its volume's collector manifest."""
    wanted = sidecar_paths(streams)
    docs = files.where(F.col("archive_path").endswith(".json")).select(
        "case_id", "archive_path", F.from_json(text.utf8_lossy(F.col("content")), SIDECAR_SCHEMA).alias("doc")
    )
    found = wanted.join(docs, ["case_id", "archive_path"]).withColumn("__id", F.struct(*FILE_KEYS))
    out = attach_sidecar(
        streams.select(*FILE_KEYS, "size").withColumn("__id", F.struct(*FILE_KEYS)),
        found.select("__id", "priority", "doc"),
        "__id",
    )
    return out.select(
        *FILE_KEYS, "size",
        F.col("doc.volume").alias("volume"),
        F.col("doc.source_access_method").alias("source_access_method"),
        F.coalesce("doc.output_logical_base", F.lit(0)).alias("base"),
        F.col("doc.usn_journal_data.first_usn").alias("first_usn"),
        F.col("doc.usn_journal_data.next_usn").alias("next_usn"),
        F.col("doc.data_runs").alias("data_runs"),
    )


def plan_ranges(metadata: DataFrame) -> DataFrame:
    """Ranges to read of every stream, from its metadata; runs stay unshifted as captured."""
    window = parse_window(F.col("first_usn"), F.col("next_usn"), F.col("base"), F.col("size"))
    w = metadata.withColumn("__w", window)
    windows = w.select(*FILE_KEYS, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"))
    runs = metadata.select(*FILE_KEYS, F.posexplode("data_runs").alias("seq", "__r")).select(
        *FILE_KEYS, F.col("seq").cast("bigint").alias("seq"), "__r.*"
    )
    ranges = coalesce_ranges(runs, windows, FILE_KEYS)
    return ranges.join(metadata.select(*FILE_KEYS, "base"), FILE_KEYS)


def parse_usn(files: DataFrame, streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, diagnostics) of journal streams; ``files`` supplies their metadata documents.

    Streams need ``case_id, os_path, archive_path, size``; their bytes are read from ``os_path``.
    """
    metadata = stream_metadata(streams, files)
    records, problems = split_usn(plan_ranges(metadata))
    decoded = decode_usn(records)
    bad = decoded.where(F.col("error").isNotNull()).select(
        *FILE_KEYS, "record_offset", F.col("error").alias("problem"), F.col("record_length").alias("amount")
    )
    return usn_rows(decoded, metadata), problems.unionByName(bad)
