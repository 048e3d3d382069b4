"""Numbered lines of text files of any size, each read by many tasks.

A file is cut into pieces without regard to its lines. A first pass reads the pieces side by side and keeps a few facts of each:
how many line ends it has as bytes and as UTF-16 units, where the last one is, and whether it is UTF-8 but for the ends of a
character cut in two. Facts are a row per piece; folding them along a file gives the state at every border: the encoding, the
number of the line that is open, and where it began. A second pass reads from the begin of the open line to the piece's last
line end, so that no line is put together from parts and no row is shuffled by content.

Files are ``(case_id, os_path, path, size)``: ``path`` is what is opened, ``os_path`` what rows are named by. Results equal those of
:func:`casework.operators.lines.read_lines` on the whole content.

Defined cases: an empty file has no lines; a line end at the very end opens no further line; a byte-order mark is no text; a file
that cannot be opened or is shorter than listed has a row in ``problems`` and no lines.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from casework.functions import text
from casework.session import shared_dir
from casework.sources.files import CHUNK, UnsupportedScheme, open_uri, spread

PIECE = 64 * CHUNK
LEAST_PIECE = 2048  # holds all bytes that decide on the encoding, and more than a character
BATCH_BYTES = 4 * CHUNK
KEYS = ("case_id", "os_path")
MARKS = {"utf-8-bom": 3, "utf-16le-bom": 2}  # bytes of the byte-order mark

_FACTS = pa.schema([
    ("case_id", pa.string()), ("os_path", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("mark", pa.binary()), ("nuls", pa.int64()), ("ends", pa.int64()), ("last_end", pa.int64()), ("wide_ends", pa.int64()), ("last_wide_end", pa.int64()),
    ("lead", pa.binary()), ("trail", pa.binary()), ("inner_utf8", pa.bool_()), ("problem", pa.string()),
])
_FACTS_DDL = (
    "case_id string, os_path string, path string, size bigint, start bigint, length bigint, mark binary, nuls bigint, ends bigint, last_end bigint, "
    "wide_ends bigint, last_wide_end bigint, lead binary, trail binary, inner_utf8 boolean, problem string"
)
_LINES = pa.schema([("case_id", pa.string()), ("os_path", pa.string()), ("encoding", pa.string()), ("lossy", pa.bool_()), ("line_no", pa.int64()), ("raw", pa.binary())])


def _read(handle, start: int, length: int) -> Iterator[bytes]:  # noqa: ANN001
    handle.seek(start)
    while length > 0:
        data = handle.read(min(CHUNK, length))
        if not data:
            raise EOFError(f"ends {length} bytes early")
        length -= len(data)
        yield data


class _Utf8:
    """Whether bytes are UTF-8, apart from a character cut at their begin (``lead``) and their end (``trail``)."""

    def __init__(self) -> None:
        self.decoder, self.ok, self.lead, self.begun = codecs.getincrementaldecoder("utf-8")("strict"), True, b"", False

    def add(self, data: bytes) -> None:
        if not self.begun:
            n = 0
            while n < min(3, len(data)) and 0x80 <= data[n] < 0xC0:
                n += 1
            self.lead, data, self.begun = data[:n], data[n:], True
        if self.ok:
            try:
                self.decoder.decode(data)
            except UnicodeDecodeError:
                self.ok = False

    @property
    def trail(self) -> bytes:
        return self.decoder.getstate()[0] if self.ok else b""


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = {"mark": b"", "nuls": 0, "ends": 0, "last_end": None, "wide_ends": 0, "last_wide_end": None, "lead": b"", "trail": b"", "inner_utf8": True, "problem": None}
            at, utf8 = row["start"], _Utf8()
            try:
                with open_uri(row["path"]) as handle:
                    for data in _read(handle, row["start"], row["length"]):
                        if at == 0:
                            found["mark"], found["nuls"] = data[:3], data[:2000].count(0)
                        if (last := data.rfind(b"\n")) >= 0:
                            found["ends"] += data.count(b"\n")
                            found["last_end"] = at + last + 1
                        units = np.flatnonzero(np.frombuffer(data, "<u2", len(data) // 2) == 10)  # pieces and reads begin at even places
                        if len(units):
                            found["wide_ends"] += len(units)
                            found["last_wide_end"] = at + 2 * int(units[-1]) + 2
                        utf8.add(data)
                        at += len(data)
                found |= {"lead": utf8.lead, "trail": utf8.trail, "inner_utf8": utf8.ok}
            except UnsupportedScheme:
                raise
            except (OSError, EOFError, ValueError) as error:
                found["problem"] = f"unreadable: {error}"
            yield pa.RecordBatch.from_pylist([row | found], schema=_FACTS)


def _pieces(files: DataFrame, piece: int) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(piece).cast("bigint"))
    cut = files.select(*KEYS, "path", F.col("size").cast("bigint").alias("size")).withColumn("start", F.explode(starts))
    return cut.withColumn("length", F.least(F.lit(piece).cast("bigint"), F.col("size") - F.col("start")))


def _borders(facts: DataFrame, encoding: str | None) -> DataFrame:
    """One row per piece that has lines to give: encoding, lossy, the first line's number, begin and end of what to read."""
    along = Window.partitionBy(*KEYS).orderBy("start")
    whole = Window.partitionBy(*KEYS)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    trail = F.coalesce(F.lag("trail").over(along), F.lit(b""))
    last = F.col("start") + F.col("length") == F.col("size")
    joint = F.when(F.length(trail) > 0, F.is_valid_utf8(F.concat(trail, F.col("lead")).cast("string"))).otherwise(F.length("lead") == 0)
    fits = F.col("inner_utf8") & joint & ~(last & (F.length("trail") > 0))
    of_first = lambda name: F.max(F.when(F.col("start") == 0, F.col(name))).over(whole)
    states = facts.withColumns({"valid": fits, "head": of_first("mark"), "zeros": of_first("nuls"), "failed": F.max("problem").over(whole)})
    states = states.where(F.col("failed").isNull()).withColumn("valid", F.min("valid").over(whole))
    mark = F.hex("head")
    found = (
        F.when(mark.startswith("EFBBBF"), "utf-8-bom").when(mark.startswith("FFFE"), "utf-16le-bom").when(F.col("zeros") > 100, "utf-16le")
        .when(F.col("valid"), "utf-8").otherwise("utf-8-lossy")
    )
    states = states.withColumn("encoding", F.lit(encoding) if encoding else found)
    wide = F.col("encoding").startswith("utf-16")
    states = states.withColumns({
        "n": F.when(wide, F.col("wide_ends")).otherwise(F.col("ends")), "ended": F.when(wide, F.col("last_wide_end")).otherwise(F.col("last_end")),
        "lossy": F.when(F.col("encoding") == "utf-8-bom", ~F.col("valid")).otherwise(F.col("encoding") == "utf-8-lossy"),
    })
    spans = states.withColumns({
        "first_no": F.coalesce(F.sum("n").over(before), F.lit(0)) + 1,
        "begin": F.coalesce(F.max("ended").over(before), F.lit(0)),
        "end": F.when(last, F.col("size")).otherwise(F.col("ended")),
    })
    return spans.where(F.col("begin") < F.col("end")).select(*KEYS, "path", "encoding", "lossy", "first_no", "begin", "end")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            wide = row["encoding"].startswith("utf-16")
            end_mark, carriage = (b"\n\0", b"\r\0") if wide else (b"\n", b"\r")
            skip = MARKS.get(row["encoding"], 0) if row["begin"] == 0 else 0
            number, lines, held, rest = row["first_no"], [], 0, []

            def out(row: dict = row) -> pa.RecordBatch:
                n = len(lines)
                same = [pa.array([row[k]] * n, _LINES.field(k).type) for k in ("case_id", "os_path", "encoding", "lossy")]
                return pa.RecordBatch.from_arrays([*same, pa.array(range(number - n, number), pa.int64()), pa.array(lines, pa.binary())], schema=_LINES)

            with open_uri(row["path"]) as handle:
                for data in _read(handle, row["begin"] + skip, row["end"] - row["begin"] - skip):
                    if wide:
                        ends = 2 * np.flatnonzero(np.frombuffer(data, "<u2", len(data) // 2) == 10)
                        begins = np.concatenate([[0], ends + 2]).tolist()
                        parts = [data[a:b] for a, b in zip(begins, [*ends.tolist(), len(data)])]
                    else:
                        parts = data.split(end_mark)
                    for part in parts[:-1]:
                        line = b"".join((*rest, part)) if rest else part
                        rest = []
                        lines.append(line.removesuffix(carriage))
                        number, held = number + 1, held + len(line)
                    if parts[-1]:
                        rest.append(parts[-1])
                    if held >= BATCH_BYTES:
                        yield out()
                        lines, held = [], 0
            tail = b"".join(rest)  # only the last piece reads beyond its last line end
            if len(tail) > (1 if wide else 0):
                lines.append(tail)
                number += 1
            if lines:
                yield out()


def scan_text(files: DataFrame, piece: int = PIECE, encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines (case_id, os_path, encoding, decode_lossy, line_no, line) and problems (case_id, os_path, error) of ``files``.

    ``encoding`` is what all files are taken for; without it each file's own is found. A first pass over the bytes runs here.
    """
    if piece < LEAST_PIECE or piece % 2:
        raise ValueError(f"pieces have an even number of at least {LEAST_PIECE} bytes")
    spark, path = files.sparkSession, shared_dir(files.sparkSession, "text-facts")
    spread(_pieces(files, piece), "path", "start").mapInArrow(_facts, _FACTS_DDL).write.parquet(path)
    facts = spark.read.schema(_FACTS_DDL).parquet(path)
    problems = facts.where(F.col("problem").isNotNull()).groupBy(*KEYS).agg(F.min("problem").alias("error"))
    spans = spread(_borders(facts, encoding), "path", "begin")
    raw = spans.mapInArrow(_split, "case_id string, os_path string, encoding string, lossy boolean, line_no bigint, raw binary")
    return raw.select(*KEYS, "encoding", F.col("lossy").alias("decode_lossy"), "line_no", line_text(F.col("raw"), F.col("encoding")).alias("line")), problems


def line_text(raw: Column, encoding: Column) -> Column:
    """Text of a line's bytes without their mark."""
    return F.when(encoding.startswith("utf-16"), text.utf16(raw)).when(encoding == "utf-8", raw.cast("string")).otherwise(text.utf8_lossy(raw))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            digest = hashlib.sha256()
            try:
                with open_uri(row["path"]) as handle:
                    for data in _read(handle, 0, row["size"]):
                        digest.update(data)
                found.append((row["case_id"], row["os_path"], digest.hexdigest()))
            except UnsupportedScheme:
                raise
            except (OSError, EOFError):
                continue  # scan_text says why
        yield pa.record_batch([pa.array([f[k] for f in found], pa.string()) for k in range(3)], names=["case_id", "os_path", "source_sha256"])


def hash_files(files: DataFrame) -> DataFrame:
    """(case_id, os_path, source_sha256): one task reads one file piece by piece, whatever its size."""
    listed = files.select(*KEYS, "path", F.col("size").cast("bigint").alias("size"))
    return spread(listed, "path").mapInArrow(_hashes, "case_id string, os_path string, source_sha256 string")
