"""Byte ranges of large files as a data source: one partition per stretch of planned bytes, Arrow batches out.

``read_ranges`` plans ``(case_id, os_path, seq, start, length)`` rows and reads them by ``spark.read.format("byte_ranges")``; bytes outside
them (sparse holes, dead parts of a journal, the middle of a log whose end is wanted) are never touched. Long ranges are cut into pieces,
short ones share a partition, and small pieces do so once there are more than a few for every core. The plan is cut and written by tasks and
read by those that read its pieces; the driver sees a name and two numbers for each file of the plan, and a partition is a few places in such files.
Filters belong on the plan, before it is read: what Spark 4.1 pushes into a Python source for one query
stays in force for later queries of the same DataFrame, so this source takes no filters from it.

Defined cases: a file that ends early gives what it has and then a row with ``error`` and no bytes; one that cannot be opened
gives only that row; empty ranges and empty plans give nothing; other ranges are not affected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from casework.session import shared_dir
from casework.sources.files import CHUNK, UnsupportedScheme, located, open_uri

NAME = "byte_ranges"
SCHEMA = "case_id string, os_path string, seq bigint, chunk_offset bigint, bytes binary, error string"
PIECE = 64 * CHUNK
TASKS = 64  # partitions that a read has at least before small pieces share one
_BATCH = pa.schema([
    ("case_id", pa.string()), ("os_path", pa.string()), ("seq", pa.int64()), ("chunk_offset", pa.int64()), ("bytes", pa.binary()), ("error", pa.string()),
])
_PLAN = ("case_id", "os_path", "seq", "start", "length")
_CUT = pa.schema([("case_id", pa.string()), ("os_path", pa.string()), *((c, pa.int64()) for c in ("seq", "start", "length", "stretch"))])
_CUT_ROWS = 16_384  # of the plan, that a task holds
_GROUP_BYTES = 4 * CHUNK  # a task reads the row groups with its stretches


@dataclass
class Stretch(InputPartition):
    """What one task reads: pieces (case_id, os_path, seq, start, length), or places of the plan (file, first stretch, end)."""

    pieces: list[tuple]


def numbered(ranges: Iterable[tuple], piece: int) -> Iterator[tuple]:
    """Ranges cut into pieces, each with the number of its stretch: neighbours share one of at most ``piece`` bytes."""
    number, room = -1, 0
    for case, path, seq, start, length in ranges:
        for at in range(start, start + length, piece):
            n = min(piece, start + length - at)
            if n > room:
                number, room = number + 1, piece
            room -= n
            yield case, path, seq, at, n, number


def stretches(ranges: Iterable[tuple], piece: int) -> list[Stretch]:
    """Ranges cut into pieces and packed, in order, into partitions of at most ``piece`` bytes."""
    return [Stretch([p[:5] for p in some]) for _, some in groupby(numbered(ranges, piece), key=lambda p: p[5])]


def neighbours(n: int, most: int, piece: int) -> int:
    """How many stretches one task reads, so that there are at most ``most`` tasks, unless one would then read more than PIECE bytes."""
    return max(1, min(-(-n // most), PIECE // piece))


def joined(parts: list[Stretch], most: int, piece: int) -> list[Stretch]:
    """At most ``most`` partitions, neighbours being read by one task, unless a task would then read more than PIECE bytes."""
    k = neighbours(len(parts), most, piece)
    return [Stretch([p for part in parts[a : a + k] for p in part.pieces]) for a in range(0, len(parts), k)] if k > 1 else parts


def places(files: list[tuple[str, int, int]], most: int, piece: int) -> list[Stretch]:
    """Partitions over the stretches of plan files (name, stretches, bytes), by their places only; files of one stretch share a partition as pieces do."""
    k = neighbours(sum(n for _, n, _ in files), most, piece)
    if k == 1:
        shared = stretches(((None, name, 0, 0, size) for name, n, size in files if n == 1), piece)
        return [Stretch([(p[1], 0, 1) for p in s.pieces]) for s in shared] + [Stretch([(name, i, i + 1)]) for name, n, _ in files if n > 1 for i in range(n)]
    out, room = [], 0
    for name, n, _ in files:
        at = 0
        while at < n:
            if not room:
                out.append(Stretch([]))
                room = k
            some = min(room, n - at)
            out[-1].pieces.append((name, at, at + some))
            at, room = at + some, room - some
    return out


class RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.plan, self.piece, self.tasks = options["path"], int(options.get("piece", PIECE)), int(options.get("tasks", TASKS))
        self.every, self.take = int(options.get("every", 0)), int(options.get("take", 0))
        if self.piece < 1 or (self.every and (CHUNK % self.every or self.piece % CHUNK)):
            raise ValueError("pieces are positive, and whole chunks of whole steps where only some bytes are taken")

    def partitions(self) -> list[InputPartition]:
        filesystem, path = located(f"{self.plan}-files")
        files = pads.dataset(path, filesystem=filesystem, format="parquet").to_table(columns=["file", "n", "size"]).sort_by("file")
        return places(list(zip(*(c.to_pylist() for c in files.columns), strict=True)), self.tasks, self.piece) or [Stretch([])]

    def _planned(self, partition: Stretch) -> Iterator[tuple]:
        filesystem, path = located(self.plan)
        number = pads.field("stretch")
        for name, first, end in partition.pieces:
            plan = pads.dataset(f"{path}/{name}", filesystem=filesystem, format="parquet")
            wanted = (number >= first) & (number < end)
            for batch in plan.to_batches(columns=list(_PLAN), filter=wanted, batch_size=_CUT_ROWS, batch_readahead=1, use_threads=False):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        handle, opened = None, None
        try:
            for case, path, seq, start, length in self._planned(partition):
                at, end = start, start + length
                try:
                    if opened != path:  # pieces of one file follow each other
                        if handle is not None:
                            handle.close()
                        handle = opened = None
                        handle, opened = open_uri(path), path
                    handle.seek(start)
                    while at < end:
                        data = handle.read(min(CHUNK, end - at))
                        if not data:
                            raise EOFError(f"ends at {at}, {end - at} bytes early")
                        yield self._row(case, path, seq, at, self._taken(data))
                        at += len(data)
                except UnsupportedScheme:
                    raise
                except (OSError, EOFError, ValueError) as error:
                    yield self._row(case, path, seq, at, None, f"unreadable: {error}")
        finally:
            if handle is not None:
                handle.close()

    def _taken(self, data: bytes) -> bytes:
        """All bytes, or the first ``take`` of every ``every`` bytes, as far as they are complete."""
        if not self.every:
            return data
        whole = -(-max(0, len(data) - self.take + 1) // self.every)
        places = (np.arange(whole)[:, None] * self.every + np.arange(self.take)).ravel()
        return np.frombuffer(data, np.uint8)[places].tobytes()

    @staticmethod
    def _row(case: str, path: str, seq: int, at: int, data: bytes | None, error: str | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"case_id": case, "os_path": path, "seq": seq, "chunk_offset": at, "bytes": data, "error": error}], schema=_BATCH)


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(dict(self.options))


def read_ranges(ranges: DataFrame, piece: int = PIECE, every: int = 0, take: int = 0) -> DataFrame:
    """Bytes of ``(case_id, os_path, seq, start, length)`` ranges in chunks of at most 1 MiB, and ``error`` where a file ends or fails.

    With ``every`` and ``take`` only the first ``take`` of every ``every`` bytes of a chunk come back, one behind the other.
    """
    spark = ranges.sparkSession
    plan = shared_dir(spark, "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        pieces = numbered(rows, piece)
        while some := list(islice(pieces, _CUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _CUT.types, strict=True)], schema=_CUT)

    wanted = ranges.select("case_id", "os_path", *[F.col(c).cast("bigint").alias(c) for c in ("seq", "start", "length")]).where("length > 0")
    kept = wanted.repartition("os_path").sortWithinPartitions("os_path", "start")  # pieces of one file follow each other
    schema = "case_id string, os_path string, seq bigint, start bigint, length bigint, stretch bigint"
    kept.mapInArrow(cut, schema).write.option("parquet.block.size", str(_GROUP_BYTES)).parquet(plan)
    files = spark.read.schema(schema).parquet(plan).groupBy(F.col("_metadata.file_name").alias("file"))
    files.agg((F.max("stretch") + 1).alias("n"), F.sum("length").alias("size")).write.parquet(f"{plan}-files")
    spark.dataSource.register(ByteRanges)
    tasks = max(TASKS, 4 * spark.sparkContext.defaultParallelism)
    reader = spark.read.format(NAME).option("piece", str(piece)).option("tasks", str(tasks))
    if every:
        reader = reader.option("every", str(every)).option("take", str(take))
    return reader.load(plan)


# ---- partial reads -----------------------------------------------------------------------


def first_bytes(files: DataFrame, n: int) -> DataFrame:
    """``files`` (case_id, os_path, size) with the first ``n`` bytes of each as ``content``."""
    return _one_cell(files, F.lit(0).cast("bigint"), F.least(F.col("size"), F.lit(n)), n)


def last_bytes(files: DataFrame, n: int) -> DataFrame:
    """``files`` (case_id, os_path, size) with the last ``n`` bytes of each as ``content``."""
    start = F.greatest(F.col("size") - n, F.lit(0))
    return _one_cell(files, start, F.col("size") - start, n)


def _one_cell(files: DataFrame, start, length, n: int) -> DataFrame:  # noqa: ANN001
    if n > 256 * CHUNK:
        raise ValueError("no more than 256 MiB of a file go into one cell")
    listed = files.select("case_id", "os_path", F.col("size").cast("bigint").alias("size"))
    parts = read_ranges(listed.select("case_id", "os_path", F.lit(0).alias("seq"), start.alias("start"), length.alias("length")), piece=max(n, CHUNK))
    chunk = F.struct("chunk_offset", F.hex("bytes").alias("h"))
    read = parts.groupBy("case_id", "os_path").agg(F.array_sort(F.collect_list(F.when(F.col("bytes").isNotNull(), chunk))).alias("c"), F.min("error").alias("error"))
    content = F.unhex(F.array_join(F.transform("c", lambda c: c["h"]), ""))
    found = read.select("case_id", "os_path", content.alias("content"), "error")
    return listed.join(found, ["case_id", "os_path"], "left").withColumn("content", F.when(F.col("error").isNull(), F.coalesce("content", F.lit(b""))))
