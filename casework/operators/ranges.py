"""Byte-range algebra: windows, clipping, islands, data runs, pack offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casework.operators.ordered import DEFAULT_WIDTH, Carry, carry_forward, scan

STREAM_KEYS = ("case_id", "os_path")
BEHIND_ALL = (1 << 63) - 1


def _number(c: Column) -> Column:
    """Unsigned decimal text to a number; null for blank or anything else."""
    bare = F.trim(c)
    return F.when(bare.rlike(r"^\+?\d+$"), bare.try_cast("bigint"))


def active_window(first: Column, after: Column, size: Column) -> Column:
    """struct(start, length) of the live part of a journal; null when empty or the whole stream."""
    start, end = _number(first), F.least(_number(after), size)
    usable = (_number(after).isNotNull()) & (start < end) & ~((start == 0) & (end == size))
    return F.when(usable, F.struct(start.alias("start"), (end - start).alias("length")))


def parse_window(first: Column, after: Column, base: Column, size: Column) -> Column:
    """struct(start, end) to decode of a captured stream; the whole file when bounds make no sense.

    Bounds count from ``base``; one that lies before it is ignored.
    """
    base = F.coalesce(base, F.lit(0))

    def shifted(c: Column) -> Column:
        moved = _number(c) - base
        return F.when(moved >= 0, moved)

    start = F.coalesce(shifted(first), F.lit(0))
    end = F.least(F.coalesce(shifted(after), size), size)
    ok = start < end
    return F.struct(
        F.when(ok, start).otherwise(0).cast("bigint").alias("start"),
        F.when(ok, end).otherwise(size).cast("bigint").alias("end"),
    )


def clip_ranges(runs: DataFrame, windows: DataFrame, keys: Sequence[str] = STREAM_KEYS) -> DataFrame:
    """Dense runs cut to their stream's window; runs outside vanish.

    Windows are one row per stream, so this is an equi-join and never an all-pairs comparison.
    """
    cut = runs.where(~F.col("sparse") & (F.col("length") > 0)).join(windows, list(keys))
    cut = cut.withColumns(
        {
            "start": F.greatest("logical_offset", "window_start"),
            "end": F.least(F.col("logical_offset") + F.col("length"), F.col("window_end")),
        }
    )
    return cut.where(F.col("start") < F.col("end")).select(*keys, "seq", "start", "end")


def coalesce_ranges(
    runs: DataFrame, windows: DataFrame, keys: Sequence[str] = STREAM_KEYS, width: int | None = DEFAULT_WIDTH
) -> DataFrame:
    """Contiguous ranges to read: clipped dense runs in listed order, joined where they touch.

    A stream with no usable run falls back to its whole window, which stands behind all runs and is dropped where a row precedes it.
    """
    keys = list(keys)
    whole = windows.where(F.col("window_start") < F.col("window_end")).select(
        *keys, F.lit(BEHIND_ALL).alias("seq"), F.col("window_start").alias("start"), F.col("window_end").alias("end")
    )
    listed = clip_ranges(runs, windows, keys).unionByName(whole)
    gap = F.when(F.col("__end").eqNullSafe(F.col("start")), 0).otherwise(1)
    islands = scan(
        listed, keys, "seq", {"__end": F.col("end")},
        {"__island": Carry("sum", gap, inclusive=True), "__before": Carry("sum", F.lit(1))}, width,
    )
    used = islands.where((F.col("seq") != BEHIND_ALL) | (F.col("__before") == 0))
    return used.groupBy(*keys, "__island").agg(
        F.min("seq").alias("seq"), F.min_by("start", "seq").alias("start"),
        F.sum(F.col("end") - F.col("start")).alias("length"),
    ).select(*keys, F.when(F.col("seq") == BEHIND_ALL, 0).otherwise(F.col("seq")).alias("seq"), "start", "length")


def build_runs(extents: DataFrame, keys: Sequence[str] = STREAM_KEYS, width: int | None = DEFAULT_WIDTH) -> DataFrame:
    """Data runs of listed extents: neighbours join when contiguous in the stream and on the volume.

    Two extents without a volume offset count as contiguous there; one with and one without do not.
    """
    keys = list(keys)
    before = {
        "__end": F.col("logical_offset") + F.col("length"),
        "__sparse": F.col("sparse"),
        "__vend": F.col("volume_offset") + F.col("length"),
    }
    joins = (
        F.col("__end").eqNullSafe(F.col("logical_offset"))
        & F.col("__sparse").eqNullSafe(F.col("sparse"))
        & F.col("__vend").eqNullSafe(F.col("volume_offset"))
    )
    runs = scan(extents, keys, "seq", before, {"__run": Carry("sum", F.when(joins, 0).otherwise(1), inclusive=True)}, width)
    return runs.groupBy(*keys, "__run").agg(
        F.min("seq").alias("seq"),
        F.min_by("logical_offset", "seq").alias("logical_offset"),
        F.min_by("volume_offset", "seq").alias("volume_offset"),
        F.sum("length").alias("length"),
        F.any_value("sparse").alias("sparse"),
    ).drop("__run")


def pack_offsets(entries: DataFrame, keys: Sequence[str], seq: str = "seq", width: int | None = DEFAULT_WIDTH) -> DataFrame:
    """Offset of every packed entry: the running total of the lengths before it; empty entries skipped."""
    return carry_forward(
        entries.where(F.col("length") > 0), list(keys), seq, {"offset_in_pack": Carry("sum", F.col("length"))}, width
    )
