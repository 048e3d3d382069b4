"""Timestamps of five epochs.

Text forms are built from integers, so they neither lose the 100 ns digit nor depend on the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Epoch offsets.
FILETIME_UNIX_EPOCH = 116_444_736_000_000_000  # 100 ns units, 1601 -> 1970
WEBKIT_UNIX_EPOCH = 11_644_473_600_000_000  # microseconds, 1601 -> 1970
COCOA_UNIX_EPOCH = 978_307_200  # seconds, 1970 -> 2001

# Fixed value: seconds of the last representable date; later values have no text.
MAX_SECONDS = 8_210_266_876_799

# The leading time of a protection-log line.
MPLOG_TIME = (
    r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?"
    r"|\d{1,2}[-/]\d{1,2}[-/]\d{4}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)"
)


def _int_div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def rfc3339(seconds: Column, nanos: Column | None = None) -> Column:
    """UTC text of Unix seconds (floor) with nine fraction digits, or none.

    A zone-less timestamp plus an interval never consults the session time zone.
    """
    seconds = F.when(F.abs(seconds) <= MAX_SECONDS, seconds)
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + seconds.cast("interval second")
    text = F.replace(moment.cast("string"), F.lit(" "), F.lit("T"))
    fraction = [] if nanos is None else [F.lit("."), F.lpad(nanos.cast("string"), 9, "0")]
    return F.concat(text, *fraction, F.lit("Z"))


def _since_unix_100ns(c: Column) -> Column:
    """100 ns units after the Unix epoch as BIGINT; beyond its range (year 31196) there is no value."""
    ticks = c.try_cast("bigint")
    return F.when(ticks > FILETIME_UNIX_EPOCH, ticks - F.lit(FILETIME_UNIX_EPOCH))


def _late_filetime(c: Column) -> Column:
    """Units after the epoch for FILETIMEs that do not fit a BIGINT; null for all others."""
    wide = c.cast("decimal(20,0)")
    return F.when(wide > F.lit(9223372036854775807), wide - F.lit(FILETIME_UNIX_EPOCH))


def filetime_to_micros(c: Column) -> Column:
    return F.coalesce(_int_div(_since_unix_100ns(c), 10), _int_div(_late_filetime(c), 10))


def filetime_to_ts(c: Column) -> Column:
    """FILETIME to a microsecond timestamp; null at or before the Unix epoch."""
    return F.timestamp_micros(filetime_to_micros(c))


def filetime_text(c: Column) -> Column:
    ticks, late = _since_unix_100ns(c), _late_filetime(c)
    return F.coalesce(
        rfc3339(_int_div(ticks, 10_000_000), ticks % 10_000_000 * 100),
        rfc3339(_int_div(late, 10_000_000), (late % 10_000_000).cast("bigint") * 100),
    )


def webkit_to_micros(c: Column) -> Column:
    return F.when(c > WEBKIT_UNIX_EPOCH, c - WEBKIT_UNIX_EPOCH)


def webkit_to_ts(c: Column) -> Column:
    return F.timestamp_micros(webkit_to_micros(c))


def _micros_text(micros: Column) -> Column:
    return rfc3339(_int_div(micros, 1_000_000), F.pmod(micros, F.lit(1_000_000)) * 1000)


def webkit_text(c: Column) -> Column:
    return _micros_text(webkit_to_micros(c))


def unix_us_to_ts(c: Column) -> Column:
    return F.timestamp_micros(F.when(c > 0, c))


def unix_us_text(c: Column) -> Column:
    return _micros_text(F.when(c > 0, c))


def unix_s_text(c: Column) -> Column:
    return rfc3339(F.when(c > 0, c))


def _cocoa(c: Column) -> tuple[Column, Column]:
    value = F.when(F.abs(c) >= 2.220446049250313e-16, c)
    whole = value.cast("bigint")  # truncates toward zero
    # a negative fraction is stored as 0 ns, so such values move up to the next full second
    nanos = F.greatest(F.round((value - whole) * 1e9), F.lit(0.0)).cast("bigint")
    return whole + COCOA_UNIX_EPOCH, nanos


def cocoa_to_ts(c: Column) -> Column:
    seconds, nanos = _cocoa(c)
    return F.timestamp_micros(F.when(nanos < 1_000_000_000, seconds * 1_000_000 + _int_div(nanos, 1000)))


def cocoa_text(c: Column) -> Column:
    seconds, nanos = _cocoa(c)
    return rfc3339(F.when(nanos < 1_000_000_000, seconds), nanos)


_ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})?$"
_US = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})\s+(\d{2}):(\d{2}):(\d{2})(?:\.\d+)?$"


def _log_time_raw(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, MPLOG_TIME, 1), F.lit(""))


def _log_time_parts(raw: Column) -> Column:
    """struct of the date, clock, fraction and zone texts of a leading time; nulls where it is none."""
    iso, us = raw.rlike(_ISO), raw.rlike(_US)

    def part(iso_group: int, us_group: int) -> Column:
        return F.when(iso, F.regexp_extract(raw, _ISO, iso_group)).when(us, F.regexp_extract(raw, _US, us_group))

    us_date = F.concat_ws(
        "-", F.regexp_extract(raw, _US, 4), F.lpad(F.regexp_extract(raw, _US, 1), 2, "0"), F.lpad(F.regexp_extract(raw, _US, 3), 2, "0")
    )
    date = F.when(iso, F.regexp_extract(raw, _ISO, 1)).when(us, us_date)
    return F.struct(
        date.try_cast("date").alias("date"), part(2, 5).alias("h"), part(3, 6).alias("m"), part(4, 7).alias("s"),
        F.when(iso, F.regexp_extract(raw, _ISO, 5)).alias("fraction"), F.when(iso, F.regexp_extract(raw, _ISO, 6)).alias("zone"),
    )


def _log_time(line: Column, raw: Column, p: Column) -> Column:
    zone = p["zone"]
    valid = F.coalesce(p["date"].isNotNull() & (p["h"] < "24") & (p["m"] < "60") & (p["s"] <= "60"), F.lit(False))
    zone_h, zone_m = F.substring(zone, 2, 2), F.substring(zone, 5, 2)
    zoned = valid & F.coalesce((zone == "Z") | ((zone_h < "24") & (zone_m < "60") & (zone != "")), F.lit(False))
    local = valid & (F.coalesce(zone, F.lit("")) == "")
    shift = F.when(zone == "Z", F.lit(0)).otherwise(
        F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (zone_h.try_cast("int") * 60 + zone_m.try_cast("int"))
    )
    minutes = F.unix_date(p["date"]) * 1440 + p["h"].try_cast("int") * 60 + p["m"].try_cast("int") - shift
    # zero, three, six or nine fraction digits are shown; further ones do not count
    digits = F.rpad(F.substring(p["fraction"], 1, 9), 9, "0")
    shown = F.regexp_replace(F.concat(F.lit("."), digits), r"^\.(0{9}|(\d{3})(0{6})|(\d{6})(000)|(\d{9}))$", "$2$4$6")
    # zones shift whole minutes, so the seconds text never changes
    utc = F.concat(
        F.substring(rfc3339(minutes.cast("bigint") * 60), 1, 17), p["s"],
        F.when(shown == "", "").otherwise(F.concat(F.lit("."), shown)), F.lit("+00:00"),
    )
    assumption = F.when(raw.isNull() | zoned, F.lit(None).cast("string")).when(local, "local_time_unspecified").otherwise(
        "unparsed_timestamp"
    )
    rest = F.when(raw.isNull(), line).otherwise(
        F.ltrim(F.substring(line, F.char_length(raw) + 1, F.char_length(line)), F.lit(" \t"))
    )
    return F.struct(
        raw.alias("raw"), F.when(zoned, utc).alias("utc"), assumption.alias("assumption"), rest.alias("rest")
    )


def mplog_time(line: Column) -> Column:
    """struct(raw, utc, assumption, rest) of a line's leading time.

    Only an explicit zone yields ``utc``; a wall-clock time is kept as text with an assumption.
    """
    raw = _log_time_raw(line)
    return _log_time(line, raw, _log_time_parts(raw))


def with_log_time(df: DataFrame, line: str, name: str) -> DataFrame:
    """Add :func:`mplog_time` step by step, which keeps the generated code of each step small."""
    df = df.withColumn("__raw_time", _log_time_raw(F.col(line)))
    df = df.withColumn("__time_parts", _log_time_parts(F.col("__raw_time")))
    df = df.withColumn(name, _log_time(F.col(line), F.col("__raw_time"), F.col("__time_parts")))
    return df.drop("__raw_time", "__time_parts")
