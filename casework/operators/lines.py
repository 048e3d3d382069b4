"""Numbered lines, continuation lines and shell history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casework.functions import paths, text, time
from casework.operators.ordered import DEFAULT_WIDTH, Carry, carry_forward
from casework.sources.ranges import last_bytes

FILE_KEYS = ("case_id", "os_path")


def explode_lines(df: DataFrame, content: Column, *keep: str) -> DataFrame:
    """One row per line of a text column; blank lines are kept and counted."""
    parts = df.select(*keep, F.split(content, "\n").alias("__parts"))
    parts = parts.withColumn("__n", F.size("__parts"))
    parts = parts.select(*keep, "__n", F.posexplode_outer("__parts").alias("__pos", "__part"))
    ended = F.col("__pos") < F.col("__n") - 1
    line = F.when(ended & F.col("__part").endswith("\r"), F.expr("substring(__part, 1, char_length(__part) - 1)")).otherwise(F.col("__part"))
    return parts.where(ended | (F.col("__part") != "")).select(
        *keep, (F.col("__pos") + 1).cast("bigint").alias("line_no"), line.alias("line")
    )


def read_lines(files: DataFrame, *extra: str) -> DataFrame:
    """Decode ``content`` and number its lines, with encoding and lossiness on every line."""
    c, encoding = F.col("content"), F.col("encoding")
    named = files.withColumn("encoding", text.text_encoding(c))
    named = named.withColumns(
        {"decode_lossy": text.decoded_lossy(c, encoding), "__text": text.decode_as(c, encoding)}
    )
    return explode_lines(named, F.col("__text"), *FILE_KEYS, "encoding", "decode_lossy", *extra)


def read_split_lines(spark: SparkSession, path: str, case_id: Column | None = None) -> DataFrame:
    """Numbered lines of UTF-8 text files too large for one cell.

    Spark splits the files as usual; a line's number is its place in its split plus the line counts
    of the earlier splits of the file, so only one row per split goes through a window.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("os_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mono"),
    )
    per_block = raw.groupBy("os_path", "block").agg(F.count("*").alias("n"), F.min("mono").alias("first"))
    w = Window.partitionBy("os_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("os_path", "block", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    return raw.join(starts, ["os_path", "block"]).select(
        (case_id if case_id is not None else F.lit(None).cast("string")).alias("case_id"),
        "os_path",
        (F.col("base") + F.col("mono") - F.col("first") + 1).alias("line_no"),
        F.rtrim(F.col("line"), F.lit("\r")).alias("line"),
    )


def merge_continuations(lines: DataFrame, width: int | None = DEFAULT_WIDTH) -> DataFrame:
    """Join white-space-led lines to the record before them.

    Blank lines vanish first. The first kept line of a file opens a record even when it is indented.
    Returns the head line, the merged ``message``/``raw`` and the continuation texts in order; a group
    here is one record, i.e. one output value.
    """
    keys = list(FILE_KEYS)
    extra = [c for c in lines.columns if c not in (*keys, "line_no", "line")]
    kept = lines.withColumn("line", text.rstrip(F.col("line"))).where(F.col("line") != "")
    kept = kept.withColumn("__indented", text.starts_blank(F.col("line")))
    counted = carry_forward(
        kept,
        keys,
        "line_no",
        {"__record": Carry("sum", F.when(F.col("__indented"), 0).otherwise(1), inclusive=True)},
        width,
    )
    records = counted.groupBy(*keys, "__record").agg(
        F.min("line_no").alias("line_no"),
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("__parts"),
        *[F.any_value(c).alias(c) for c in extra],
    )
    lines_of = F.transform(F.col("__parts"), lambda p: p["line"])
    tail = F.slice(lines_of, F.lit(2), F.size(lines_of))
    return records.select(
        *keys,
        "line_no",
        F.get(lines_of, F.lit(0)).alias("head"),
        tail.alias("continuations"),
        F.array_join(F.transform(lines_of, text.strip), "\n").alias("message"),
        F.array_join(lines_of, "\n").alias("raw"),
        F.size(lines_of).cast("bigint").alias("n_lines"),
        *extra,
    )


def zsh_line(line: Column) -> Column:
    """struct(ts, command) of ``: <seconds>:<duration>;<command>``; null when it is not one."""
    pattern = r"(?s)^: (\d+):[^;]*;(.*)$"
    seconds = F.regexp_extract(line, pattern, 1).try_cast("bigint")
    stamp = time.unix_s_text(seconds)
    return F.when(
        line.rlike(pattern) & stamp.isNotNull(),
        F.struct(stamp.alias("ts"), F.regexp_extract(line, pattern, 2).alias("command")),
    )


def bash_marker(line: Column) -> Column:
    """UTC text of a ``#<seconds>`` line; null for any other line (``#`` and ``#0`` are commands)."""
    return time.unix_s_text(F.when(line.rlike(r"^#\d+$"), F.substring(line, F.lit(2), F.char_length(line)).try_cast("bigint")))


def attach_pending_time(lines: DataFrame, width: int | None = DEFAULT_WIDTH) -> DataFrame:
    """Commands of shell-history lines with the time that applies to each.

    A marker line sets the pending time; the next command without its own time consumes it.
    """
    keys = list(FILE_KEYS)
    rows = lines.withColumn("line", text.strip(F.col("line"))).where(F.col("line") != "")
    rows = rows.withColumns({"__marker": bash_marker(F.col("line")), "__zsh": zsh_line(F.col("line"))})
    plain = F.col("__marker").isNull() & F.col("__zsh").isNull()
    scanned = carry_forward(
        rows,
        keys,
        "line_no",
        {
            "__pending": Carry(
                "last",
                F.when(F.col("__marker").isNotNull(), F.struct(F.col("line_no").alias("pos"), F.col("__marker").alias("ts"))),
            ),
            "__consumed": Carry("max", F.when(plain, F.col("line_no"))),
        },
        width,
    )
    applies = F.col("__pending.pos") > F.coalesce(F.col("__consumed"), F.lit(-1))
    return scanned.where(F.col("__marker").isNull()).select(
        *keys,
        "line_no",
        F.coalesce(F.col("__zsh.command"), F.col("line")).alias("command"),
        F.coalesce(F.col("__zsh.ts"), F.when(applies, F.col("__pending.ts"))).alias("timestamp"),
    )


def shell_rows(lines: DataFrame, width: int | None = DEFAULT_WIDTH) -> DataFrame:
    out = attach_pending_time(lines, width)
    return out.select(
        "case_id",
        paths.shell_name(F.col("os_path")).alias("shell"),
        paths.linux_user(F.col("os_path")).alias("user"),
        "command",
        F.col("line_no").alias("line_number"),
        "os_path",
        "timestamp",
    )


def parse_shell_history(files: DataFrame, width: int | None = DEFAULT_WIDTH) -> DataFrame:
    """Shell-history rows of history files; bytes are taken as UTF-8, bad sequences replaced."""
    lines = explode_lines(files, text.utf8_lossy(F.col("content")), *FILE_KEYS)
    return shell_rows(lines, width)


def tail_lines(files: DataFrame, n: int, max_bytes: int = 64 * 1024) -> DataFrame:
    """Last ``n`` lines found in the last ``max_bytes`` of every file; a cut first line is dropped."""
    size = F.length("content")
    window = F.substring(F.col("content"), F.greatest(size - max_bytes, F.lit(0)) + 1, F.lit(max_bytes))
    return _last_lines(files.withColumns({"__tail": window, "__short": size <= max_bytes}), n)


def tail_file_lines(files: DataFrame, n: int, max_bytes: int = 64 * 1024) -> DataFrame:
    """``tail_lines`` of listed files (case_id, os_path, size): only the last ``max_bytes`` of each are read, whatever its size."""
    read = last_bytes(files, max_bytes).where(F.col("error").isNull())
    return _last_lines(read.withColumns({"__tail": F.col("content"), "__short": F.col("size") <= max_bytes}), n)


def _last_lines(tails: DataFrame, n: int) -> DataFrame:
    cut = tails.withColumn("__cut", ~F.col("__short") & ~F.hex(F.substring("__tail", 1, 1)).isin("0A", "0D"))
    rows = explode_lines(cut.withColumn("__text", text.utf8_lossy(F.col("__tail"))), F.col("__text"), *FILE_KEYS, "__cut")
    rows = rows.where(~(F.col("__cut") & (F.col("line_no") == 1)))
    # at most max_bytes per file reach this window
    w = Window.partitionBy(*FILE_KEYS).orderBy(F.desc("line_no"))
    ranked = rows.withColumn("from_end", F.row_number().over(w).cast("bigint")).where(F.col("from_end") <= n)
    return ranked.select(*FILE_KEYS, "from_end", "line")
