"""Path normalisation, users named by a path, and path guards."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casework.functions.text import ascii_lower, null_if_empty, strip


def slashed(c: Column) -> Column:
    """Backslashes to slashes, case kept."""
    return F.replace(c, F.lit("\\"), F.lit("/"))


def norm_path(c: Column) -> Column:
    return ascii_lower(slashed(c))


def file_name(c: Column) -> Column:
    return F.substring_index(slashed(c), "/", -1)


def parent_dir(c: Column) -> Column:
    """Everything before the last separator; empty at the root."""
    return F.regexp_replace(slashed(c), "/?[^/]*$", "")


def extension(name: Column) -> Column:
    """Text after the last dot of a file name; null without one or for a pure dot-name."""
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.substring_index(name, ".", -1))


def _segment_after(c: Column, names: str, last: bool) -> Column:
    """Path segment that follows the first or last segment called one of ``names``."""
    lead = "^(?:.*/)?" if last else "^(?:.*?/)?"
    return F.regexp_extract(slashed(c), f"(?is){lead}(?:{names})/([^/]*)", 1)


def windows_user(c: Column) -> Column:
    return _segment_after(c, "Users|Documents and Settings", last=True)


def mac_user(c: Column) -> Column:
    return ascii_lower(_segment_after(c, "users", last=True))


def linux_user(c: Column) -> Column:
    """Segment after the first ``home``; else ``root`` for a path through ``/root/``."""
    path = slashed(c)
    in_home = path.rlike("(?is)(^|/)home/")
    return (
        F.when(in_home, _segment_after(c, "home", last=False))
        .when(path.contains("/root/"), F.lit("root"))
        .otherwise(F.lit(""))
    )


def hive_context(c: Column) -> Column:
    """User a hive belongs to, from the first profile root in its path; null without one."""
    inside = slashed(c).rlike("(?is)(^|/)(Users|ServiceProfiles)/")
    return F.when(inside, _segment_after(c, "Users|ServiceProfiles", last=False))


def shell_name(c: Column) -> Column:
    """``bash`` from ``.bash_history``; other names only lose what they carry of that shape."""
    return F.regexp_replace(F.ltrim(file_name(c), F.lit(".")), "(_history)+$", "")


def guard_path(c: Column) -> Column:
    """struct(path, error): archive path without ``.`` parts, or the reason it is refused."""
    parts = F.split(slashed(c), "/")
    kept = F.filter(parts, lambda p: (p != "") & (p != "."))
    escapes = (
        F.exists(parts, lambda p: p == "..")
        | slashed(c).startswith("/")
        | c.rlike(r"^[A-Za-z]:")
    )
    error = F.when(escapes, "escapes archive root").when(F.size(kept) == 0, "empty path")
    return F.struct(
        F.when(error.isNull(), F.array_join(kept, "/")).alias("path"), error.alias("error")
    )


def volume_label(c: Column) -> Column:
    """Upper-case drive letter from ``C``, ``c:`` or ``\\\\?\\C:``; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"^(\\\\\?\\)+", ""), ":+$", "")
    return F.when(bare.rlike("^[A-Za-z]$"), F.upper(bare))


def drive_volume(c: Column) -> Column:
    """``C:`` from any spelling of a source volume, device prefixes included; null if not one letter."""
    bare = F.regexp_replace(strip(c), r"[\\/]+$", "")
    bare = F.regexp_replace(bare, r"^\\\\\.\\", "")
    bare = F.regexp_replace(bare, r"^\\\\\?\\", "")
    bare = F.regexp_replace(bare, ":+$", "")
    return F.when(bare.rlike("^[A-Za-z]$"), F.concat(F.upper(bare), F.lit(":")))


def manifest_path(volume: Column, collector: Column, leaf: str = "manifest.json") -> Column:
    """Conventional place of a collector's manifest inside a package; null for a bad volume."""
    label = volume_label(volume)
    return F.when(
        label.isNotNull(),
        F.concat_ws("/", F.lit("$metadata"), F.lit("collectors"), label, collector, F.lit(leaf)),
    )


def appid_candidate(name: Column, suffix: str) -> Column:
    """File name without a jump-list suffix, whatever its case."""
    cut = F.char_length(name) - len(suffix)
    matches = ascii_lower(name).endswith(suffix.lower())
    return F.when(matches, F.substring(name, F.lit(1), cut)).otherwise(name)


def user_or_null(c: Column) -> Column:
    return null_if_empty(windows_user(c))
