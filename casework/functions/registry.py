"""Registry paths, roles and cell sentinels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casework.functions.text import ascii_lower

# Hive file name -> role.
HIVE_ROLES = {
    "ntuser.dat": "ntuser",
    "usrclass.dat": "usrclass",
    "amcache.hve": "amcache",
    "sam": "sam",
    "security": "security",
    "software": "software",
    "system": "system",
    "default": "default",
    "components": "components",
    "settings.dat": "settings",
    "drvindex.dat": "drvindex",
}

# Roles with one machine-wide root.
FIXED_ROOTS = {
    "software": "HKLM\\SOFTWARE",
    "system": "HKLM\\SYSTEM",
    "sam": "HKLM\\SAM",
    "security": "HKLM\\SECURITY",
    "default": "HKU\\.DEFAULT",
    "components": "HKLM\\COMPONENTS",
    "amcache": "HKLM\\Amcache",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def hive_role(name: Column) -> Column:
    return F.coalesce(_lookup(HIVE_ROLES, ascii_lower(name)), F.lit("registry"))


def _segments(key_path: Column) -> Column:
    return F.filter(F.split(key_path, r"\\"), lambda s: s != "")


def root_segment(key_path: Column) -> Column:
    return F.coalesce(F.get(_segments(key_path), F.lit(0)), F.lit(""))


def root_sid(key_path: Column) -> Column:
    """Security identifier named by the first segment, class suffix removed; null otherwise."""
    bare = F.regexp_replace(root_segment(key_path), "_Classes$", "")
    return F.when(bare.startswith("S-1-"), bare)


def registry_path(role: Column, key_path: Column) -> Column:
    """Key path with its first segment replaced by the root the hive is mounted under."""
    segments = _segments(key_path)
    first = root_segment(key_path)
    root = F.coalesce(
        _lookup(FIXED_ROOTS, role),
        F.when((role == "ntuser") & ascii_lower(first).isin("root", ""), F.lit("HKCU"))
        .when(role.isin("ntuser", "usrclass"), F.concat(F.lit("HKU\\"), first))
        .when(role == "settings", F.concat(F.lit("Settings\\"), first))
        .when(role == "drvindex", F.concat(F.lit("DrvIndex\\"), first))
        .otherwise(first),
    )
    rest = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
    return F.when(F.size(segments) > 1, F.concat(root, F.lit("\\"), F.array_join(rest, "\\"))).otherwise(root)


def parent_key(key_path: Column) -> Column:
    """Un-mapped parent path; null for a root or first-level key."""
    return F.nullif(
        F.regexp_extract(F.rtrim(key_path, F.lit("\\")), r"(?s)^(.+)\\[^\\]*$", 1), F.lit("")
    )


def hive_mapping(role: Column, sid: Column) -> Column:
    return F.coalesce(
        _lookup(FIXED_ROOTS, role),
        F.when(role == "ntuser", F.when(sid.isNotNull(), F.lit("HKU\\<SID>")).otherwise(F.lit("HKCU")))
        .when((role == "usrclass") & sid.isNotNull(), F.lit("HKU\\<SID>_Classes"))
        .when(role == "settings", F.lit("Settings"))
        .when(role == "drvindex", F.lit("DrvIndex")),
    )


def null_sentinel(c: Column, sentinel: int) -> Column:
    """Null for the value that stands for 'none': 4294967295 unsigned, -1 signed."""
    return F.nullif(c.cast("bigint"), F.lit(sentinel).cast("bigint"))


def is_resident(size_raw: Column) -> Column:
    return size_raw.cast("bigint").bitwiseAND(F.lit(0x80000000)) != 0


def value_size(size_raw: Column) -> Column:
    """Data length with the resident bit cleared."""
    wide = size_raw.cast("bigint")
    return F.when(is_resident(size_raw), wide.bitwiseXOR(F.lit(0x80000000))).otherwise(wide)


def unwrap_value(decoded: Column, is_empty: Column) -> Column:
    """JSON text of a decoded value: empty -> null, one-entry object -> its value, "None" -> null."""
    entries = F.from_json(decoded, "map<string,variant>")
    inner = F.get(F.map_values(F.when(decoded.rlike(r"(?s)^\s*\{"), entries)), F.lit(0))
    single = F.size(F.when(decoded.rlike(r"(?s)^\s*\{"), entries)) == 1
    return (
        F.when(is_empty, F.lit(None).cast("string"))
        .when(single, F.to_json(inner))
        .when(decoded == '"None"', F.lit(None).cast("string"))
        .otherwise(decoded)
    )
