"""Scalar functions: timestamps, text, bytes, flags, paths, registry values."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.views import cte, literal, read, view
from casework.functions import binary, flags, paths, registry as reg, text, time
from casework.operators.browser import visit_source_name
from casework.operators.lines import zsh_line

# ---- timestamps --------------------------------------------------------------------------

_US = "(1704067200000000 + event_id * 261987654)"
_ISO = "strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.%f')"


def _events(spark, sf):
    return read(spark, sf, "events").withColumn("us", F.expr(_US))


@query(
    "tim_1_filetime",
    f"""SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN {_US} END AS micros,
        CASE WHEN event_id % 11 <> 0 THEN {_ISO.format(us=_US)} || CAST(event_id % 10 AS VARCHAR) || '00Z' END AS text
        FROM events""",
)
def tim_1(spark, sf):
    ft = F.when(F.col("event_id") % 11 == 0, F.col("event_id") - 50).otherwise(
        F.col("us") * 10 + F.col("event_id") % 10 + time.FILETIME_UNIX_EPOCH
    )
    df = _events(spark, sf).withColumn("ft", ft)
    return df.select("event_id", F.unix_micros(time.filetime_to_ts(F.col("ft"))).alias("micros"), time.filetime_text(F.col("ft")).alias("text"))


@query(
    "tim_2_webkit",
    f"""SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN {_US} END AS micros,
        CASE WHEN event_id % 11 <> 0 THEN {_ISO.format(us=_US)} || '000Z' END AS text FROM events""",
)
def tim_2(spark, sf):
    wk = F.when(F.col("event_id") % 11 == 0, -F.col("event_id")).otherwise(F.col("us") + time.WEBKIT_UNIX_EPOCH)
    df = _events(spark, sf).withColumn("wk", wk)
    return df.select("event_id", F.unix_micros(time.webkit_to_ts(F.col("wk"))).alias("micros"), time.webkit_text(F.col("wk")).alias("text"))


@query(
    "tim_3_unix_micros",
    f"""SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN {_US} END AS micros,
        CASE WHEN event_id % 11 <> 0 THEN {_ISO.format(us=_US)} || '000Z' END AS text FROM events""",
)
def tim_3(spark, sf):
    v = F.when(F.col("event_id") % 11 == 0, F.lit(0)).otherwise(F.col("us"))
    df = _events(spark, sf).withColumn("v", v)
    return df.select("event_id", F.unix_micros(time.unix_us_to_ts(F.col("v"))).alias("micros"), time.unix_us_text(F.col("v")).alias("text"))


@query(
    "tim_4_unix_seconds",
    """SELECT o_orderkey, CASE WHEN o_orderkey > 5 THEN strftime(make_timestamp(o_orderkey * 98765 * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS text
       FROM orders""",
)
def tim_4(spark, sf):
    s = F.when(F.col("o_orderkey") > 5, F.col("o_orderkey") * 98765).otherwise(F.lit(-3) + 0 * F.col("o_orderkey"))
    return read(spark, sf, "orders").select("o_orderkey", time.unix_s_text(s).alias("text"))


@query(
    "tim_5_cocoa",
    """SELECT event_id,
        CASE WHEN event_id % 7 = 0 THEN NULL
             WHEN event_id % 7 = 1 THEN strftime(make_timestamp((978307200 - event_id) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000000000Z'
             ELSE strftime(make_timestamp((978307200 + event_id * 1000) * 1000000), '%Y-%m-%dT%H:%M:%S') ||
                  CASE WHEN event_id % 2 = 0 THEN '.250000000Z' ELSE '.000000000Z' END END AS text,
        CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN (978307200 - event_id) * 1000000
             ELSE (978307200 + event_id * 1000) * 1000000 + CASE WHEN event_id % 2 = 0 THEN 250000 ELSE 0 END END AS micros
       FROM events""",
)
def tim_5(spark, sf):
    e = F.col("event_id")
    # negative values carry a fraction, which counts as zero
    v = F.when(e % 7 == 0, F.lit(0.0)).when(e % 7 == 1, -e - 0.5).otherwise(e * 1000 + F.when(e % 2 == 0, 0.25).otherwise(0.0))
    df = read(spark, sf, "events").select("event_id", v.alias("v"))
    return df.select("event_id", time.cocoa_text(F.col("v")).alias("text"), F.unix_micros(time.cocoa_to_ts(F.col("v"))).alias("micros"))


_TS = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?|\d{1,2}[-/]\d{1,2}[-/]\d{4}\s+\d{2}:\d{2}:\d{2}(\.\d+)?)"
MPLOG_TIME_COLUMNS = f"""
    nullif(regexp_extract(line, '{_TS}', 1), '') AS raw,
    CASE WHEN event_id % 8 = 3 THEN
        strftime(date_trunc('second', ts) - INTERVAL 150 MINUTE, '%Y-%m-%dT%H:%M:%S') ||
        CASE WHEN event_id % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END || '+00:00' END AS utc,
    CASE WHEN event_id % 8 IN (0, 1, 6) THEN 'local_time_unspecified' END AS assumption,
    CASE WHEN regexp_matches(line, '{_TS}') THEN ltrim(substring(line, length(regexp_extract(line, '{_TS}', 1)) + 1)) ELSE line END AS rest"""


@query("tim_6_log_time", cte("v_log") + f" SELECT event_id, {MPLOG_TIME_COLUMNS} FROM v_log")
def tim_6(spark, sf):
    df = time.with_log_time(view(spark, sf, "v_log"), "line", "t")
    return df.select("event_id", "t.*")


# ---- text and bytes ----------------------------------------------------------------------


def _encoded(spark, sf):
    """Document text as bytes in one of five encodings."""
    docs = read(spark, sf, "documents")
    utf8, utf16 = F.encode("text", "UTF-8"), F.encode("text", "UTF-16LE")
    # short UTF-16 texts without a mark hold too few NUL bytes to be told from UTF-8
    k = F.when((F.col("doc_id") % 5 == 3) & (F.char_length("text") < 150), 0).otherwise(F.col("doc_id") % 5)
    content = (
        F.when(k == 0, utf8)
        .when(k == 1, F.unhex(F.concat(F.lit("EFBBBF"), F.hex(utf8))))
        .when(k == 2, F.unhex(F.concat(F.lit("FFFE"), F.hex(utf16))))
        .when(k == 3, utf16)
        .otherwise(F.unhex(F.concat(F.hex(utf8), F.lit("FF"))))
    )
    return docs.select("doc_id", "text", content.alias("content"))


@query(
    "txt_1_decode_text",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN md5(text || chr(65533)) ELSE md5(text) END AS text_md5,
        CASE doc_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-bom' WHEN 2 THEN 'utf-16le-bom'
             WHEN 3 THEN CASE WHEN length(text) >= 150 THEN 'utf-16le' ELSE 'utf-8' END ELSE 'utf-8-lossy' END AS encoding,
        doc_id % 5 = 4 AS lossy FROM documents""",
)
def txt_1(spark, sf):
    out = _encoded(spark, sf).select("doc_id", text.decode_text(F.col("content")).alias("d"))
    return out.select("doc_id", F.md5("d.text").alias("text_md5"), "d.encoding", "d.lossy")


@query(
    "txt_2_terminated_text",
    """SELECT doc_id, md5(text) AS wide_md5, md5(text) AS narrow_md5, 'a' || chr(65533) || 'b' AS repaired
       FROM documents""",
)
def txt_2(spark, sf):
    docs = read(spark, sf, "documents")
    wide = F.unhex(F.concat(F.hex(F.encode("text", "UTF-16LE")), F.lit("0000610062")))
    narrow = F.unhex(F.concat(F.hex(F.encode("text", "UTF-8")), F.lit("006162")))
    lone = F.unhex(F.concat(F.lit("610000D8"), F.lit("6200"), F.substring(F.hex(F.encode("lang", "UTF-8")), 1, 0)))
    df = docs.select("doc_id", wide.alias("w"), narrow.alias("n"), lone.alias("l"))
    return df.select("doc_id", F.md5(text.utf16z(F.col("w"))).alias("wide_md5"), F.md5(text.asciiz(F.col("n"))).alias("narrow_md5"), text.utf16z(F.col("l")).alias("repaired"))


def le_bytes(value, width: int):
    """Hex of an integer in little-endian bytes."""
    h = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))])


@query(
    "bin_1_le_uint",
    """SELECT event_id, event_id % 65536 AS u16, event_id * 400000 % 4294967296 AS u32, event_id * 12345678901 AS u64 FROM events""",
)
def bin_1(spark, sf):
    e = F.col("event_id")
    b = F.unhex(F.concat(le_bytes(e % 65536, 2), le_bytes(e * 400000 % 4294967296, 4), le_bytes(e * 12345678901, 8)))
    df = read(spark, sf, "events").select("event_id", b.alias("b"))
    return df.select(
        "event_id", binary.le_uint(F.col("b"), 0, 2).alias("u16"), binary.le_uint(F.col("b"), 2, 4).alias("u32"),
        binary.le_uint(F.col("b"), 6, 8).cast("bigint").alias("u64"),
    )


@query("bin_2_hex", "SELECT doc_id, md5(lower(hex(encode(text)))) AS hex_md5 FROM documents")
def bin_2(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(binary.to_hex(F.encode("text", "UTF-8"))).alias("hex_md5"))


@query("bin_3_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def bin_3(spark, sf):
    return read(spark, sf, "documents").select("doc_id", binary.sha256_hex(F.encode("text", "UTF-8")).alias("sha256"))


@query(
    "bin_4_file_reference",
    """SELECT event_id, '0x' || lpad(hex(event_id * 98765432101), 16, '0') AS ref64,
        '0x' || lpad(hex(user_id), 16, '0') || lpad(hex(event_id * 98765432101), 16, '0') AS ref128 FROM events""",
)
def bin_4(spark, sf):
    b = F.unhex(F.concat(le_bytes(F.col("event_id") * 98765432101, 8), le_bytes(F.col("user_id"), 8)))
    df = read(spark, sf, "events").select("event_id", b.alias("b"))
    return df.select("event_id", binary.file_ref(F.col("b"), 0, 8).alias("ref64"), binary.file_ref(F.col("b"), 0, 16).alias("ref128"))


# ---- flags -------------------------------------------------------------------------------


def flags_sql(mask: str, table: dict[int, str]) -> str:
    cases = ", ".join(f"CASE WHEN ({mask}) & {bit} <> 0 THEN '{name}' END" for bit, name in table.items())
    return f"nullif(concat_ws(',', {cases}), '')"


_MASK = "(event_id * 2654435761 % 4294967296) & (CASE WHEN event_id % 9 = 0 THEN 0 ELSE 4294967295 END)"


@query(
    "flg_1_flag_names",
    f"""SELECT event_id, {flags_sql(_MASK, flags.REASON)} AS reason_flags, {flags_sql(_MASK, flags.SOURCE)} AS source_flags,
        {flags_sql(_MASK, flags.ATTRIBUTE)} AS attribute_flags FROM events""",
)
def flg_1(spark, sf):
    df = read(spark, sf, "events").select("event_id", F.expr(_MASK).alias("m"))
    return df.select(
        "event_id",
        *[
            F.array_join(flags.decode_flags(F.col("m"), t), ",").alias(n)
            for n, t in (("reason_flags", flags.REASON), ("source_flags", flags.SOURCE), ("attribute_flags", flags.ATTRIBUTE))
        ],
    )


@query("flg_2_lower_attributes", f"SELECT event_id, {flags_sql(_MASK, flags.ATTRIBUTE_LOWER)} AS attribute_flags FROM events")
def flg_2(spark, sf):
    df = read(spark, sf, "events").select("event_id", F.expr(_MASK).alias("m"))
    return df.select("event_id", F.array_join(flags.decode_flags(F.col("m"), flags.ATTRIBUTE_LOWER), ",").alias("attribute_flags"))


# ---- strings -----------------------------------------------------------------------------


@query(
    "str_1_sanitize_name",
    r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(translate(trim(html), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'artifact') AS name
       FROM pages""",
)
def str_1(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.sanitize_name(F.col("html")).alias("name"))


@query(
    "str_2_sanitize_component",
    r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(translate(trim(url), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9._-]', '-', 'g'), '([._-])[._-]+', '\1', 'g'), '-_.'), ''), 'host') AS component
       FROM pages""",
)
def str_2(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.sanitize_component(F.col("url"), "host").alias("component"))


@query(
    "str_3_snake_case",
    "SELECT c_custkey, trim(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') AS snake FROM customer",
)
def str_3(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", text.to_snake(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("snake"))


_KEY_NAMES = [*text.FIELD_ALIASES, "Some Other.Key", "VFZ lofi/sample"]
_KEY_CASE = "CASE event_id % {n} ".format(n=len(_KEY_NAMES)) + " ".join(f"WHEN {i} THEN ' {k.upper()}'" for i, k in enumerate(_KEY_NAMES)) + " END"
_KEY_EXPECTED = [*text.FIELD_ALIASES.values(), "some_other_key", "vfz_lofi_sample"]


@query(
    "str_4_field_key",
    "SELECT event_id, CASE event_id % {n} ".format(n=len(_KEY_NAMES)) + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KEY_EXPECTED)) + " END AS key FROM events",
)
def str_4(spark, sf):
    return read(spark, sf, "events").select("event_id", text.field_key(F.expr(_KEY_CASE)).alias("key"))


@query("str_5_field_value", "SELECT event_id, props AS value FROM events")
def str_5(spark, sf):
    return read(spark, sf, "events").select("event_id", text.field_value(F.concat(F.lit(' ""'), "props", F.lit('" '))).alias("value"))


@query(
    "str_6_application",
    r"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'app' || CAST(user_id AS VARCHAR) WHEN 1 THEN props WHEN 2 THEN replace(props, ' ', '')
        WHEN 3 THEN 'raw ' || event_type WHEN 4 THEN '' WHEN 5 THEN CAST(user_id AS VARCHAR) ELSE '[]' END AS application FROM events""",
)
def str_6(spark, sf):
    e = F.col("event_id") % 7
    doc = (
        F.when(e == 0, F.concat(F.lit('{"application": ["app'), "user_id", F.lit('", "x"]}')))
        .when(e == 1, F.col("props"))
        .when(e == 2, F.concat(F.lit("["), "props", F.lit(", 1]")))
        .when(e == 3, F.concat(F.lit("raw "), "event_type"))
        .when(e == 4, F.lit(""))
        .when(e == 5, F.concat(F.lit("["), "user_id", F.lit("]")))
        .otherwise(F.lit("[]"))
    )
    return read(spark, sf, "events").select("event_id", text.app_from_json(doc).alias("application"))


@query(
    "str_7_visit_source",
    """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'Synced' WHEN 2 THEN 'Extension' WHEN 3 THEN 'ImportFromFirefox'
        WHEN 4 THEN 'ImportFromSafari' WHEN 6 THEN 'ImportFromChromeOrEdge' WHEN 7 THEN 'ImportFromEdgeHTML' ELSE 'Local' END AS source FROM orders""",
)
def str_7(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", visit_source_name(F.col("o_orderkey") % 9).alias("source"))


@query(
    "str_8_zsh_line",
    cte("v_shell")
    + r""" SELECT line_no, CASE WHEN regexp_matches(line, '^: [0-9]+:[^;]*;') THEN
        strftime(make_timestamp(CAST(regexp_extract(line, '^: ([0-9]+):', 1) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS ts,
        nullif(regexp_extract(line, '^: [0-9]+:[^;]*;(.*)$', 1), '') AS command FROM v_shell""",
)
def str_8(spark, sf):
    df = view(spark, sf, "v_shell").select("line_no", zsh_line(F.col("line")).alias("z"))
    return df.select("line_no", "z.ts", "z.command")


# ---- paths -------------------------------------------------------------------------------


def path_query(name: str, column, sql: str) -> None:
    oracle = cte("v_paths") + f" SELECT event_id, {sql} AS value FROM (SELECT event_id, user_id, os_path, replace(os_path, chr(92), '/') AS p FROM v_paths)"
    query(name, oracle)(lambda spark, sf: view(spark, sf, "v_paths").select("event_id", column(F.col("os_path")).alias("value")))


path_query("pth_1_normalise_path", paths.norm_path, "lower(p)")
path_query(
    "pth_3_windows_user", paths.windows_user,
    "coalesce(list_extract(string_split(p, '/'), list_position(list_transform(string_split(p, '/'), lambda s: lower(s) IN ('users', 'documents and settings')), true) + 1), '')"
    .replace("list_position(", "nullif(list_position(").replace(", true) + 1", ", true), 0) + 1"),
)
path_query("pth_4_mac_user", paths.mac_user, "coalesce(lower(regexp_extract(p, '(?i)(^|/)users/([^/]*)', 2)), '')")
path_query(
    "pth_5_linux_user", paths.linux_user,
    "CASE WHEN regexp_matches(p, '(^|/)home/') THEN regexp_extract(p, '(^|/)home/([^/]*)', 2) WHEN contains(p, '/root/') THEN 'root' ELSE '' END",
)
path_query("pth_6_hive_context", paths.hive_context, "nullif(regexp_extract(p, '(?i)(^|/)(users|serviceprofiles)/([^/]*)', 3), '')")
path_query(
    "pth_7_shell_name", paths.shell_name,
    "regexp_replace(ltrim(regexp_extract(p, '[^/]*$', 0), '.'), '(_history)+$', '')",
)
path_query(
    "pth_11_appid_candidate",
    lambda c: paths.appid_candidate(paths.file_name(c), ".automaticDestinations-ms"),
    "regexp_replace(regexp_extract(p, '[^/]*$', 0), '(?i)[.]automaticdestinations-ms$', '')",
)

_GUARDED = {0: "./a@U/b@E", 1: "a/../b@E", 2: "/abs@E", 3: "C:/x@E", 4: ".", 5: r"u@U\\x@E/", 6: "x@E/./y"}


@query(
    "pth_2_guard_path",
    "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'a' || user_id || '/b' || event_id WHEN 5 THEN 'u' || user_id || '/x' || event_id WHEN 6 THEN 'x' || event_id || '/y' END AS path, "
    "CASE WHEN event_id % 7 IN (1, 2, 3) THEN 'escapes archive root' WHEN event_id % 7 = 4 THEN 'empty path' END AS error FROM events",
)
def pth_2(spark, sf):
    case = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {literal(t)}" for i, t in _GUARDED.items()) + " END"
    return read(spark, sf, "events").select("event_id", paths.guard_path(F.expr(case)).alias("g")).select("event_id", "g.*")


_VOLUMES = {0: "c:", 1: r"\\?\d:", 2: " E ", 3: "cd:", 4: "", 5: "f"}


@query(
    "pth_8_volume_label",
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'E' WHEN 5 THEN 'F' END AS label FROM events",
)
def pth_8(spark, sf):
    case = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {literal(t)}" for i, t in _VOLUMES.items()) + " END"
    return read(spark, sf, "events").select("event_id", paths.volume_label(F.expr(case)).alias("label"))


@query(
    "pth_9_manifest_path",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '$metadata/collectors/C/windows_' || event_type || '/manifest.json' END AS path FROM events",
)
def pth_9(spark, sf):
    volume = F.when(F.col("event_id") % 2 == 0, "c:").otherwise("volume")
    return read(spark, sf, "events").select("event_id", paths.manifest_path(volume, F.concat(F.lit("windows_"), "event_type")).alias("path"))


# ---- registry ----------------------------------------------------------------------------

ROLE_SQL = """CASE page_id % 11 WHEN 0 THEN 'ntuser' WHEN 1 THEN 'usrclass' WHEN 2 THEN 'amcache' WHEN 3 THEN 'sam' WHEN 4 THEN 'security'
    WHEN 5 THEN 'software' WHEN 6 THEN 'system' WHEN 7 THEN 'default' WHEN 8 THEN 'settings' WHEN 9 THEN 'registry' ELSE 'drvindex' END"""
SEG_SQL = "list_filter(string_split(key_path, chr(92)), lambda s: s <> '')"
SID_SQL = f"CASE WHEN {SEG_SQL}[1] LIKE 'S-1-%' THEN regexp_replace({SEG_SQL}[1], '_Classes$', '') END"
ROOT_SQL = f"""CASE role WHEN 'ntuser' THEN CASE WHEN {SEG_SQL}[1] = 'ROOT' THEN 'HKCU' ELSE 'HKU' || chr(92) || {SEG_SQL}[1] END
    WHEN 'usrclass' THEN 'HKU' || chr(92) || {SEG_SQL}[1] WHEN 'amcache' THEN 'HKLM' || chr(92) || 'Amcache'
    WHEN 'default' THEN 'HKU' || chr(92) || '.DEFAULT' WHEN 'settings' THEN 'Settings' || chr(92) || {SEG_SQL}[1]
    WHEN 'drvindex' THEN 'DrvIndex' || chr(92) || {SEG_SQL}[1] WHEN 'registry' THEN {SEG_SQL}[1]
    ELSE 'HKLM' || chr(92) || upper(role) END"""
PATH_SQL = f"{ROOT_SQL} || chr(92) || array_to_string({SEG_SQL}[2:], chr(92))"
MAPPING_SQL = f"""CASE role WHEN 'ntuser' THEN CASE WHEN {SID_SQL} IS NULL THEN 'HKCU' ELSE 'HKU' || chr(92) || '<SID>' END
    WHEN 'usrclass' THEN CASE WHEN {SID_SQL} IS NOT NULL THEN 'HKU' || chr(92) || '<SID>_Classes' END
    WHEN 'amcache' THEN 'HKLM' || chr(92) || 'Amcache' WHEN 'default' THEN 'HKU' || chr(92) || '.DEFAULT'
    WHEN 'settings' THEN 'Settings' WHEN 'drvindex' THEN 'DrvIndex' WHEN 'registry' THEN NULL ELSE 'HKLM' || chr(92) || upper(role) END"""
PARENT_SQL = "nullif(array_to_string(list_slice(string_split(rtrim(key_path, chr(92)), chr(92)), 1, len(string_split(rtrim(key_path, chr(92)), chr(92))) - 1), chr(92)), '')"


def key_query(name: str, column, sql: str) -> None:
    oracle = cte("v_keys") + f" SELECT key_id, {sql} AS value FROM (SELECT *, {ROLE_SQL.replace('page_id', 'key_id')} AS role FROM v_keys)"

    def run(spark, sf):
        df = view(spark, sf, "v_keys").withColumn("role", reg.hive_role(F.col("hive_name")))
        return df.select("key_id", column(F.col("role"), F.col("key_path")).alias("value"))

    query(name, oracle)(run)


key_query("reg_1_registry_path", reg.registry_path, PATH_SQL)
key_query("reg_2_root_sid", lambda r, k: reg.root_sid(k), SID_SQL)
key_query("reg_3_parent_key", lambda r, k: reg.parent_key(k), PARENT_SQL)
key_query("reg_4_hive_mapping", lambda r, k: reg.hive_mapping(r, reg.root_sid(k)), MAPPING_SQL)
key_query("reg_5_hive_role", lambda r, k: r, "role")


@query(
    "reg_6_sentinels",
    """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_id END AS u32, CASE WHEN event_id % 5 <> 0 THEN event_id END AS i32,
        event_id % 3 = 0 AS resident, event_id % 5000 AS size FROM events""",
)
def reg_6(spark, sf):
    e = F.col("event_id")
    size = e % 5000 + F.when(e % 3 == 0, F.lit(0x80000000)).otherwise(F.lit(0))
    return read(spark, sf, "events").select(
        "event_id",
        reg.null_sentinel(F.when(e % 4 == 0, F.lit(0xFFFFFFFF)).otherwise(e), 0xFFFFFFFF).alias("u32"),
        reg.null_sentinel(F.when(e % 5 == 0, F.lit(-1)).otherwise(e), -1).alias("i32"),
        reg.is_resident(size).alias("resident"), reg.value_size(size).alias("size"),
    )


@query(
    "reg_7_unwrap_value",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN regexp_extract(props, '[0-9]+', 0) WHEN 2 THEN NULL
        WHEN 3 THEN '"' || event_type || '"' ELSE '{"a":1,"b":2}' END AS value FROM events""",
)
def reg_7(spark, sf):
    e = F.col("event_id") % 5
    decoded = (
        F.when(e <= 1, F.col("props")).when(e == 2, F.lit('"None"')).when(e == 3, F.concat(F.lit('"'), "event_type", F.lit('"')))
        .otherwise(F.lit('{"a":1,"b":2}'))
    )
    return read(spark, sf, "events").select("event_id", reg.unwrap_value(decoded, e == 0).alias("value"))
