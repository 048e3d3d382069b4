import math

import pytest
from pyspark.sql import functions as F

from casework.functions import binary, flags, paths, registry as reg, text, time
from casework.operators.lines import bash_marker, zsh_line


def value(spark, column, **cells):
    """Result of a column over one row of Python values."""
    types = {str: "string", int: "bigint", float: "double", bytes: "binary", bytearray: "binary", bool: "boolean"}
    ddl = ", ".join(f"{k} {types[type(v)]}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], ddl).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "ticks,expected",
    [
        (132537600000000000, "2020-12-30T00:00:00.000000000Z"),
        (132537600000000001, "2020-12-30T00:00:00.000000100Z"),
        (116444736000000000, None), (0, None), (-5, None),
    ],
)
def test_filetime(spark, ticks, expected):
    assert value(spark, time.filetime_text(F.col("v")), v=ticks) == expected


def test_filetime_beyond_signed_range(spark):
    wide = F.lit("18446744073709551615").cast("decimal(20,0)")
    assert value(spark, time.filetime_text(wide), v=1) == "+60056-05-28T05:36:10.955161500Z"


def test_other_epochs(spark):
    assert value(spark, time.webkit_text(F.col("v")), v=13253760000000000) == "2020-12-30T00:00:00.000000000Z"
    assert value(spark, time.unix_us_text(F.col("v")), v=1609286400000001) == "2020-12-30T00:00:00.000001000Z"
    assert value(spark, time.unix_s_text(F.col("v")), v=1714929600) == "2024-05-05T17:20:00Z"
    assert value(spark, time.unix_s_text(F.col("v")), v=99999999999999) is None
    assert value(spark, time.cocoa_text(F.col("v")), v=0.5) == "2001-01-01T00:00:00.500000000Z"
    assert value(spark, time.cocoa_text(F.col("v")), v=-1.5) == "2000-12-31T23:59:59.000000000Z"
    assert value(spark, time.cocoa_text(F.col("v")), v=0.0) is None


def test_text_does_not_depend_on_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 on this day does not exist in that zone
        assert value(spark, time.unix_s_text(F.col("v")), v=1710037800) == "2024-03-10T02:30:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "line,raw,utc,assumption",
    [
        ("2026-04-27T09:00:26.649 x", "2026-04-27T09:00:26.649", None, "local_time_unspecified"),
        ("2026-04-27 09:00:26Z x", "2026-04-27 09:00:26Z", "2026-04-27T09:00:26+00:00", None),
        ("2026-04-27T00:10:00.5-02:30 x", "2026-04-27T00:10:00.5-02:30", "2026-04-27T02:40:00.500+00:00", None),
        ("2026-01-01T00:10:00.1234567891+01:00", "2026-01-01T00:10:00.1234567891+01:00", "2025-12-31T23:10:00.123456789+00:00", None),
        ("4/7/2026 09:00:26 x", "4/7/2026 09:00:26", None, "local_time_unspecified"),
        ("4-7/2026 09:00:26 x", "4-7/2026 09:00:26", None, "unparsed_timestamp"),
        ("2026-13-27T09:00:26 x", "2026-13-27T09:00:26", None, "unparsed_timestamp"),
        ("no time", None, None, None),
    ],
)
def test_log_time(spark, line, raw, utc, assumption):
    r = value(spark, time.mplog_time(F.col("v")), v=line)
    assert (r.raw, r.utc, r.assumption) == (raw, utc, assumption)


def test_decode_text(spark):
    def decoded(data):
        return tuple(value(spark, text.decode_text(F.col("v")), v=bytearray(data)))

    assert decoded(b"\xef\xbb\xbfabc") == ("abc", "utf-8-bom", False)
    assert decoded(b"\xef\xbb\xbfa\xff") == ("a�", "utf-8-bom", True)
    assert decoded(b"\xff\xfe" + "2026\r\n".encode("utf-16le")) == ("2026\r\n", "utf-16le-bom", False)
    assert decoded(("x" * 120).encode("utf-16le"))[1] == "utf-16le"
    assert decoded(b"abc\xffd") == ("abc�d", "utf-8-lossy", True)
    assert decoded(b"") == ("", "utf-8", False)


@pytest.mark.parametrize(
    "data", [b"a\0\x00\xd8b\0", b"\x00\xdca\0", "a😀b".encode("utf-16le"), b"\x3d\xd8\x3d\xd8\x00\xdea\0", b"a\0b", b"\x00\xd8"]
)
def test_utf16_repairs_lone_surrogates(spark, data):
    whole = data[: len(data) // 2 * 2]
    expected = whole.decode("utf-16le", "surrogatepass")
    expected = "".join("�" if 0xD800 <= ord(c) <= 0xDFFF else c for c in expected)
    assert value(spark, text.utf16(F.col("v")), v=bytearray(data)) == expected


def test_terminated_strings(spark):
    assert value(spark, text.utf16z(F.col("v")), v=bytearray("ab\0cd".encode("utf-16le"))) == "ab"
    assert value(spark, text.asciiz(F.col("v")), v=bytearray(b"ab\0cd")) == "ab"
    assert value(spark, text.asciiz(F.col("v")), v=bytearray(b"abcd")) == "abcd"


def test_binary_fields(spark):
    data = bytearray(range(1, 33))
    for off, width in ((0, 2), (3, 4), (8, 8)):
        expected = int.from_bytes(data[off:off + width], "little")
        assert value(spark, binary.le_uint(F.col("v"), off, width), v=data) == expected
    assert value(spark, binary.le_uint(F.col("v"), 0, 8), v=bytearray(b"\xff" * 8)) == 2**64 - 1
    assert value(spark, binary.file_ref(F.col("v"), 0, 16), v=bytearray(range(16, 0, -1))) == "0x0102030405060708090A0B0C0D0E0F10"
    assert value(spark, binary.sha256_hex(F.col("v")), v=bytearray(b"abc")).startswith("ba7816bf")


def test_flags(spark):
    assert value(spark, flags.decode_flags(F.col("v"), flags.REASON), v=0x80000100) == ["FILE_CREATE", "CLOSE"]
    assert value(spark, flags.decode_flags(F.col("v"), flags.REASON), v=0x8) is None
    assert value(spark, flags.decode_flags(F.col("v"), flags.ATTRIBUTE_LOWER), v=0x400010) == ["directory", "recall_on_data_access"]


@pytest.mark.parametrize("raw,name", [("Windows.NTFS.Usn Journal", "windows-ntfs-usn-journal"), (" __ ", "artifact"), ("Ä.b", "b")])
def test_sanitize_name(spark, raw, name):
    assert value(spark, text.sanitize_name(F.col("v")), v=raw) == name


def test_sanitize_component(spark):
    assert value(spark, text.sanitize_component(F.col("v"), "f"), v="A b._-c!!d.") == "a-b.c-d"
    assert value(spark, text.sanitize_component(F.col("v"), "f"), v="...") == "f"


@pytest.mark.parametrize(
    "raw,app",
    [
        ('{"application": ["x"]}', "x"), ('["y", 1]', "y"), ("[1]", "1"), ("[null]", "null"), ("[]", "[]"), ("plain", "plain"),
        ("", ""), ('{"a":1}', '{"a":1}'), ('[{"b":2}]', '{"b":2}'), ('"s"', '"s"'),
    ],
)
def test_app_from_json(spark, raw, app):
    assert value(spark, text.app_from_json(F.col("v")), v=raw) == app


@pytest.mark.parametrize(
    "path,windows,linux,context",
    [
        (r"C:\Users\Ann\x", "Ann", "", "Ann"), ("C/Users/a/Users/b/c", "b", "", "a"), ("/home/bob/home/x/.bash_history", "", "bob", None),
        ("/root/.zsh_history", "", "root", None), ("C/Documents and Settings/Old/y", "Old", "", None),
        ("C/Windows/ServiceProfiles/LocalService/NTUSER.DAT", "", "", "LocalService"), ("Users", "", "", None),
    ],
)
def test_users_of_paths(spark, path, windows, linux, context):
    assert value(spark, paths.windows_user(F.col("v")), v=path) == windows
    assert value(spark, paths.linux_user(F.col("v")), v=path) == linux
    assert value(spark, paths.hive_context(F.col("v")), v=path) == context


@pytest.mark.parametrize("path,ok", [("a/./b", "a/b"), ("../x", None), ("/x", None), ("C:/x", None), ("", None), ("a/b/", "a/b")])
def test_guard_path(spark, path, ok):
    assert value(spark, paths.guard_path(F.col("v")), v=path).path == ok


def test_volume_labels(spark):
    for raw, label in {"c:": "C", "\\\\?\\d:": "D", "cd": None, "": None, "1": None}.items():
        assert value(spark, paths.volume_label(F.col("v")), v=raw) == label
    assert value(spark, paths.drive_volume(F.col("v")), v="\\\\.\\e:\\") == "E:"
    assert value(spark, paths.manifest_path(F.col("v"), F.lit("windows_prefetch")), v="c:") == "$metadata/collectors/C/windows_prefetch/manifest.json"


@pytest.mark.parametrize(
    "role,key,path,parent",
    [
        ("usrclass", r"\S-1-5-21-1_Classes\Local\X", r"HKU\S-1-5-21-1_Classes\Local\X", r"\S-1-5-21-1_Classes\Local"),
        ("software", r"\ROOT\Microsoft", r"HKLM\SOFTWARE\Microsoft", r"\ROOT"), ("ntuser", r"\ROOT\Control", r"HKCU\Control", r"\ROOT"),
        ("ntuser", "", "HKCU", None), ("registry", r"\x", "x", None),
    ],
)
def test_registry_paths(spark, role, key, path, parent):
    assert value(spark, reg.registry_path(F.col("r"), F.col("k")), r=role, k=key) == path
    assert value(spark, reg.parent_key(F.col("k")), k=key) == parent


def test_registry_values(spark):
    for raw, (size, resident) in {0x80000000: (0, True), 0x80000004: (4, True), 12: (12, False)}.items():
        assert value(spark, reg.value_size(F.col("v")), v=raw) == size
        assert value(spark, reg.is_resident(F.col("v")), v=raw) == resident
    assert value(spark, reg.root_sid(F.col("k")), k=r"\S-1-5-21-9_Classes\a") == "S-1-5-21-9"
    assert value(spark, reg.unwrap_value(F.col("v"), F.lit(False)), v='{"U32": 5}') == "5"
    assert value(spark, reg.unwrap_value(F.col("v"), F.lit(False)), v='"None"') is None
    assert value(spark, reg.unwrap_value(F.col("v"), F.lit(True)), v='"x"') is None


def test_history_lines(spark):
    assert value(spark, bash_marker(F.col("v")), v="#1714929600") == "2024-05-05T17:20:00Z"
    assert value(spark, bash_marker(F.col("v")), v="#0") is None
    assert tuple(value(spark, zsh_line(F.col("v")), v=": 1714929600:0;ls -la")) == ("2024-05-05T17:20:00Z", "ls -la")
    assert value(spark, zsh_line(F.col("v")), v=": x:0;ls") is None


def test_whitespace_is_unicode(spark):
    assert value(spark, text.strip(F.col("v")), v="\u2003\u00a0a b\u3000\t") == "a b"
    assert math.isclose(len(text.WHITESPACE), 25)
