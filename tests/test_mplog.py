import random

import pytest
from pyspark.sql import functions as F

from casework.operators import mplog

SAMPLE = [
    '2026-04-27T09:00:26.649 Engine:Setting original file name "dw" for "c:\\program files\\x\\dw.dll", hr=0x0',
    "2026-04-27T11:47:30.775 [RTP] [MpRtp] Engine VFZ lofi/sample/expensive: \\Device\\HarddiskVolume4\\Users\\j\\O.exe. status=0x40050000, statusex=0x0, threatid=0x80000000, sigseq=0x55",
    "  C:\\Users\\j\\arete\\threat-intelligence",
    "2026-04-30T05:25:08.497 WARNING: the previous service shutdown was not expected.",
    "Beginning quarantine recovery",
    "Quarantine ID:{00000000-0000-0000-0000-000000000000}",
    "IDynamicConfig::ReportError value=MpCloudBlockLevel hr=0x8007000d",
]


def records(spark, texts):
    rows = [("c", "f", i + 1, t, "utf-8", False, "") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "case_id string, os_path string, line_no bigint, line string, encoding string, decode_lossy boolean, source_sha256 string")
    return mplog.parse_mplog_lines(df).orderBy("line_no").collect()


def test_sample(spark):
    engine, threat, warning, quarantine, ident, cloud = records(spark, SAMPLE)
    assert (engine.component, engine.event_type, engine.hresult, engine.path) == ("Engine", "Engine", "0x0", "c:\\program files\\x\\dw.dll")
    assert "c" not in engine.fields and engine.fields["original_file_name"] == "dw"
    assert (threat.component, threat.event_type, threat.threat_id) == ("RTP", "Threat", "0x80000000")
    assert threat.fields["subcomponent"] == "MpRtp" and threat.message.endswith("threat-intelligence")
    assert (warning.level, warning.event_type) == ("Warning", "Warning")
    assert (quarantine.event_type, quarantine.action) == ("Quarantine", "begin_quarantine_recovery")
    assert ident.fields["quarantine_id"] == "{00000000-0000-0000-0000-000000000000}"
    assert (cloud.component, cloud.level, cloud.event_type, cloud.hresult) == ("IDynamicConfig", "Error", "CloudProtection", "0x8007000d")
    assert cloud.fields["operation"] == "ReportError"


def test_utf16_file(spark):
    data = b"\xff\xfe" + "\r\n".join([SAMPLE[0], SAMPLE[4], ""]).encode("utf-16le")
    df = spark.createDataFrame([("c", "C/MPLog-1.log", bytearray(data))], "case_id string, os_path string, content binary")
    rows = mplog.parse_mplog(df).collect()
    assert len(rows) == 2 and {r.encoding for r in rows} == {"utf-16le-bom"} and not any(r.decode_lossy for r in rows)


def slow_scan(line):
    """Character-by-character statement of the field rules, as an independent check."""
    blanks, out, i, n = " \t\n\r\f", [], 0, len(line)

    def alpha(c):
        return c.isascii() and c.isalpha()

    def key_ok(text):
        return len(text) >= 2 and all(c.isascii() and (c.isalnum() or c in " _.-") for c in text)

    def key_at(j):
        while j < n and line[j] in blanks:
            j += 1
        if j >= n or not alpha(line[j]):
            return False
        start = j
        while j < n:
            if line[j] in "=:":
                return key_ok(line[start:j].strip())
            if line[j] in ",;\r\n":
                return False
            j += 1
        return False

    def end_of(j):
        if line[j] in '"{':
            close = line.find('"' if line[j] == '"' else "}", j + 1)
            return n if close < 0 else close + 1
        while j < n:
            if line[j] in ",;\r\n" or (line[j] in blanks and key_at(j + 1)):
                return j
            j += 1
        return n

    while i < n:
        if not alpha(line[i]):
            i += 1
            continue
        start, stop = i, None
        while i < n and line[i] not in "\r\n,;":
            if line[i] in "=:":
                stop = i
                break
            i += 1
        if stop is None:
            break
        key = line[start:stop].strip()
        if not key_ok(key):
            i = start + 1
            continue
        i = stop + 1
        while i < n and line[i] in blanks:
            i += 1
        if i >= n:
            break
        begin = i
        i = end_of(begin)
        value = line[begin:i].strip().rstrip(",").rstrip(";")
        if value:
            out.append({"key": key, "value": value})
    return out


def test_scanner_against_brute_force():
    rng = random.Random(7)
    pieces = ["key", "k", "a b", "=", ":", " ", "  ", ",", ";", '"', "{", "}", "/", "\\", "v1", "0x1", "é", "\r", "\t", "x.y-z", "hr=0", "p: q"]
    for _ in range(20000):
        line = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert mplog.scan_fields(line) == slow_scan(line), repr(line)


def test_plain_path_agrees_with_scanner(spark):
    rng = random.Random(3)
    lines = []
    for _ in range(300):
        pairs = [f"{rng.choice(['aa', 'b-c', 'hr', 'x.y'])}={rng.choice(['1', 'v-2', 'a.b', '0x'])}" for _ in range(rng.randint(1, 5))]
        lines.append("".join(p if i == 0 else rng.choice([", ", " ", "; "]) + p for i, p in enumerate(pairs)))
    df = spark.createDataFrame([(x,) for x in lines], "b string")
    out = df.select("b", mplog.raw_fields(F.col("b")).alias("f"), F.col("b").rlike(mplog.PLAIN_PAIRS).alias("plain")).collect()
    assert all(r.plain for r in out)
    assert all([x.asDict() for x in r.f] == mplog.scan_fields(r.b) for r in out)


def test_scanner_is_not_quadratic():
    import time

    start = time.time()
    mplog.scan_fields("a/b " * 50000 + "key=1")
    mplog.scan_fields("key=" + " " * 200000 + "v")
    mplog.scan_fields("key=" + "v " * 100000)
    assert time.time() - start < 10


@pytest.mark.parametrize("line,level", [("x warning y", "Warning"), ("it Failed", "Error"), ("Info: a", "Info"), ("plain", None)])
def test_level(spark, line, level):
    empty = F.from_json(F.lit("{}"), mplog.MAP)
    assert spark.range(1).select(mplog.infer_level(F.lit(line), empty).alias("l")).first().l == level
