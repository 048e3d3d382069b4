"""Protection-log lines: components, fields, levels, classification."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from casework.functions import text, time
from casework.functions.binary import sha256_hex
from casework.operators.lines import merge_continuations, read_lines
from casework.operators.ordered import DEFAULT_WIDTH
from casework.operators.shape import settled

# Line shapes.
_TOKEN = r"[A-Za-z][A-Za-z0-9_.-]{1,40}"
BRACKET = r"(?s)^\[([^\]]+)\]\s*(?:\[([^\]]+)\]\s*)?(.*)$"
DOUBLE_COLON = rf"(?s)^({_TOKEN})::(?:({_TOKEN})\s+)?(.*)$"
COLON = rf"(?s)^({_TOKEN}):(.*)$"
ORIGINAL_NAME = r'Setting original file name "([^"]*)" for "([A-Za-z]:\\[^"]+)"'
QUOTED_PATH = r'"([A-Za-z]:\\[^"]+)"'
DEVICE_PATH = r"(\\Device\\[^,\r\n]+)"
PLAIN_PATH = r"([A-Za-z]:\\[^,;\r\n]+)"
HRESULT = r"(?:hr|hresult)\s*=\s*(0x[0-9a-fA-F]+|\d+)"

# Fields looked up for each output column, in order.
PATH_FIELDS = ("path", "file", "filename", "resource", "target")
THREAT_NAME_FIELDS = ("threat_name", "threat", "malware")
RESULT_FIELDS = ("result", "status")
HRESULT_FIELDS = ("hresult", "error", "error_code")
ACTION_FIELDS = ("action", "remediation")

# Event labels by text, in priority order; the first hit decides.
TEXT_EVENTS = [
    ("Quarantine", ("quarantine",)),
    ("Threat", ("threat", "malware")),
    ("Detection", ("detected",)),
    ("Remediation", ("remediat", "clean")),
    ("Scan", ("scan",)),
    ("TamperProtection", ("tamper",)),
    ("CloudProtection", ("cloud", "maps")),
    ("Exclusion", ("exclusion", "excluded")),
    ("Update", ("security intelligence", "signature", "sigseq", "sigsha", "engine version",
                "platform version", "definition")),
    ("RealTimeProtection", ("[rtp]", "real-time", "realtime")),
    ("Platform", ("platform",)),
]
EVENT_FIELDS = {"Threat": ("threat_name", "threat_id"), "Scan": ("scan_request",)}
REALTIME_COMPONENTS = ("rtp", "mprtp", "mini-filter")
ERROR_WORDS = ("reporterror", "failed", "failure", "unsuccessful")
ZERO_HRESULTS = ("0", "0x0", "0x00000000")

MAP = "map<string,string>"


def _empty_map() -> Column:
    return F.from_json(F.lit("{}"), MAP)


def _one(key: str, value: Column) -> Column:
    """Map of one entry, or an empty map when the value is null."""
    return F.when(value.isNotNull(), F.create_map(F.lit(key), value)).otherwise(_empty_map())


def _first_field(fields: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_element_at(fields, F.lit(n)) for n in names])


def _has_field(fields: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(fields, name), F.lit(False))


def _group(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def _any_text(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | c.contains(word)
    return out


def component(body: Column) -> Column:
    """struct(component, level, rest, fields) of a line body; the first shape that fits wins."""
    return _component(text.lstrip(body))


def _component(b: Column) -> Column:
    levels = {"WARNING:": "Warning", "ERROR:": "Error", "INFO:": "Info"}
    none = F.lit(None).cast("string")

    def shape(comp: Column, level: Column, rest: Column, fields: Column) -> Column:
        return F.struct(
            comp.alias("component"), level.alias("level"), text.lstrip(rest).alias("rest"), fields.alias("fields")
        )

    out = None
    for prefix, level in levels.items():
        case = shape(none, F.lit(level), F.substring(b, F.lit(len(prefix) + 1), F.char_length(b)), _empty_map())
        out = F.when(b.startswith(prefix), case) if out is None else out.when(b.startswith(prefix), case)
    sub = text.null_if_empty(_group(b, BRACKET, 2))
    op = text.null_if_empty(text.field_value(_group(b, DOUBLE_COLON, 2)))
    return (
        out.when(b.rlike(BRACKET), shape(_group(b, BRACKET, 1), none, _group(b, BRACKET, 3), _one("subcomponent", sub)))
        .when(b.rlike(DOUBLE_COLON), shape(_group(b, DOUBLE_COLON, 1), none, _group(b, DOUBLE_COLON, 3), _one("operation", op)))
        .when(b.rlike(COLON), shape(_group(b, COLON, 1), none, _group(b, COLON, 2), _empty_map()))
        .otherwise(shape(none, none, b, _empty_map()))
    )


# ---- field scanner -----------------------------------------------------------------------

_STOP = re.compile(r"[=:,;\r\n]")
_BAD_KEY = re.compile(r"[^A-Za-z0-9 _.\-]")
_KEY_START = re.compile(r"[A-Za-z]")
_BARE_END = re.compile(r"[,;\r\n]|[ \t\n\r\f]+")
_SEPARATORS = " \t\n\r\f,;"
_BLANKS = " \t\n\r\f"


class _KeyIndex:
    """Positions that decide, in logarithmic time, whether a key starts at an offset."""

    def __init__(self, line: str) -> None:
        self.line = line
        self.stops = [m.start() for m in _STOP.finditer(line)]
        self.bad = [m.start() for m in _BAD_KEY.finditer(line)]

    def delimiter(self, start: int) -> int:
        """Offset of the ``=`` or ``:`` that ends a key begun at ``start``; -1 when cut off before."""
        at = bisect_left(self.stops, start)
        if at == len(self.stops) or self.line[self.stops[at]] not in "=:":
            return -1
        return self.stops[at]

    def is_key(self, start: int, end: int) -> bool:
        while end > start and self.line[end - 1].isspace():
            end -= 1
        at = bisect_left(self.bad, start)
        return end - start >= 2 and (at == len(self.bad) or self.bad[at] >= end)

    def key_follows(self, start: int) -> bool:
        if start >= len(self.line) or not _KEY_START.match(self.line, start):
            return False
        end = self.delimiter(start)
        return end >= 0 and self.is_key(start, end)


def _value_end(keys: _KeyIndex, start: int) -> int:
    line = keys.line
    closing = {'"': '"', "{": "}"}.get(line[start])
    if closing:
        found = line.find(closing, start + 1)
        return len(line) if found < 0 else found + 1
    for gap in _BARE_END.finditer(line, start):
        if gap.group()[0] in ",;\r\n" or keys.key_follows(gap.end()):
            return gap.start()
        # a line break inside a blank run also ends the value
        for at in range(gap.start(), gap.end()):
            if line[at] in "\r\n":
                return at
    return len(line)


def scan_fields(line: str) -> list[dict[str, str]]:
    """``key=value`` and ``key: value`` pairs of one line, in order, as written."""
    keys, out, at = _KeyIndex(line), [], 0
    while True:
        start = _KEY_START.search(line, at)
        if start is None:
            return out
        delimiter = keys.delimiter(start.start())
        if delimiter < 0:
            return out
        if not keys.is_key(start.start(), delimiter):
            at = start.start() + 1
            continue
        begin = delimiter + 1
        while begin < len(line) and line[begin] in _BLANKS:
            begin += 1
        if begin >= len(line):
            return out
        at = _value_end(keys, begin)
        value = line[begin:at].strip().rstrip(",").rstrip(";")
        if value:
            out.append({"key": line[start.start():delimiter].strip(), "value": value})
        while at < len(line) and line[at] in _SEPARATORS:
            at += 1


_PAIRS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(_PAIRS)
def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lines in batches:
        yield lines.map(lambda s: scan_fields(s) if isinstance(s, str) else None)


# Every token is word=value and nothing else, so no key can be mistaken for part of a value.
PLAIN_PAIRS = r"^(?:[A-Za-z][A-Za-z0-9_.-]+=[A-Za-z0-9_.\-]+)(?:[,;]? [A-Za-z][A-Za-z0-9_.-]+=[A-Za-z0-9_.\-]+)*+$"
_PAIR = r"([A-Za-z][A-Za-z0-9_.-]+)=([A-Za-z0-9_.\-]+)"


def raw_fields(body: Column) -> Column:
    """Pairs of a body: plain ``word=value`` lists in the JVM, everything else by the scanner.

    The scanner sees only rows that hold a delimiter and are not plain; others cross to Python as null.
    """
    plain = body.rlike(PLAIN_PAIRS)
    needs_scan = (body.contains("=") | body.contains(":")) & ~plain
    natively = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(_PAIR), F.lit(1)).alias("key"),
        F.regexp_extract_all(body, F.lit(_PAIR), F.lit(2)).alias("value"),
    )
    native = F.when(plain, F.transform(natively, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))))
    return F.coalesce(native, _scan(F.when(needs_scan, body)))


def normalise_fields(pairs: Column) -> Column:
    """Map of canonical keys; empty keys and values vanish, the first occurrence of a key wins.

    Scanned keys are trimmed ASCII, so a plain lower-casing is exact for them.
    """
    entries = F.transform(
        F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>")),
        lambda p: F.struct(text.canonical_key(F.lower(p["key"])).alias("key"), text.field_value(p["value"]).alias("value")),
    )
    entries = F.filter(entries, lambda p: (p["key"] != "") & (p["value"] != ""))
    names = F.transform(entries, lambda p: p["key"])
    first = F.filter(entries, lambda p, i: F.array_position(names, p["key"]) == i + 1)
    return F.map_from_entries(first)


def extract_fields(df: DataFrame, body: Column, name: str = "fields") -> DataFrame:
    """Add the field map of a body; two steps, as a Python function may not sit inside a lambda."""
    scanned = df.withColumn("__pairs", raw_fields(body))
    return scanned.withColumn(name, normalise_fields(F.col("__pairs"))).drop("__pairs")


def _absent(fields: Column, more: Column) -> Column:
    """``more`` added to ``fields`` for keys not yet there."""
    return F.map_concat(fields, F.map_filter(more, lambda k, _: ~F.map_contains_key(fields, k)))


def infer_path(line: Column, fields: Column) -> Column:
    device = text.null_if_empty(_group(line, DEVICE_PATH, 1))
    return F.coalesce(
        _first_field(fields, PATH_FIELDS),
        text.null_if_empty(_group(line, QUOTED_PATH, 1)),
        F.rtrim(device, F.lit(".")),
        text.null_if_empty(_group(text.strip(line), PLAIN_PATH, 1)),
    )


def named_by_sentence(line: Column) -> Column:
    """Map of what a rename sentence states: original file name and path."""
    hit = line.rlike(ORIGINAL_NAME)
    both = F.create_map(
        F.lit("original_file_name"), _group(line, ORIGINAL_NAME, 1), F.lit("path"), _group(line, ORIGINAL_NAME, 2)
    )
    return F.when(hit, both).otherwise(_empty_map())


def infer_fields(line: Column, fields: Column) -> Column:
    """``fields`` plus whatever a line states in prose, for keys that are still absent."""
    hr = text.null_if_empty(_group(line, HRESULT, 1))
    return _absent(
        _absent(_absent(fields, named_by_sentence(line)), _one("hresult", hr)), _one("path", infer_path(line, fields))
    )


def infer_level(line: Column, fields: Column) -> Column:
    return _level(text.ascii_lower(line), fields)


def _level(low: Column, fields: Column) -> Column:
    hr = F.try_element_at(fields, F.lit("hresult"))
    failed = F.coalesce(~hr.isin(*ZERO_HRESULTS), F.lit(False))
    return (
        F.when(low.startswith("warning:") | low.contains(" warning"), "Warning")
        .when(low.startswith("error:") | _any_text(low, ERROR_WORDS) | failed, "Error")
        .when(low.startswith("info:"), "Info")
    )


def classify_event(line: Column, fields: Column, comp: Column, level: Column) -> Column:
    return _event(text.ascii_lower(line), fields, comp, level)


def _event(low: Column, fields: Column, comp: Column, level: Column) -> Column:
    comp = F.coalesce(F.lower(comp), F.lit(""))
    cases = []
    for label, words in TEXT_EVENTS:
        test = _any_text(low, words)
        for name in EVENT_FIELDS.get(label, ()):
            test = test | _has_field(fields, name)
        if label == "RealTimeProtection":
            test = test | comp.isin(*REALTIME_COMPONENTS)
        cases.append((test, label))
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return (
        out.when((comp == "engine") | low.startswith("engine:"), "Engine")
        .when(level.isin("Error", "Warning", "Info"), level)
        .otherwise("Unknown")
    )


def infer_action(line: Column, fields: Column) -> Column:
    return _action(text.ascii_lower(line), fields)


def _action(low: Column, fields: Column) -> Column:
    return F.coalesce(
        _first_field(fields, ACTION_FIELDS),
        F.when(low.startswith("beginning quarantine"), "begin_quarantine_recovery").when(
            low.startswith("finished quarantine"), "finish_quarantine_recovery"
        ),
    )


def annotate(records: DataFrame) -> DataFrame:
    """Parsed columns of merged records (``head``, ``continuations``, ``message``, ``raw``)."""
    df = time.with_log_time(records, "head", "__t")
    df = df.withColumns({"__body": text.lstrip(F.col("__t.rest")), "__low": text.ascii_lower(F.col("head"))})
    df = df.withColumn("__c", _component(F.col("__body")))
    df = extract_fields(df, F.col("__c.rest"), "__scanned")
    df = df.withColumn("__known", _absent(F.col("__c.fields"), F.col("__scanned")))
    df = df.withColumn("__sentence", _absent(F.col("__known"), named_by_sentence(F.col("head"))))
    df = df.withColumn(
        "__hr", _absent(F.col("__sentence"), _one("hresult", text.null_if_empty(_group(F.col("head"), HRESULT, 1))))
    )
    df = df.withColumn("fields", _absent(F.col("__hr"), _one("path", infer_path(F.col("head"), F.col("__hr")))))
    f, head = F.col("fields"), F.col("head")
    df = df.withColumns(
        {
            "level": F.coalesce(F.col("__c.level"), _level(F.col("__low"), f)),
            "component": F.col("__c.component"),
            "timestamp_raw": F.col("__t.raw"),
            "timestamp_utc": F.col("__t.utc"),
            "timestamp_assumption": F.col("__t.assumption"),
        }
    )
    # only a path may come from a continuation line: the first one that names any
    later = F.get(F.array_compact(F.transform(F.col("continuations"), lambda c: infer_path(c, _empty_map()))), F.lit(0))
    df = df.withColumns(
        {
            "event_type": _event(F.col("__low"), f, F.col("component"), F.col("level")),
            "threat_name": _first_field(f, THREAT_NAME_FIELDS),
            "threat_id": _first_field(f, ("threat_id",)),
            "path": F.coalesce(infer_path(head, f), later),
            "process": _first_field(f, ("process",)),
            "action": _action(F.col("__low"), f),
            "result": _first_field(f, RESULT_FIELDS),
            "hresult": _first_field(f, HRESULT_FIELDS),
        }
    )
    helpers = [c for c in df.columns if c.startswith("__")]
    return settled(df.drop(*helpers))


# The columns of a record, in order.
RECORD_COLUMNS = (
    "data_type", "source_file", "os_path", "source_sha256", "encoding", "decode_lossy", "line_no",
    "timestamp_raw", "timestamp_utc", "timestamp_assumption", "level", "component", "event_type",
    "threat_name", "threat_id", "path", "process", "action", "result", "hresult", "fields", "message", "raw",
)


def parse_mplog_lines(lines: DataFrame, width: int | None = DEFAULT_WIDTH) -> DataFrame:
    """Records of numbered lines that already carry encoding, decode_lossy and source_sha256."""
    parsed = annotate(merge_continuations(lines, width)).withColumns(
        {"data_type": F.lit("windows:defender:mplog:line"), "source_file": F.col("os_path")}
    )
    return parsed.select("case_id", *RECORD_COLUMNS)


def parse_mplog(files: DataFrame, width: int | None = DEFAULT_WIDTH) -> DataFrame:
    hashed = files.withColumn("source_sha256", sha256_hex(F.col("content")))
    return parse_mplog_lines(read_lines(hashed, "source_sha256"), width)
