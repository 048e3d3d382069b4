"""Decoder registry: which function turns a family's files into rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from casework.operators import artifacts, browser, lines, mplog
from casework.sources import sqlite, textlines

Decoder = Callable[[DataFrame], DataFrame]
_DECODERS: dict[str, Decoder] = {}
_PROBLEMS: dict[str, Decoder] = {}
_LINES: dict[str, tuple[Decoder, str | None, bool]] = {}


class UnknownDecoder(KeyError):
    """No decoder is registered under a key."""


def register(name: str, decoder: Decoder) -> None:
    """Register a DataFrame -> DataFrame decoder of ``files`` rows."""
    _DECODERS[name] = decoder


def register_decoder(
    name: str, schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
) -> None:
    """Register an Arrow decoder: batches of ``files`` rows in, batches of ``schema`` rows out."""
    register(name, lambda files: files.mapInArrow(fn, schema))


def register_table_function(spark: SparkSession, name: str, fn, schema: str) -> None:
    """Make a row generator callable from SQL as a table function, Arrow-batched."""
    handler = type(name, (), {"eval": lambda self, *args: fn(*args)})
    spark.udtf.register(name, F.udtf(handler, returnType=schema, useArrow=True))


def register_lines(name: str, decoder: Decoder, encoding: str | None = None, hashed: bool = False) -> None:
    """Register what turns numbered lines (of ``scan_text``) into the rows of an artifact, for files too large for one cell.

    ``encoding`` is what its files are taken for; ``hashed`` says that the lines need ``source_sha256`` of their file.
    """
    _LINES[name] = (decoder, encoding, hashed)


def has_lines(name: str) -> bool:
    return name in _LINES


def decode_text(files: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows and problems of line-based files (case_id, os_path, path, size) of any size; each file is read by many tasks."""
    decoder, encoding, hashed = _LINES[name]
    lines_, problems_ = textlines.scan_text(files, encoding=encoding)
    if hashed:  # one row per file that is larger than a cell
        lines_ = lines_.join(F.broadcast(textlines.hash_files(files)), ["case_id", "os_path"])
    return decoder(lines_), problems_


def decode(files: DataFrame, name: str) -> DataFrame:
    if name not in _DECODERS:
        raise UnknownDecoder(f"no decoder registered for {name}")
    return _DECODERS[name](files)


def register_problems(name: str, reader: Decoder) -> None:
    """Register what lists the files of an artifact that its decoder cannot read: (case_id, os_path, error)."""
    _PROBLEMS[name] = reader


def problems(files: DataFrame, name: str) -> DataFrame | None:
    """Files that were opened but not decoded; None for decoders that read anything."""
    return _PROBLEMS[name](files).select("case_id", "os_path", "error").distinct() if name in _PROBLEMS else None


def registered() -> tuple[str, ...]:
    return tuple(_DECODERS)


def _chromium(kind: str) -> Decoder:
    def run(files: DataFrame) -> DataFrame:
        t = {name: rows for name, (rows, _) in sqlite.read_sqlite_tables(files, sqlite.CHROMIUM_TABLES).items()}
        return browser.chromium_visits(t["urls"], t["visits"], t["visit_source"], F.lit(kind))

    return run


def _firefox(files: DataFrame) -> DataFrame:
    t = {name: rows for name, (rows, _) in sqlite.read_sqlite_tables(files, sqlite.FIREFOX_TABLES).items()}
    return browser.firefox_visits(t["moz_places"], t["moz_historyvisits"])


def _single(tables: dict, build: Decoder) -> Decoder:
    (table, columns), = tables.items()
    return lambda files: build(sqlite.read_sqlite_table(files, table, columns)[0])


# Artifact -> decoder of its files.
BUILT_IN: dict[str, Decoder] = {
    "Windows.Defender.MPLog": mplog.parse_mplog,
    "Linux.Shell.History": lines.parse_shell_history,
    "Windows.RecycleBin.Info2": artifacts.parse_info2,
    "Windows.Forensics.RestorePoint.Log": artifacts.parse_rp_log,
    "Windows.Applications.Chrome.History": _chromium("chrome"),
    "Windows.Applications.Edge.History": _chromium("edge"),
    "Windows.Applications.Firefox.History": _firefox,
    "Windows.Forensics.Timeline.ActivitiesCache": _single(sqlite.TIMELINE_TABLES, browser.timeline_activity),
    "MacOS.Applications.Chrome.History": _single(sqlite.MAC_CHROME_TABLES, browser.mac_chrome_urls),
    "MacOS.System.QuarantineEvents": _single(sqlite.QUARANTINE_TABLES, browser.quarantine_events),
}
for _artifact, _decoder in BUILT_IN.items():
    register(_artifact, _decoder)



def _unread(tables: dict) -> Decoder:
    """Problems with the first table of a database; what fails there fails the others alike."""
    name, columns = next(iter(tables.items()))
    return lambda files: sqlite.read_sqlite_table(files, name, columns)[1]


for _artifact, _tables in {
    "Windows.Applications.Chrome.History": sqlite.CHROMIUM_TABLES,
    "Windows.Applications.Edge.History": sqlite.CHROMIUM_TABLES,
    "Windows.Applications.Firefox.History": sqlite.FIREFOX_TABLES,
    "Windows.Forensics.Timeline.ActivitiesCache": sqlite.TIMELINE_TABLES,
    "MacOS.Applications.Chrome.History": sqlite.MAC_CHROME_TABLES,
    "MacOS.System.QuarantineEvents": sqlite.QUARANTINE_TABLES,
}.items():
    register_problems(_artifact, _unread(_tables))
register_problems("Windows.RecycleBin.Info2", lambda files: artifacts.split_errors(artifacts.decode_info2(files))[1])
register_problems("Windows.Forensics.RestorePoint.Log", lambda files: artifacts.split_errors(artifacts.decode_rp_log(files))[1])
register_lines("Windows.Defender.MPLog", mplog.parse_mplog_lines, hashed=True)
register_lines("Linux.Shell.History", lines.shell_rows, encoding="utf-8-lossy")
