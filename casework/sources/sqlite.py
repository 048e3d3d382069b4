"""Tables of SQLite databases found in packages."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BATCH = 8192
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "any": pa.string()}


def _cell(value, kind: str):
    """Cell as its column type; a value of another storage class fails the file."""
    if value is None:
        return None
    if kind == "any":
        value = value.decode("utf-8", "replace") if isinstance(value, bytes) else value
        return value if isinstance(value, str) else json.dumps(value)
    if kind == "bigint" and isinstance(value, int):
        return value
    if kind == "double" and isinstance(value, (int, float)):
        return float(value)
    if kind == "string" and isinstance(value, (str, bytes)):
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else value
    raise TypeError(f"{type(value).__name__} in a {kind} column")


def _database(content: bytes) -> sqlite3.Connection:
    # a copied write-ahead-log database is read as a plain one
    if content[18:20] == b"\x02\x02":
        content = content[:18] + b"\x01\x01" + content[20:]
    connection = sqlite3.connect(":memory:")
    connection.text_factory = lambda raw: raw.decode("utf-8", "replace")
    connection.deserialize(content)
    return connection


def _reader(table: str, columns: Mapping[str, str]):
    names = list(columns)
    schema = pa.schema(
        [("case_id", pa.string()), ("os_path", pa.string())]
        + [(n, _ARROW[k]) for n, k in columns.items()]
        + [("error", pa.string())]
    )
    query = "SELECT {} FROM {}".format(", ".join(f'"{n}"' for n in names), f'"{table}"')

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for case_id, os_path, content in zip(*(batch.column(c) for c in ("case_id", "os_path", "content")), strict=True):
                source = {"case_id": case_id.as_py(), "os_path": os_path.as_py()}
                rows: list[dict] = []
                try:
                    connection = _database(content.as_py())  # one database at a time leaves the batch
                    try:
                        for row in connection.execute(query):
                            cells = {n: _cell(v, columns[n]) for n, v in zip(names, row)}
                            rows.append(source | cells)
                            if len(rows) == BATCH:
                                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                                rows = []
                    finally:
                        connection.close()
                except (sqlite3.Error, TypeError) as error:
                    rows.append(source | {"error": str(error)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def read_sqlite_table(files: DataFrame, table: str, columns: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, diagnostics) of one table in every database file.

    Column kinds are bigint, double, string or any. A file that fails is reported in diagnostics and
    passed over; rows read before the failure stay.
    """
    ddl = ["case_id string", "os_path string"]
    ddl += [f"`{n}` {'string' if k == 'any' else k}" for n, k in columns.items()]
    read = files.select("case_id", "os_path", "content").mapInArrow(
        _reader(table, dict(columns)), ", ".join([*ddl, "error string"])
    )
    rows = read.where(F.col("error").isNull()).drop("error")
    return rows, read.where(F.col("error").isNotNull()).select("case_id", "os_path", "error")


def read_sqlite_tables(
    files: DataFrame, tables: Mapping[str, Mapping[str, str]]
) -> dict[str, tuple[DataFrame, DataFrame]]:
    return {t: read_sqlite_table(files, t, c) for t, c in tables.items()}


# The browser and activity tables that are read.
CHROMIUM_TABLES = {
    "urls": {"id": "bigint", "url": "string", "title": "string", "visit_count": "bigint",
             "typed_count": "bigint", "last_visit_time": "bigint", "hidden": "bigint"},
    "visits": {"id": "bigint", "url": "bigint", "visit_time": "bigint", "from_visit": "bigint",
               "visit_duration": "bigint", "transition": "bigint"},
    "visit_source": {"id": "bigint", "source": "bigint"},
}
FIREFOX_TABLES = {
    "moz_places": {"id": "bigint", "url": "string", "title": "string", "rev_host": "string",
                   "visit_count": "bigint", "hidden": "bigint", "typed": "bigint", "description": "string"},
    "moz_historyvisits": {"id": "bigint", "from_visit": "bigint", "visit_date": "bigint", "place_id": "bigint"},
}
TIMELINE_TABLES = {"Activity": {"AppId": "string", "LastModifiedTime": "any"}}
MAC_CHROME_TABLES = {
    "urls": {"url": "string", "title": "string", "visit_count": "bigint", "typed_count": "bigint",
             "last_visit_time": "bigint"},
}
QUARANTINE_TABLES = {
    "LSQuarantineEvent": {
        "LSQuarantineTimeStamp": "double", "LSQuarantineDataURLString": "string",
        "LSQuarantineOriginURLString": "string", "LSQuarantineAgentName": "string",
        "LSQuarantineAgentBundleIdentifier": "string", "LSQuarantineEventIdentifier": "string",
    },
}
