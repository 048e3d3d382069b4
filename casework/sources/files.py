"""Evidence files: folder trees, zip packages, byte ranges.

``files(case_id, os_path, archive_path, volume, size, mtime, content)`` is the common shape.
"""

from __future__ import annotations

import hashlib
import lzma
import os
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casework.session import shared_dir

CHUNK = 1024 * 1024


def _volume(path: Column) -> Column:
    first = F.substring_index(path, "/", 1)
    return F.when(first.rlike("^[A-Za-z]$"), F.upper(first))


_TREE = "path string, relative string, is_folder boolean, length bigint, mtime timestamp"
_TREE_ARROW = pa.schema([("path", pa.string()), ("relative", pa.string()), ("is_folder", pa.bool_()), ("length", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC"))])
_LISTED = 4096  # entries of a folder that go into one batch


def _hidden(name: str) -> bool:
    """Names that Spark's own readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _glob(pattern: str) -> re.Pattern:
    """A path filter of Hadoop as a regular expression: * ? [abc] [^a-c] {one,other}."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\").replace("!", "^", pattern[i + 1] == "!") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        else:
            out += {"*": ".*", "?": ".", ",": "|" if depth else ","}.get(c, re.escape(c))
        i += 1
    return re.compile(out, re.DOTALL)


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, relative in zip(batch.column("path").to_pylist(), batch.column("relative").to_pylist(), strict=True):
            filesystem, name = located(folder)
            found = filesystem.get_file_info(pafs.FileSelector(name, allow_not_found=True))
            kept = [f for f in found if not _hidden(f.base_name) and f.type in (pafs.FileType.File, pafs.FileType.Directory)]
            for at in range(0, len(kept), _LISTED):
                some = kept[at : at + _LISTED]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{folder.rstrip('/')}/{f.base_name}" for f in some], pa.string()),
                        pa.array([f"{relative}/{f.base_name}" if relative else f.base_name for f in some], pa.string()),
                        pa.array([f.type == pafs.FileType.Directory for f in some], pa.bool_()),
                        pa.array([None if f.type == pafs.FileType.Directory else f.size for f in some], pa.int64()),
                        pa.array([None if f.mtime_ns is None else f.mtime_ns // 1_000_000 * 1000 for f in some], pa.int64()).cast(pa.timestamp("us", tz="UTC")),
                    ],
                    schema=_TREE_ARROW,
                )


def _tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``, listed by tasks, one level of folders after the other; the driver sees no names."""
    filesystem, name = located(root)
    if filesystem.get_file_info(name).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no folder {root}")
    listing = shared_dir(spark, "listing")
    level, number = spark.createDataFrame([(root, "")], "path string, relative string"), 0
    while True:
        at = f"{listing}/level={number}"
        level.mapInArrow(_list_folders, _TREE).write.parquet(at)
        found = spark.read.schema(_TREE).parquet(at).where("is_folder").select("path", "relative")
        if found.isEmpty():
            return spark.read.schema(_TREE).option("recursiveFileLookup", "true").parquet(listing).where("NOT is_folder")
        level, number = spread(found, "path"), number + 1


_READ = 4 * CHUNK


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the content of their files; those that vanished or cannot be opened are left out."""
    for batch in batches:
        rows, contents, size = [], [], 0
        for i, path in enumerate(batch.column("path").to_pylist()):
            try:
                with _open(path) as handle:
                    contents.append(handle.read())
            except OSError:
                continue
            rows.append(i)
            size += len(contents[-1])
            if size >= _READ:
                yield _with_content(batch, rows, contents)
                rows, contents, size = [], [], 0
        if rows:
            yield _with_content(batch, rows, contents)


def _with_content(batch: pa.RecordBatch, rows: list[int], contents: list[bytes]) -> pa.RecordBatch:
    some = batch.take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([*some.columns, pa.array(contents, pa.binary())], names=[*some.schema.names, "content"])


def read_tree(spark: SparkSession, root: str, glob: str | None = None, with_content: bool = True) -> DataFrame:
    """Regular files below ``root``, any depth. Without content the read touches metadata only.

    The first folder below ``root`` is the case; files that vanish or cannot be opened are passed over. Folders are listed by
    tasks, so that no list of files passes through the driver.
    """
    if ":" not in root.split("/", 1)[0]:
        root = os.path.abspath(root)
    listed = _tree(spark, root)
    if glob:
        listed = listed.where(F.substring_index("relative", "/", -1).rlike(f"^(?s:{_glob(glob).pattern})$"))
    plain = F.regexp_replace(F.col("path"), "^file:/+", "/")
    archive = F.regexp_replace("relative", "^[^/]*/", "")
    columns = {
        "case_id": F.substring_index("relative", "/", 1),
        "os_path": plain,
        "archive_path": archive,
        "volume": _volume(archive),
        "size": F.col("length"),
        "mtime": F.col("mtime"),
    }
    if with_content:
        listed = spread(listed, "path").mapInArrow(_read_files, f"{_TREE}, content binary")
        columns["content"] = F.col("content")
    return listed.select(*[c.alias(n) for n, c in columns.items()])


# ---- zip packages ------------------------------------------------------------------------


class UnsupportedScheme(Exception):
    """Spark can list a path, but nothing here can open it; never taken for a damaged file."""


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a path as Spark prints it: not quoted, so blanks, % and # are part of the name."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return pafs.LocalFileSystem(), path
    scheme, rest = scheme.lower(), rest.lstrip("/")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest
    if scheme == "dbfs":  # mounted on every machine
        return pafs.LocalFileSystem(), "/dbfs/" + rest
    if scheme in ("s3", "s3a", "s3n"):
        return pafs.S3FileSystem(), rest
    if scheme in ("gs", "gcs"):
        return pafs.GcsFileSystem(), rest
    if scheme in ("hdfs", "viewfs"):
        authority, _, name = rest.partition("/")
        return pafs.HadoopFileSystem.from_uri(f"{scheme}://{authority}"), "/" + name
    raise UnsupportedScheme(f"no reader for {scheme}: paths ({path})")


def _open(path: str):
    filesystem, name = located(path)
    return filesystem.open_input_file(name)


def enclosed(name: str) -> str | None:
    """Member path below the extraction root, or None when it would leave it."""
    name = name.replace("\\", "/")
    if name.startswith("/") or "\0" in name or name[1:2] == ":":
        return None
    kept: list[str] = []
    for part in name.split("/"):
        if part == "..":
            if not kept:
                return None
            kept.pop()
        elif part not in ("", "."):
            kept.append(part)
    return "/".join(kept) or None


_MEMBERS = pa.schema(
    [
        ("package", pa.string()), ("member", pa.string()), ("archive_path", pa.string()),
        ("member_no", pa.int64()), ("size", pa.int64()), ("status", pa.string()),
    ]
)
MEMBERS_DDL = "package string, member string, archive_path string, member_no bigint, size bigint, status string"


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = []
            try:
                with _open(uri) as handle, zipfile.ZipFile(handle) as archive:
                    for number, info in enumerate(archive.infolist()):
                        if info.is_dir():
                            continue
                        path = enclosed(info.filename)
                        rows.append(
                            (uri, info.filename, path, number, info.file_size, "ok" if path else "rejected")
                        )
            except (zipfile.BadZipFile, OSError, ValueError) as error:  # ValueError: seek before the start
                rows.append((uri, None, None, -1, 0, f"unreadable: {error}"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows), _MEMBERS)] if rows
                else [pa.array([], t.type) for t in _MEMBERS],
                schema=_MEMBERS,
            )


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """Small rows that stand for much reading, dealt to all shuffle partitions: without a number Spark would merge them by their own size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def together() -> Column:
    """Members of a package that one task reads: small ones by 64, so that their package is opened once for them all, others alone."""
    return F.when(F.col("size") <= CHUNK, -1 - F.call_function("div", F.col("member_no"), F.lit(64))).otherwise(F.col("member_no"))


def list_packages(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """Members of every zip below ``path``; only the central directories are read.

    Names that leave the extraction root come back as ``rejected``, broken packages as ``unreadable``.
    """
    packages = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    ).select(F.regexp_replace("path", "^file:/+", "file:///").alias("package"))
    return packages.mapInArrow(_list_members, MEMBERS_DDL)


FILES_DDL = (
    "package string, member string, archive_path string, member_no bigint, size bigint, status string, "
    "chunk_no bigint, content binary"
)
_CONTENT = pa.schema([*_MEMBERS, ("chunk_no", pa.int64()), ("content", pa.binary())])


#: What a damaged, encrypted or oddly compressed member raises while it is read.
MEMBER_ERRORS = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, OSError, EOFError, ValueError, RuntimeError, NotImplementedError, IndexError)


class _Packages:
    """The package that is open; members of one package follow each other."""

    def __init__(self) -> None:
        self.name, self.handle, self.archive, self.members = None, None, None, []

    def member(self, row: dict) -> tuple[zipfile.ZipFile, zipfile.ZipInfo]:
        if row["package"] != self.name:
            self.close()
            self.handle = _open(row["package"])
            self.archive = zipfile.ZipFile(self.handle)
            self.name, self.members = row["package"], self.archive.infolist()
        return self.archive, self.members[row["member_no"]]

    def close(self) -> None:
        for part in (self.archive, self.handle):
            if part is not None:
                part.close()
        self.name, self.handle, self.archive, self.members = None, None, None, []


def _member_reader(chunk_bytes: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packages = _Packages()
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    number = 0
                    try:
                        archive, info = packages.member(row)
                        with archive.open(info) as member:
                            data = member.read(chunk_bytes)
                            while data or number == 0:
                                yield pa.RecordBatch.from_pylist([dict(row, chunk_no=number, content=data)], schema=_CONTENT)
                                number, data = number + 1, member.read(chunk_bytes)
                    except MEMBER_ERRORS as error:
                        bad = dict(row, chunk_no=number, content=None, status=f"unreadable: {error}")
                        yield pa.RecordBatch.from_pylist([bad], schema=_CONTENT)
        finally:
            packages.close()

    return read


def read_member_heads(members: DataFrame, n: int) -> DataFrame:
    """(package, member_no, head): the first ``n`` bytes of listed members, of which no more is inflated; null where a member cannot be read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packages = _Packages()
        try:
            for batch in batches:
                heads = []
                for row in batch.to_pylist():
                    try:
                        archive, info = packages.member(row)
                        with archive.open(info) as member:
                            heads.append(member.read(n))
                    except MEMBER_ERRORS:
                        heads.append(None)
                yield pa.RecordBatch.from_arrays([batch.column("package"), batch.column("member_no"), pa.array(heads, pa.binary())], names=["package", "member_no", "head"])
        finally:
            packages.close()

    # members of one package follow each other in one task: its directory is read once
    dealt = spread(members.where(F.col("status") == "ok").select("package", "member_no"), "package").sortWithinPartitions("package", "member_no")
    return dealt.mapInArrow(read, "package string, member_no bigint, head binary")


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packages = _Packages()
    try:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                digest, status = hashlib.sha256(), row["status"]
                try:
                    archive, info = packages.member(row)
                    with archive.open(info) as member:
                        while data := member.read(CHUNK):
                            digest.update(data)
                except MEMBER_ERRORS as error:
                    status = f"unreadable: {error}"
                found.append((row["package"], row["archive_path"], row["size"], status, digest.hexdigest() if status == "ok" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), _HASHES)] if found else [pa.array([], t.type) for t in _HASHES], schema=_HASHES)
    finally:
        packages.close()


_HASHES = pa.schema([("package", pa.string()), ("archive_path", pa.string()), ("size", pa.int64()), ("status", pa.string()), ("sha256", pa.string())])


def hash_members(members: DataFrame) -> DataFrame:
    """SHA-256 of listed members of any size, read piece by piece: (package, archive_path, size, status, sha256)."""
    dealt = spread(members.where(F.col("status") == "ok"), "package", together()).sortWithinPartitions("package", "member_no")
    return dealt.mapInArrow(_hash_members, "package string, archive_path string, size bigint, status string, sha256 string")


def read_member_chunks(members: DataFrame, chunk_bytes: int = 64 * CHUNK) -> DataFrame:
    """Bytes of package members in numbered chunks.

    Members are spread over tasks, small ones by 64 and others one by one, whatever package they sit in, so one huge
    package does not become one task; a member larger than ``chunk_bytes`` yields several rows. One that cannot be read
    to its end has a last row without content whose status says why; the others are not affected.
    """
    wanted = members.where(F.col("status") == "ok")
    dealt = spread(wanted, "package", together()).sortWithinPartitions("package", "member_no")
    return dealt.mapInArrow(_member_reader(chunk_bytes), FILES_DDL)


class RejectedMember(ValueError):
    """A package member would be extracted outside its root."""


def read_packages(spark: SparkSession, path: str, glob: str = "*.zip", fail_fast: bool = False,
                  max_content: int = 1 << 30) -> DataFrame:
    """``files`` of all packages below ``path``; the case is the package name without ``.zip``.

    Rejected and unreadable members keep a row with their status and no content. A member beyond
    ``max_content`` (one cell holds at most 2 GiB) is marked ``oversize``: read it with
    :func:`read_member_chunks`.
    """
    members = list_packages(spark, path, glob)
    if fail_fast:
        bad = F.raise_error(F.concat(F.lit("member leaves its root: "), F.col("member")))
        members = members.withColumn("status", F.when(F.col("status") == "rejected", bad).otherwise(F.col("status")))
    members = members.withColumn(
        "status",
        F.when((F.col("status") == "ok") & (F.col("size") > max_content), "oversize").otherwise(F.col("status")),
    )
    good = read_member_chunks(members, max_content)
    rest = members.where(F.col("status") != "ok").withColumns(
        {"chunk_no": F.lit(0).cast("bigint"), "content": F.lit(None).cast("binary")}
    )
    return good.unionByName(rest).select(
        F.regexp_replace(F.substring_index("package", "/", -1), r"(?i)\.zip$", "").alias("case_id"),
        F.coalesce("archive_path", "member").alias("os_path"),
        "archive_path",
        _volume(F.col("archive_path")).alias("volume"),
        "size",
        F.lit(None).cast("timestamp").alias("mtime"),
        "content",
        "status",
    )


# ---- byte ranges -------------------------------------------------------------------------


def open_uri(path: str):
    """Random-access handle of a shared file, by a path as Spark prints it."""
    return _open(path)
