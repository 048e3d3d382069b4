"""Byte ranges, journal records and other binary artifacts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from bindings.logs import TAIL_SQL
from bindings.registry import query
from bindings.scalars import flags_sql, le_bytes
from bindings.views import cte, read, view
from casework.functions import flags
from casework.operators import artifacts, lines, ranges, usn
from casework.session import shared_dir
from casework.sources.files import located
from casework.sources.ranges import read_ranges



@query(
    "join_12_range_clip",
    cte("v_runs", "v_windows") + """ SELECT * FROM (SELECT case_id, os_path, seq, greatest(logical_offset, window_start) AS start, least(logical_offset + length, window_end) AS "end"
        FROM v_runs JOIN v_windows USING (case_id, os_path) WHERE NOT sparse) WHERE start < "end" """,
)
def join_12(spark, sf):
    return ranges.clip_ranges(view(spark, sf, "v_runs"), view(spark, sf, "v_windows"))


@query(
    "win_3_range_coalesce",
    cte("v_runs", "v_windows") + """, c AS (SELECT * FROM (SELECT case_id, os_path, seq, greatest(logical_offset, window_start) AS s, least(logical_offset + length, window_end) AS e
        FROM v_runs JOIN v_windows USING (case_id, os_path) WHERE NOT sparse) WHERE s < e),
        g AS (SELECT *, CASE WHEN lag(e) OVER w = s THEN 0 ELSE 1 END AS gap FROM c WINDOW w AS (PARTITION BY case_id, os_path ORDER BY seq)),
        i AS (SELECT *, sum(gap) OVER (PARTITION BY case_id, os_path ORDER BY seq) AS isl FROM g),
        r AS (SELECT case_id, os_path, min(seq) AS seq, min(s) AS start, CAST(sum(e - s) AS BIGINT) AS length FROM i GROUP BY case_id, os_path, isl)
        SELECT * FROM r UNION ALL SELECT case_id, os_path, 0, window_start, window_end - window_start FROM v_windows WHERE window_start < window_end AND os_path NOT IN (SELECT os_path FROM r)""",
)
def win_3(spark, sf):
    return ranges.coalesce_ranges(view(spark, sf, "v_runs"), view(spark, sf, "v_windows"), width=2_000)


@query(
    "win_4_data_runs",
    cte("v_runs") + """, g AS (SELECT *, CASE WHEN lag(logical_offset + length) OVER w = logical_offset AND lag(sparse) OVER w = sparse
            AND (lag(volume_offset) OVER w IS NULL) = (volume_offset IS NULL) AND (volume_offset IS NULL OR lag(volume_offset + length) OVER w = volume_offset) THEN 0 ELSE 1 END AS brk
            FROM v_runs WINDOW w AS (PARTITION BY case_id, os_path ORDER BY seq)),
        i AS (SELECT *, sum(brk) OVER (PARTITION BY case_id, os_path ORDER BY seq) AS run FROM g)
        SELECT case_id, os_path, min(seq) AS seq, arg_min(logical_offset, seq) AS logical_offset, min(volume_offset) AS volume_offset, CAST(sum(length) AS BIGINT) AS length, bool_or(sparse) AS sparse
        FROM i GROUP BY case_id, os_path, run""",
)
def win_4(spark, sf):
    return ranges.build_runs(view(spark, sf, "v_runs"), width=2_000)


@query(
    "win_5_active_window",
    """SELECT event_id, CASE WHEN ok THEN f END AS active_start, CASE WHEN ok THEN e - f END AS active_length,
        CASE WHEN event_id % 10 = 9 THEN 0 WHEN greatest(f - 7, 0) < least(coalesce(CASE WHEN n >= 7 THEN n - 7 END, size), size) THEN CASE WHEN f >= 7 THEN f - 7 ELSE 0 END ELSE 0 END AS parse_start,
        CASE WHEN event_id % 10 = 9 THEN size WHEN CASE WHEN f >= 7 THEN f - 7 ELSE 0 END < least(coalesce(CASE WHEN n >= 7 THEN n - 7 END, size), size) THEN least(coalesce(CASE WHEN n >= 7 THEN n - 7 END, size), size) ELSE size END AS parse_end
        FROM (SELECT *, least(n, size) AS e, event_id % 10 <> 9 AND f < least(n, size) AND NOT (f = 0 AND least(n, size) = size) AS ok
              FROM (SELECT event_id, user_id * (event_id % 3) AS f, event_id * 2 AS n, 5000 AS size FROM events))""",
)
def win_5(spark, sf):
    e = F.col("event_id")
    first = (F.col("user_id") * (e % 3)).cast("string")
    bad = e % 10 == 9
    df = read(spark, sf, "events").select(
        "event_id", F.when(bad, F.lit(" ")).otherwise(first).alias("f"), F.when(bad, F.lit("")).otherwise(F.concat((e * 2).cast("string"), F.lit(" "))).alias("n"),
        F.lit(5000).cast("bigint").alias("size"),
    )
    df = df.withColumns(
        {
            "a": ranges.active_window(F.col("f"), F.col("n"), F.col("size")),
            "p": ranges.parse_window(F.col("f"), F.col("n"), F.lit(7).cast("bigint"), F.col("size")),
        }
    )
    return df.select("event_id", F.col("a.start").alias("active_start"), F.col("a.length").alias("active_length"), F.col("p.start").alias("parse_start"), F.col("p.end").alias("parse_end"))


@query(
    "win_6_pack_offsets",
    "SELECT l_suppkey, seq, length, CAST(coalesce(sum(length) OVER (PARTITION BY l_suppkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_in_pack "
    "FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS seq, max(CAST(l_quantity AS BIGINT) - 5) AS length FROM lineitem GROUP BY ALL) WHERE length > 0",
)
def win_6(spark, sf):
    entries = read(spark, sf, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")).agg(
        F.max(F.col("l_quantity").cast("bigint") - 5).alias("length")
    )
    return ranges.pack_offsets(entries, ["l_suppkey"], width=10_000)


@query(
    "join_6_sidecar_priority",
    """SELECT d.doc_id, c.priority, c.note FROM documents d LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority) AS r FROM
        (SELECT doc_id, 1 AS priority, 'q' || quality AS note FROM labels UNION ALL SELECT doc_id, 2, lang FROM documents WHERE doc_id % 3 <> 0)) WHERE r = 1) c ON c.doc_id = d.doc_id""",
)
def join_6(spark, sf):
    docs = read(spark, sf, "documents")
    first = read(spark, sf, "labels").select("doc_id", F.lit(1).alias("priority"), F.concat(F.lit("q"), "quality").alias("note"))
    second = docs.where("doc_id % 3 <> 0").select("doc_id", F.lit(2).alias("priority"), F.col("lang").alias("note"))
    return usn.attach_sidecar(docs.select("doc_id"), first.unionByName(second), "doc_id")


# ---- change journal ----------------------------------------------------------------------


def _journal_records(spark, sf):
    """A version 2 record per event (version 3 for every fifth), as (stream, position, bytes)."""
    e, zero = F.col("event_id"), F.lit(0)
    name = F.hex(F.encode(F.concat("event_type", F.lit("é.txt")), "UTF-16LE"))
    v3 = e % 5 == 0
    head = F.when(v3, 76).otherwise(60)
    name_bytes = F.call_function("div", F.length(name), F.lit(2))
    size = F.call_function("div", head + name_bytes + 7, F.lit(8)) * 8
    ref = F.when(v3, F.concat(le_bytes(e * 3, 8), le_bytes(F.col("user_id"), 8))).otherwise(le_bytes(e * 3, 8))
    parent = F.when(v3, F.concat(le_bytes(F.col("user_id"), 8), le_bytes(zero, 8))).otherwise(le_bytes(F.col("user_id"), 8))
    ticks = F.lit(132537600000000000) + e * 12345
    body = F.concat(
        le_bytes(size, 4), le_bytes(F.when(v3, 3).otherwise(2), 2), le_bytes(zero, 2), ref, parent, le_bytes(e, 8), le_bytes(ticks, 8),
        le_bytes(F.pow(F.lit(2), e % 24).cast("bigint"), 4), le_bytes(e % 16, 4), le_bytes(e % 100, 4), le_bytes(e % 64, 4),
        le_bytes(name_bytes, 2), le_bytes(head, 2), name,
    )
    padded = F.unhex(F.rpad(body, (size * 2).cast("int"), "0"))
    return read(spark, sf, "events").select("event_id", F.call_function("div", e, F.lit(400)).alias("stream"), padded.alias("record"))


V3 = "event_id % 5 = 0"
USN_SQL = f"""SELECT event_id AS usn, CASE WHEN {V3} THEN 3 ELSE 2 END AS major_version,
    CASE WHEN {V3} THEN '0x' || lpad(hex(user_id), 16, '0') || lpad(hex(event_id * 3), 16, '0') ELSE '0x' || lpad(hex(event_id * 3), 16, '0') END AS file_reference_number,
    CASE WHEN {V3} THEN '0x' || lpad(hex(user_id), 32, '0') ELSE '0x' || lpad(hex(user_id), 16, '0') END AS parent_file_reference_number,
    132537600000000000 + event_id * 12345 AS timestamp_filetime,
    strftime(make_timestamp(1609286400000000 + event_id * 12345 // 10), '%Y-%m-%dT%H:%M:%S.%f') || (event_id * 12345 % 10) || '00Z' AS timestamp,
    {flags_sql('1 << (event_id % 24)', flags.REASON)} AS reason_flags, {flags_sql('event_id % 16', flags.SOURCE)} AS source_flags,
    event_id % 100 AS security_id, {flags_sql('event_id % 64', flags.ATTRIBUTE)} AS file_attribute_flags, event_type || 'é.txt' AS file_name FROM events"""


def _usn_output(rows):
    return rows.select(
        F.col("usn").cast("bigint").alias("usn"), "major_version", "file_reference_number", "parent_file_reference_number",
        F.col("timestamp_filetime").cast("bigint").alias("timestamp_filetime"), "timestamp",
        *[F.array_join(c, ",").alias(c) for c in ("reason_flags", "source_flags", "file_attribute_flags")], "security_id", "file_name",
    )


def _decoded(spark, sf):
    """Decoded records of a table of split records, as the splitter leaves them."""
    folder = shared_dir(spark, "usn-records")
    _journal_records(spark, sf).select(
        F.lit("host").alias("case_id"), F.col("stream").cast("string").alias("os_path"), F.col("event_id").alias("record_offset"),
        F.length("record").cast("bigint").alias("record_length"), F.col("record").alias("head_bytes"),
    ).write.parquet(folder)
    return usn.decode_usn(spark.read.parquet(folder))


@query("usn_2_header_decode", USN_SQL)
def usn_2(spark, sf):
    return _usn_output(usn.usn_rows(_decoded(spark, sf)))


@query(
    "usn_3_record_rows",
    """SELECT event_id AS record_offset, CAST(event_id // 400 AS VARCHAR) AS os_path, 'C' AS volume, CASE WHEN event_id // 400 % 2 = 0 THEN 'vss' END AS source_access_method,
        'windows:filesystem:usn_journal_record' AS data_type FROM events""",
)
def usn_3(spark, sf):
    streams = read(spark, sf, "events").select(F.call_function("div", F.col("event_id"), F.lit(400)).alias("s")).distinct()
    metadata = streams.select(
        F.lit("host").alias("case_id"), F.col("s").cast("string").alias("os_path"), F.lit("C").alias("volume"),
        F.when(F.col("s") % 2 == 0, "vss").otherwise("").alias("source_access_method"),
    )
    return usn.usn_rows(_decoded(spark, sf), metadata).select("record_offset", "os_path", "volume", "source_access_method", "data_type")


@query(
    "usn_4_statistics",
    """WITH f AS (SELECT CASE event_id % 24 WHEN 3 THEN NULL WHEN 7 THEN NULL ELSE ['DATA_OVERWRITE', 'DATA_EXTEND', 'DATA_TRUNCATION', '', 'NAMED_DATA_OVERWRITE', 'NAMED_DATA_EXTEND', 'NAMED_DATA_TRUNCATION', '',
        'FILE_CREATE', 'FILE_DELETE', 'EA_CHANGE', 'SECURITY_CHANGE', 'RENAME_OLD_NAME', 'RENAME_NEW_NAME', 'INDEXABLE_CHANGE', 'BASIC_INFO_CHANGE', 'HARD_LINK_CHANGE', 'COMPRESSION_CHANGE', 'ENCRYPTION_CHANGE',
        'OBJECT_ID_CHANGE', 'REPARSE_POINT_CHANGE', 'STREAM_CHANGE', 'TRANSACTED_CHANGE', 'INTEGRITY_CHANGE'][event_id % 24 + 1] END AS k, event_type,
        strftime(make_timestamp(1609286400000000 + event_id * 12345 // 10), '%Y-%m-%dT%H') AS hour FROM events)
        SELECT 'reason' AS grouping, k AS key, count(*) AS n FROM f GROUP BY k UNION ALL SELECT 'name', event_type || 'é.txt', count(*) FROM f GROUP BY event_type UNION ALL SELECT 'hour', hour, count(*) FROM f GROUP BY hour""",
)
def usn_4(spark, sf):
    rows = usn.usn_rows(_decoded(spark, sf))
    out = None
    for by in ("reason", "name", "hour"):
        part = usn.usn_stats(rows, by).select(F.lit(by).alias("grouping"), "key", "n")
        out = part if out is None else out.unionByName(part)
    return out


def write_streams(spark, sf, folder):
    """Journal files of up to 400 records each below a shared folder; returns them as a table."""

    def build(key, table):
        stream = key[0].as_py()
        data = b"".join(r["record"] for r in table.sort_by("event_id").to_pylist())
        import pyarrow.fs as pafs

        filesystem, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        filesystem.create_dir(base, recursive=True)
        # zero padding in front, an incomplete record behind
        with filesystem.open_output_stream(f"{base}/{stream:08d}.bin") as out:
            out.write(bytes(512) + data + b"\x50\x00\x00\x00\x02\x00\x00\x00junk")
        return pa.table({"case_id": ["host"], "os_path": [f"{base}/{stream:08d}.bin"], "size": [528 - 4 + len(data)]})

    written = _journal_records(spark, sf).groupBy("stream").applyInArrow(build, "case_id string, os_path string, size bigint")
    # the listing is kept as a table, so a lost executor cannot make reads race rewrites
    written.write.mode("overwrite").parquet(f"{folder}-listing")
    return spark.read.parquet(f"{folder}-listing")


def file_writer(filesystem, root: str):
    """Writes the cells of Arrow batches one after the other, without a copy of them all."""

    def write(batches):
        filesystem.create_dir(root, recursive=True)
        for batch in batches:
            paths, sizes = [f"{root}/{name}.bin" for name in batch.column("os_path").to_pylist()], []
            for path, content in zip(paths, batch.column("content"), strict=True):
                body = content.as_buffer()
                with filesystem.open_output_stream(path) as out:
                    out.write(body)
                sizes.append(body.size)
            yield pa.RecordBatch.from_arrays([batch.column("case_id"), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["case_id", "os_path", "size"])

    return write


def written_files(df, folder: str):
    """Each row's ``content`` as a file of its own: (case_id, os_path, size) of the copies, named by the row's os_path."""
    listing = f"{folder}-listing"
    df.select("case_id", "os_path", "content").mapInArrow(file_writer(*located(folder)), "case_id string, os_path string, size bigint").write.parquet(listing)
    return df.sparkSession.read.parquet(listing)


def _named(df):
    return df.withColumn("os_path", F.regexp_extract("os_path", r"([^/]+)\.bin$", 1)).drop("case_id")


def _stream_ranges(spark, sf):
    streams = write_streams(spark, sf, shared_dir(spark, "usn"))
    return streams.select("case_id", "os_path", F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("start"), F.col("size").alias("length"))


@query("usn_1_record_split", USN_SQL)
def usn_1(spark, sf):
    records, _ = usn.split_usn(_stream_ranges(spark, sf), piece=usn.CHUNK)
    return _usn_output(usn.usn_rows(usn.decode_usn(records)))


@query(
    "usn_1_split_diagnostics",
    "SELECT CAST(s AS BIGINT) AS stream, problem, amount FROM (SELECT DISTINCT event_id // 400 AS s FROM events), (VALUES ('zero_padding', 512), ('trailing', 12)) p(problem, amount)",
)
def usn_1b(spark, sf):
    _, problems = usn.split_usn(_stream_ranges(spark, sf), piece=usn.CHUNK)
    return problems.select(F.regexp_extract("os_path", r"(\d+)\.bin$", 1).cast("bigint").alias("stream"), "problem", "amount")


@query(
    "src_3_byte_ranges",
    f"""SELECT CAST(event_id // 400 AS BIGINT) AS stream, CAST(512 + 12 + sum(CASE WHEN {V3} THEN (76 + 2 * (length(event_type) + 5) + 7) // 8 * 8 ELSE (60 + 2 * (length(event_type) + 5) + 7) // 8 * 8 END) AS BIGINT) AS n_bytes
        FROM events GROUP BY 1""",
)
def src_3(spark, sf):
    data = read_ranges(_stream_ranges(spark, sf), piece=16384)
    return data.groupBy(F.regexp_extract("os_path", r"(\d+)\.bin$", 1).cast("bigint").alias("stream")).agg(F.sum(F.length("bytes")).cast("bigint").alias("n_bytes"))


@query("lim_2_file_tail", TAIL_SQL)
def lim_2_files(spark, sf):
    """Last lines of documents as files, of which only the last bytes are read."""
    docs = read(spark, sf, "documents").select(F.col("source").alias("case_id"), F.concat(F.lit("d"), "doc_id").alias("os_path"), F.encode("text", "UTF-8").alias("content"))
    out = lines.tail_file_lines(written_files(docs, shared_dir(spark, "tails")), 3, 512)
    return out.select("case_id", F.regexp_extract("os_path", r"([^/]+)\.bin$", 1).alias("os_path"), "from_end", F.octet_length("line").cast("bigint").alias("n_bytes"))


# ---- other binary artifacts --------------------------------------------------------------


def _info2_files(spark, sf):
    """One INFO2 file per customer with entries from its orders: version with wide names when even."""
    o = read(spark, sf, "orders")
    wide = F.col("o_custkey") % 2 == 0
    name = F.concat(F.lit("C:\\f"), "o_orderkey")
    used = F.col("o_orderkey") % 10 != 0
    ascii_name = F.rpad(F.when(used, F.hex(F.encode(name, "UTF-8"))).otherwise(""), 520, "0")
    ticks = F.when(used, F.lit(132537600000000000) + F.col("o_orderkey")).otherwise(0)
    entry = F.concat(ascii_name, le_bytes(F.col("o_orderkey"), 4), le_bytes(F.lit(2), 4), le_bytes(ticks, 8), le_bytes(F.when(used, F.col("o_orderkey") % 1000 + 1).otherwise(0), 4))
    entry = F.concat(entry, F.when(wide, F.rpad(F.when(used, F.hex(F.encode(F.concat(name, F.lit("ü")), "UTF-16LE"))).otherwise(""), 1040, "0")).otherwise(""))
    grouped = o.select("o_custkey", "o_orderkey", entry.alias("e")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "e"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["e"]), "")
    header = F.concat(le_bytes(F.when(F.col("o_custkey") % 50 == 7, 4).otherwise(5), 4), le_bytes(F.when(F.col("o_custkey") % 3 == 0, 2).otherwise(0), 4), le_bytes(F.lit(0), 4), le_bytes(F.when(wide, 800).otherwise(280), 4), le_bytes(F.lit(0), 4))
    return grouped.select(F.lit("host").alias("case_id"), F.col("o_custkey").cast("string").alias("os_path"), F.unhex(F.concat(header, body)).alias("content"))


@query(
    "inf_1_info2",
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
        SELECT CAST(o_custkey AS VARCHAR) AS os_path, 20 + (n - 1) * CASE WHEN o_custkey % 2 = 0 THEN 800 ELSE 280 END AS "offset", o_orderkey AS record_index, 2 AS drive_number, o_orderkey % 1000 + 1 AS file_size,
        'C:' || chr(92) || 'f' || o_orderkey || CASE WHEN o_custkey % 2 = 0 THEN 'ü' ELSE '' END AS original_filename,
        CASE WHEN o_custkey % 2 = 0 THEN 'C:' || chr(92) || 'f' || o_orderkey END AS short_filename,
        strftime(make_timestamp(1609286400000000 + o_orderkey // 10), '%Y-%m-%dT%H:%M:%S.%f') || (o_orderkey % 10) || '00Z' AS deletion_time
        FROM e WHERE o_custkey % 50 <> 7 AND o_orderkey % 10 <> 0 AND (o_custkey % 3 <> 0 OR n <= 2)""",
)
def inf_1(spark, sf):
    return artifacts.parse_info2(_info2_files(spark, sf)).select(
        "os_path", "offset", "record_index", "drive_number", "file_size", "original_filename", "short_filename", "deletion_time"
    )


@query(
    "run_4_error_isolation",
    "SELECT CAST(o_custkey AS VARCHAR) AS os_path, 'unsupported format signature: 4' AS error FROM orders WHERE o_custkey % 50 = 7 GROUP BY o_custkey",
)
def run_4(spark, sf):
    return artifacts.split_errors(artifacts.decode_info2(_info2_files(spark, sf)))[1].select("os_path", "error")


@query(
    "rpl_1_restore_point_log",
    """SELECT CAST(event_id AS VARCHAR) AS os_path, 'point ' || event_type AS description, event_id % 5 AS restore_point_event_type, event_id % 7 AS restore_point_type, event_id AS sequence_number,
        strftime(make_timestamp(1609286400000000 + event_id), '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS creation_time FROM events WHERE event_id % 20 <> 0""",
)
def rpl_1(spark, sf):
    e = F.col("event_id")
    full = F.concat(
        le_bytes(e % 5, 4), le_bytes(e % 7, 4), le_bytes(e, 8), F.hex(F.encode(F.concat(F.lit("point "), "event_type"), "UTF-16LE")), F.lit("00000000"),
        le_bytes(F.lit(132537600000000000) + e * 10, 8),
    )
    content = F.unhex(F.when(e % 20 == 0, F.substring(full, 1, 40)).otherwise(full))
    files = read(spark, sf, "events").select(F.lit("host").alias("case_id"), e.cast("string").alias("os_path"), content.alias("content"))
    return artifacts.parse_rp_log(files).select(
        "os_path", "description", "restore_point_event_type", "restore_point_type", F.col("sequence_number").cast("bigint").alias("sequence_number"), "creation_time"
    )


def _paged(spark, sf, size: int, magics: tuple[str, str]):
    """Document bytes in pages of ``size`` whose starts are overwritten by a signature."""
    docs = read(spark, sf, "documents")
    body = F.hex(F.encode("text", "UTF-8"))
    pages = F.transform(
        F.sequence(F.lit(0), F.call_function("div", F.length(body), F.lit(2 * size)).cast("int")),
        lambda i: F.concat(
            F.when((F.col("doc_id") + i) % 3 == 0, magics[0].encode().hex()).otherwise(magics[1].encode().hex()),
            F.substring(body, i * 2 * size + 9, F.lit(2 * size - 8)),
        ),
    )
    return docs.select(F.lit("host").alias("case_id"), F.col("doc_id").cast("string").alias("os_path"), F.unhex(F.array_join(pages, "")).alias("content"))


# pages of a document: whole ones, plus a last one that always keeps its four signature bytes
PAGES = "octet_length(encode(text)) // {s} AS whole, greatest(octet_length(encode(text)) % {s}, 4) AS rest"


SAMPLE_SQL = (
    f"""SELECT CAST(doc_id AS VARCHAR) AS os_path, n AS sampled, CASE WHEN n > 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'FILE' ELSE 'RCRD' END END AS first_signature,
        len(list_filter(range(n), lambda i: (doc_id + i) % 3 = 0)) AS file_count, CAST(0 AS BIGINT) AS baad_count, CAST(0 AS BIGINT) AS rstr_count, len(list_filter(range(n), lambda i: (doc_id + i) % 3 <> 0)) AS rcrd_count,
        n > 0 AND doc_id % 3 = 0 AS mft_ok, len(list_filter(range(n), lambda i: (doc_id + i) % 3 <> 0)) > 0 AS log_ok
        FROM (SELECT doc_id, least(whole, 64) AS n FROM (SELECT doc_id, {PAGES.format(s=256)} FROM documents))"""
)


@query(
    "agg_7_signature_sample",
    SAMPLE_SQL,
)
def agg_7(spark, sf):
    return artifacts.sample_signatures(_paged(spark, sf, 256, ("FILE", "RCRD")), 256).drop("case_id")


@query("agg_7_file_signatures", SAMPLE_SQL)
def agg_7_files(spark, sf):
    """The same over files, of which only the sampled records are read."""
    files = written_files(_paged(spark, sf, 256, ("FILE", "RCRD")), shared_dir(spark, "paged"))
    return _named(artifacts.sample_file_signatures(files, 256))


PAGE_SQL = (
    f"""SELECT CAST(doc_id AS VARCHAR) AS os_path, whole + 1 AS expected_buffers, len(list_filter(range(whole + 1), lambda i: (doc_id + i) % 3 = 0)) AS signature_buffers
        FROM (SELECT doc_id, {PAGES.format(s=4096)} FROM documents)"""
)


@query(
    "agg_8_page_signatures",
    PAGE_SQL,
)
def agg_8(spark, sf):
    return artifacts.count_page_signatures(_paged(spark, sf, 4096, ("INDX", "none"))).drop("case_id")


@query("agg_8_file_page_signatures", PAGE_SQL)
def agg_8_files(spark, sf):
    """The same over files, by pieces; four bytes a page leave the reader."""
    files = written_files(_paged(spark, sf, 4096, ("INDX", "none")), shared_dir(spark, "paged"))
    return _named(artifacts.count_file_page_signatures(files))


@query(
    "agg_6_attribute_tally",
    """SELECT l_suppkey, count(*) AS attributes, count(*) FILTER (l_returnflag = 'A') AS index_root, count(*) FILTER (l_returnflag = 'N') AS index_allocation, count(*) FILTER (l_returnflag = 'R') AS bitmap,
        CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS expected_buffers, CAST(coalesce(sum(CAST(l_linenumber AS BIGINT)) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS signature_buffers FROM lineitem GROUP BY l_suppkey""",
)
def agg_6(spark, sf):
    kinds = F.when(F.col("l_returnflag") == "A", "index_root").when(F.col("l_returnflag") == "N", "index_allocation").otherwise("bitmap")
    entries = read(spark, sf, "lineitem").select("l_suppkey", kinds.alias("attribute"), F.col("l_quantity").cast("bigint").alias("expected_buffers"), F.col("l_linenumber").cast("bigint").alias("signature_buffers"))
    return artifacts.attribute_tally(entries, ["l_suppkey"])


