"""Lines, shell history and protection logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.scalars import MPLOG_TIME_COLUMNS
from bindings.views import cte, read, view
from casework.operators import lines, mplog
from casework.sinks.results import with_provenance

# small chunks, so that the carried state is exercised on these tables too


def _document_files(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.select(
        F.col("source").alias("case_id"), F.concat(F.lit("d"), "doc_id").alias("os_path"), F.encode("text", "UTF-8").alias("content")
    )


DOC_LINES = """dl AS (SELECT source AS case_id, 'd' || doc_id AS os_path, unnest(string_split(text, chr(10))) AS part,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no, len(string_split(text, chr(10))) AS n FROM documents)"""


@query(
    "src_4_text_lines",
    f"WITH {DOC_LINES} SELECT case_id, os_path, line_no, md5(part) AS line_md5, 'utf-8' AS encoding FROM dl WHERE line_no < n OR part <> ''",
)
def src_4(spark, sf):
    return lines.read_lines(_document_files(spark, sf)).select("case_id", "os_path", "line_no", F.md5("line").alias("line_md5"), "encoding")


def _indented(spark, sf):
    df = lines.read_lines(_document_files(spark, sf))
    return df.withColumn("line", F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("  "), "line")).otherwise(F.col("line")))


WS = "' ' || chr(9) || chr(13)"


@query(
    "win_1_continuation_merge",
    f"""WITH {DOC_LINES}, k AS (SELECT case_id, os_path, line_no, rtrim(CASE WHEN line_no % 5 = 0 THEN '  ' || part ELSE part END, {WS}) AS line FROM dl),
        h AS (SELECT *, sum(CASE WHEN starts_with(line, ' ') THEN 0 ELSE 1 END) OVER (PARTITION BY case_id, os_path ORDER BY line_no) AS rec FROM k WHERE trim(line, {WS}) <> '')
        SELECT case_id, os_path, min(line_no) AS line_no, md5(string_agg(trim(line, {WS}), chr(10) ORDER BY line_no)) AS message_md5,
               md5(string_agg(line, chr(10) ORDER BY line_no)) AS raw_md5, count(*) AS n_lines FROM h GROUP BY case_id, os_path, rec""",
)
def win_1(spark, sf):
    out = lines.merge_continuations(_indented(spark, sf))
    return out.select("case_id", "os_path", "line_no", F.md5("message").alias("message_md5"), F.md5("raw").alias("raw_md5"), "n_lines")


SHELL = r""", s AS (SELECT case_id, os_path, line_no, trim(line) AS line FROM v_shell WHERE trim(line) <> ''),
    m AS (SELECT *, regexp_matches(line, '^#[1-9][0-9]*$') AS marker, regexp_matches(line, '^: [0-9]+:[^;]*;') AS zsh FROM s),
    q AS (SELECT *, max(CASE WHEN marker THEN line_no END) OVER w AS mpos,
        last_value(CASE WHEN marker THEN CAST(substring(line, 2) AS BIGINT) END IGNORE NULLS) OVER w AS mts,
        max(CASE WHEN NOT marker AND NOT zsh THEN line_no END) OVER w AS ppos
        FROM m WINDOW w AS (PARTITION BY case_id, os_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT case_id, os_path, line_no, CASE WHEN zsh THEN regexp_extract(line, '^: [0-9]+:[^;]*;(.*)$', 1) ELSE line END AS command,
        strftime(make_timestamp(1000000 * CASE WHEN zsh THEN CAST(regexp_extract(line, '^: ([0-9]+):', 1) AS BIGINT) WHEN mpos > coalesce(ppos, -1) THEN mts END), '%Y-%m-%dT%H:%M:%SZ') AS timestamp
        FROM q WHERE NOT marker)"""


@query("win_2_pending_time", cte("v_shell") + SHELL + " SELECT * FROM r")
def win_2(spark, sf):
    return lines.attach_pending_time(view(spark, sf, "v_shell"))


@query(
    "shl_1_shell_history",
    cte("v_shell") + SHELL + " SELECT case_id, 'bash' AS shell, regexp_extract(os_path, '^home/([^/]+)/', 1) AS \"user\", command, line_no AS line_number, os_path, timestamp FROM r",
)
def shl_1(spark, sf):
    return lines.shell_rows(view(spark, sf, "v_shell"))


TAIL_SQL = (
    f"""WITH f AS (SELECT source AS case_id, 'd' || doc_id AS os_path, encode(text) AS b FROM documents),
        t AS (SELECT case_id, os_path, octet_length(b) > 512 AS cut, CASE WHEN octet_length(b) > 512 THEN hex(b)[-1024:] ELSE hex(b) END AS h FROM f),
        l AS (SELECT case_id, os_path, cut, h, unnest(string_split(regexp_replace(h, '(..)', '\\1 ', 'g'), '0A ')) AS part,
              generate_subscripts(string_split(regexp_replace(h, '(..)', '\\1 ', 'g'), '0A '), 1) AS no FROM t),
        k AS (SELECT * FROM l WHERE NOT (cut AND no = 1 AND h NOT LIKE '0A%') AND NOT (part = '' AND no = (SELECT max(no) FROM l AS o WHERE o.os_path = l.os_path))),
        r AS (SELECT *, row_number() OVER (PARTITION BY case_id, os_path ORDER BY no DESC) AS from_end FROM k)
        SELECT case_id, os_path, from_end, CAST(octet_length(unhex(replace(part, ' ', ''))) AS BIGINT) AS n_bytes FROM r WHERE from_end <= 3""".replace("\\\\1", "\\1")
)


@query(
    "lim_2_tail",
    TAIL_SQL,
)
def lim_2(spark, sf):
    out = lines.tail_lines(_document_files(spark, sf), 3, 512)
    # a replaced byte of a character cut at the start only occurs in the dropped first line
    return out.select("case_id", "os_path", "from_end", F.octet_length("line").cast("bigint").alias("n_bytes"))


# ---- protection logs ---------------------------------------------------------------------


def _log(spark, sf):
    return view(spark, sf, "v_log")


RAW = f"raw AS (SELECT *, {MPLOG_TIME_COLUMNS} FROM v_log)"
U = "CAST(user_id AS VARCHAR)"
# (component, level, rest) of each template, and its fields as sorted k=v text
PARSED = {
    0: ("'Engine'", "NULL", f"""'Setting original file name "app' || {U} || '" for "c:' || chr(92) || 'dir' || chr(92) || 'app' || event_id || '.dll", hr=0x0'"""),
    1: ("'RTP'", "NULL", f"""'Engine scan: ' || chr(92) || 'Device' || chr(92) || 'HarddiskVolume4' || chr(92) || 'f' || event_id || '.exe. status=0x4005, threatid=0x8' || {U} || ', sigseq=0x55'"""),
    2: ("'C'", "NULL", f"""chr(92) || 'Users' || chr(92) || 'u' || {U} || chr(92) || 'cont' || event_id"""),
    3: ("NULL", "'Warning'", "'the previous shutdown was not expected'"),
    4: ("NULL", "NULL", "'Beginning quarantine recovery'"),
    5: ("'IDynamicConfig'", "NULL", "'value=MpBlockLevel hr=0x8007000d'"),
    6: ("NULL", "'Info'", f"'something=Eicar' || {U} || ', status=0'"),
    7: ("NULL", "NULL", "''"),
}


def _cases(index: int) -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {v[index]}" for k, v in PARSED.items()) + " END"


@query(
    "mpl_1_component",
    cte("v_log") + f""" SELECT event_id, CASE WHEN event_id % 8 = 2 THEN NULL ELSE {_cases(0)} END AS component, {_cases(1)} AS level,
        CASE WHEN event_id % 8 = 2 THEN 'C:' || {_cases(2)} ELSE {_cases(2)} END AS rest,
        CASE event_id % 8 WHEN 1 THEN 'subcomponent=MpRtp' WHEN 5 THEN 'operation=ReportError' ELSE '' END AS fields FROM v_log""",
)
def mpl_1(spark, sf):
    from casework.functions.time import mplog_time

    df = _log(spark, sf).select("event_id", mplog_time(F.col("line"))["rest"].alias("rest"))
    df = df.select("event_id", mplog.component(F.col("rest")).alias("c"))
    return df.select("event_id", "c.component", "c.level", "c.rest", map_text(F.col("c.fields")).alias("fields"))


def map_text(m):
    """Sorted ``k=v`` text of a map."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query(
    "mpl_2_fields",
    "SELECT event_id, 'bad=hr=0x' || lower(hex(event_id)) || ';data=word ' || user_id || ';event_type=' || event_type || ';hresult=second;k_v={' || value || '}' || CASE WHEN event_id % 2 = 0 THEN ';path=c:' || chr(92) || 'x y' || chr(92) || event_id ELSE '' END AS fields FROM (SELECT * REPLACE (CAST(user_id * 2 AS VARCHAR) AS value) FROM events)",
)
def mpl_2(spark, sf):
    e = read(spark, sf, "events")
    body = F.concat(
        F.lit("noise/bad: hr="), F.concat(F.lit("0x"), F.lower(F.hex("event_id"))), F.lit(", K v: {"), (F.col("user_id") * 2).cast("string"), F.lit('} Event Type="'),
        F.col("event_type"), F.lit('" hr=second; data=word '), F.col("user_id").cast("string"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" Target=c:\\x y\\"), F.col("event_id").cast("string"))).otherwise(F.lit("")),
    )
    return mplog.extract_fields(e.select("event_id", body.alias("b")), F.col("b")).select("event_id", map_text(F.col("fields")).alias("fields"))


@query(
    "mpl_2_plain_fields",
    "SELECT event_id, 'e_type=' || event_type || ';user=' || user_id || ';value=' || event_id AS fields FROM events",
)
def mpl_2b(spark, sf):
    body = F.concat(F.lit("value="), F.col("event_id"), F.lit(", user="), F.col("user_id"), F.lit(" e-type="), F.col("event_type"))
    df = read(spark, sf, "events").select("event_id", body.alias("b"))
    return mplog.extract_fields(df, F.col("b")).select("event_id", map_text(F.col("fields")).alias("fields"))


QUOTED = "regexp_extract(line, '\"([A-Za-z]:' || chr(92) || chr(92) || '[^\"]+)\"', 1)"
DEVICE = "rtrim(regexp_extract(line, '(' || chr(92) || chr(92) || 'Device' || chr(92) || chr(92) || '[^,]+)', 1), '.')"
PLAIN = "regexp_extract(trim(line), '([A-Za-z]:' || chr(92) || chr(92) || '[^,;]+)', 1)"
PATH_FROM_LINE = f"coalesce(nullif({QUOTED}, ''), nullif({DEVICE}, ''), nullif({PLAIN}, ''))"
HR = "nullif(regexp_extract(line, '(hr|hresult)\\s*=\\s*(0x[0-9a-fA-F]+|[0-9]+)', 2), '')"


def _no_fields():
    return F.from_json(F.lit("{}"), "map<string,string>")


@query(
    "mpl_3_inferred_fields",
    cte("v_log") + f""" SELECT event_id, concat_ws(';', CASE WHEN h IS NOT NULL THEN 'hresult=' || h END,
        CASE WHEN event_id % 8 = 0 THEN 'original_file_name=app' || user_id END, CASE WHEN p IS NOT NULL THEN 'path=' || p END) AS fields
        FROM (SELECT *, {HR} AS h, {PATH_FROM_LINE} AS p FROM v_log)""",
)
def mpl_3(spark, sf):
    return _log(spark, sf).select("event_id", map_text(mplog.infer_fields(F.col("line"), _no_fields())).alias("fields"))


@query(
    "mpl_4_path",
    cte("v_log") + f" SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'from_field' ELSE {PATH_FROM_LINE} END AS path FROM v_log",
)
def mpl_4(spark, sf):
    given = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("target"), F.lit("from_field"))).otherwise(_no_fields())
    return _log(spark, sf).select("event_id", mplog.infer_path(F.col("line"), given).alias("path"))


def _hr_fields():
    return F.create_map(F.lit("hresult"), F.when(F.col("event_id") % 3 == 0, "0x80070005").otherwise("0x0"))


LEVEL = """CASE WHEN contains(lower(line), ' warning') THEN 'Warning' WHEN contains(lower(line), 'reporterror') OR event_id % 3 = 0 THEN 'Error' END"""


@query("mpl_5_level", cte("v_log") + f" SELECT event_id, {LEVEL} AS level FROM v_log")
def mpl_5(spark, sf):
    return _log(spark, sf).select("event_id", mplog.infer_level(F.col("line"), _hr_fields()).alias("level"))


@query(
    "mpl_6_event_type",
    """SELECT doc_id, CASE WHEN contains(t, 'quarantine') THEN 'Quarantine' WHEN doc_id % 11 = 0 OR contains(t, 'threat') OR contains(t, 'malware') THEN 'Threat'
        WHEN contains(t, 'detected') THEN 'Detection' WHEN contains(t, 'remediat') OR contains(t, 'clean') THEN 'Remediation' WHEN contains(t, 'scan') OR doc_id % 13 = 0 THEN 'Scan'
        WHEN contains(t, 'tamper') THEN 'TamperProtection' WHEN contains(t, 'cloud') OR contains(t, 'maps') THEN 'CloudProtection' WHEN contains(t, 'exclusion') OR contains(t, 'excluded') THEN 'Exclusion'
        WHEN contains(t, 'security intelligence') OR contains(t, 'signature') OR contains(t, 'sigseq') OR contains(t, 'sigsha') OR contains(t, 'engine version') OR contains(t, 'platform version') OR contains(t, 'definition') THEN 'Update'
        WHEN doc_id % 5 = 0 OR contains(t, '[rtp]') OR contains(t, 'real-time') OR contains(t, 'realtime') THEN 'RealTimeProtection' WHEN contains(t, 'platform') THEN 'Platform'
        WHEN doc_id % 5 = 1 THEN 'Engine' ELSE CASE doc_id % 4 WHEN 0 THEN 'Error' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Info' ELSE 'Unknown' END END AS event_type
        FROM (SELECT doc_id, translate(CASE doc_id % 7 WHEN 0 THEN 'Tamper ' WHEN 1 THEN 'Security Intelligence ' WHEN 2 THEN 'PLATFORM ' WHEN 3 THEN 'Excluded ' WHEN 4 THEN 'maps ' ELSE '' END || text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)""",
)
def mpl_6(spark, sf):
    d = F.col("doc_id")
    head = F.when(d % 7 == 0, "Tamper ").when(d % 7 == 1, "Security Intelligence ").when(d % 7 == 2, "PLATFORM ").when(d % 7 == 3, "Excluded ").when(d % 7 == 4, "maps ").otherwise("")
    fields = (
        F.when(d % 11 == 0, F.create_map(F.lit("threat_id"), F.lit("1"))).when(d % 13 == 0, F.create_map(F.lit("scan_request"), F.lit("1"))).otherwise(_no_fields())
    )
    comp = F.when(d % 5 == 0, "MpRtp").when(d % 5 == 1, "ENGINE")
    level = F.when(d % 4 == 0, "Error").when(d % 4 == 1, "Warning").when(d % 4 == 2, "Info")
    df = read(spark, sf, "documents").select("doc_id", F.concat(head, F.col("text")).alias("line"))
    return df.select("doc_id", mplog.classify_event(F.col("line"), fields, comp, level).alias("event_type"))


@query(
    "mpl_7_action",
    cte("v_log") + " SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'remove' WHEN event_id % 8 = 4 THEN 'begin_quarantine_recovery' END AS action FROM v_log",
)
def mpl_7(spark, sf):
    given = F.when(F.col("event_id") % 10 == 0, F.create_map(F.lit("remediation"), F.lit("remove"))).otherwise(_no_fields())
    return _log(spark, sf).select("event_id", mplog.infer_action(F.col("line"), given).alias("action"))


# One row per record: continuation lines (template 2) belong to the record before, blanks vanish, and a
# file that opens with continuation lines has them as one record of their own.
RECORDS = f"""h AS (SELECT *, sum(CASE WHEN event_id % 8 = 2 THEN 0 ELSE 1 END) OVER (PARTITION BY case_id, os_path ORDER BY line_no) AS rec FROM raw WHERE event_id % 8 <> 7),
    g AS (SELECT case_id, os_path, rec, min(line_no) AS line_no, md5(string_agg(trim(line), chr(10) ORDER BY line_no)) AS message_md5, arg_min(line, line_no) AS head,
          arg_min(event_id, line_no) AS event_id, arg_min(user_id, line_no) AS user_id, arg_min(raw, line_no) AS timestamp_raw, arg_min(utc, line_no) AS timestamp_utc,
          list(line ORDER BY line_no)[2:] AS later FROM h GROUP BY case_id, os_path, rec),
    p AS (SELECT *, event_id % 8 AS k, CAST(user_id AS VARCHAR) AS u FROM g)"""


@query(
    "mpl_8_records",
    cte("v_log") + f""", {RAW}, {RECORDS}
        SELECT case_id, os_path, line_no, message_md5, timestamp_raw, timestamp_utc,
        CASE WHEN k IN (3) THEN 'Warning' WHEN k = 5 THEN 'Error' WHEN k = 6 THEN 'Info' END AS level,
        CASE k WHEN 0 THEN 'Engine' WHEN 1 THEN 'RTP' WHEN 2 THEN NULL WHEN 5 THEN 'IDynamicConfig' END AS component,
        CASE k WHEN 0 THEN 'Engine' WHEN 1 THEN 'Threat' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'Warning' WHEN 4 THEN 'Quarantine' WHEN 5 THEN 'Error' ELSE 'Info' END AS event_type,
        CASE WHEN k = 1 THEN '0x8' || u END AS threat_id,
        CASE k WHEN 0 THEN 'c:' || chr(92) || 'dir' || chr(92) || 'app' || event_id || '.dll' WHEN 1 THEN chr(92) || 'Device' || chr(92) || 'HarddiskVolume4' || chr(92) || 'f' || event_id || '.exe. status=0x4005'
             WHEN 2 THEN trim(head) ELSE nullif(trim(later[1]), '') END AS path,
        CASE WHEN k = 4 THEN 'begin_quarantine_recovery' END AS action,
        CASE k WHEN 1 THEN '0x4005' WHEN 6 THEN '0' END AS result, CASE k WHEN 0 THEN '0x0' WHEN 5 THEN '0x8007000d' END AS hresult FROM p""",
)
def mpl_8(spark, sf):
    df = _log(spark, sf).select(
        "case_id", "os_path", "line_no", "line", F.lit("utf-8").alias("encoding"), F.lit(False).alias("decode_lossy"), F.lit("").alias("source_sha256")
    )
    out = mplog.parse_mplog_lines(df)
    return out.select(
        "case_id", "os_path", "line_no", F.md5("message").alias("message_md5"), "timestamp_raw", "timestamp_utc", "level", "component",
        "event_type", "threat_id", "path", "action", "result", "hresult",
    )


@query(
    "snk_3_provenance",
    "SELECT event_id, 'family' AS export_parser, event_type AS export_artifact, 'case' || user_id || '.zip' AS export_input_zip, event_type || '.jsonl' AS export_output_file FROM events",
)
def snk_3(spark, sf):
    df = read(spark, sf, "events").select("event_id", "event_type", "user_id")
    out = with_provenance(
        df, F.lit("family"), F.col("event_type"), F.concat(F.lit("case"), "user_id", F.lit(".zip")),
        F.concat(F.lit("/results/family/"), "event_type", F.lit(".jsonl")),
    )
    return out.drop("event_type", "user_id")


