"""Sources, sinks and streams, over files that Spark first writes from the tables."""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from bindings.discovery import SLUG, WITH, WITH_DETECTED
from bindings.logs import RAW, RECORDS
from bindings.registry import query
from bindings.tables import STATE
from bindings.views import cte, read, view
from casework.functions import paths
from casework.operators import detect as det, runs
from casework.operators.browser import timeline_activity
from casework.plans import decoders, parse
from casework.session import shared_dir
from casework.sinks import results
from casework.sources import files as src, records, sqlite, textlines
from casework.streaming import events as ev, landing


def write_packages(files, folder: str) -> None:
    """Zip packages of a bounded number of files each, one per case, as evidence to read back."""

    def build(key, table):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for row in table.sort_by("archive_path").to_pylist():
                archive.writestr(zipfile.ZipInfo(row["archive_path"]), row["content"])
            hurt = [archive.getinfo(r["archive_path"]).header_offset + 30 + len(r["archive_path"].encode()) for r in table.to_pylist() if r["damaged"]]
        for at in hurt:  # a byte of the stored content
            view = buffer.getbuffer()
            view[at] ^= 0xFF
            view.release()
        filesystem, path = src.located(folder)
        filesystem.create_dir(path, recursive=True)
        with filesystem.open_output_stream(f"{path}/{key[0].as_py()}.zip") as out:
            out.write(buffer.getvalue())
        return pa.table({"case_id": [key[0].as_py()]})

    damaged = F.col("damaged") if "damaged" in files.columns else F.lit(False)
    grouped = files.select("case_id", "archive_path", "content", damaged.alias("damaged")).groupBy("case_id")
    grouped.applyInArrow(build, "case_id string").write.format("noop").mode("overwrite").save()


def _document_files(spark, sf):
    """Documents as files of packages of a hundred each."""
    d = F.col("doc_id")
    return read(spark, sf, "documents").select(
        F.concat(F.lit("case"), F.call_function("div", d, F.lit(100))).alias("case_id"),
        F.concat(F.lit("C/docs/"), d, F.lit(".txt")).alias("archive_path"), F.encode("text", "UTF-8").alias("content"),
    )


def _packages(spark, sf) -> str:
    folder = shared_dir(spark, "packages of #1 100%")  # blanks, # and % belong to the name
    write_packages(_document_files(spark, sf), folder)
    return folder


DOCUMENT_FILES = "SELECT 'case' || (doc_id // 100) AS case_id, 'C/docs/' || doc_id || '.txt' AS archive_path, 'C' AS volume, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents"


@query("src_1_packages", DOCUMENT_FILES)
def src_1(spark, sf):
    out = src.read_packages(spark, _packages(spark, sf), fail_fast=True)
    return out.select("case_id", "archive_path", "volume", "size", F.sha2("content", 256).alias("sha256"))


@query("src_2_tree", DOCUMENT_FILES)
def src_2(spark, sf):
    members = src.list_packages(spark, _packages(spark, sf))
    folder = shared_dir(spark, "tree")
    parse.extract_members(members, folder).write.format("noop").mode("overwrite").save()
    return src.read_tree(spark, folder).select("case_id", "archive_path", "volume", "size", F.sha2("content", 256).alias("sha256"))


@query(
    "src_4_split_lines",
    """WITH f AS (SELECT source, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents GROUP BY source),
        l AS (SELECT source, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no, len(string_split(body, chr(10))) AS n FROM f)
        SELECT source, line_no, md5(line) AS line_md5, 'utf-8' AS encoding, false AS decode_lossy FROM l WHERE line_no < n""",
)
def src_4_split(spark, sf):
    """All texts of a source as one file, read in pieces of 64 KiB."""
    docs = read(spark, sf, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    folder = shared_dir(spark, "texts")
    docs.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").text(folder)
    tree = src.read_tree(spark, folder, glob="part-*", with_content=False)
    files = tree.select(F.substring_index("case_id", "=", -1).alias("case_id"), "os_path", F.col("os_path").alias("path"), "size")
    lines, _ = textlines.scan_text(files, piece=65_536)
    return lines.select(F.col("case_id").alias("source"), "line_no", F.md5("line").alias("line_md5"), "encoding", "decode_lossy")


@query(
    "det_4_hives_in_packages",
    "SELECT 'case' || (doc_id // 100) AS case_id, count(*) FILTER (WHERE doc_id % 3 = 0) AS hives, count(*) AS shimcaches FROM documents GROUP BY 1",
)
def det_4_packages(spark, sf):
    """Documents as members named SYSTEM, a third of which begin as a hive does."""
    d = F.col("doc_id")
    files = _document_files(spark, sf).withColumn("doc_id", F.regexp_extract("archive_path", r"(\d+)\.txt$", 1).cast("bigint"))
    head = F.when(d % 3 == 0, F.lit(b"regf")).otherwise(F.lit(b"text"))
    files = files.select("case_id", F.concat(F.lit("C/h"), d, F.lit("/SYSTEM")).alias("archive_path"), F.concat(head, F.coalesce("content", F.lit(b""))).alias("content"))
    folder = shared_dir(spark, "hives")
    write_packages(files, folder)
    found = parse.without_wrong_magic(det.detect(parse.package_files(src.list_packages(spark, folder))))
    of = lambda family: F.count_if(F.col("family") == family)
    return found.groupBy("case_id").agg(of("windows_registry").alias("hives"), of("windows_shimcache").alias("shimcaches"))


def _databases(spark, sf):
    """An activity database per hundred events, as files."""

    def build(key, table):
        connection = sqlite3.connect(":memory:")
        connection.execute("CREATE TABLE Activity (AppId TEXT, LastModifiedTime)")
        rows = [(r["app"], r["event_id"]) for r in table.to_pylist()]
        connection.executemany("INSERT INTO Activity VALUES (?, ?)", rows)
        connection.commit()
        return pa.table({"case_id": ["host"], "os_path": [f"C/Users/ann/{key[0].as_py()}/ActivitiesCache.db"], "content": [connection.serialize()]})

    e = read(spark, sf, "events").select(
        F.call_function("div", F.col("event_id"), F.lit(100)).alias("db"), "event_id", F.concat(F.lit('["'), "event_type", F.lit('"]')).alias("app")
    )
    built = e.groupBy("db").applyInArrow(build, "case_id string, os_path string, content binary")
    broken = built.select("case_id", F.concat("os_path", F.lit(".bad")).alias("os_path"), F.encode(F.lit("not a database, just text"), "UTF-8").alias("content"))
    return built.unionByName(broken)


@query(
    "src_5_sqlite_tables",
    "SELECT 'C/Users/ann/' || (event_id // 100) || '/ActivitiesCache.db' AS os_path, 'ann' AS \"user\", event_type AS application, CAST(event_id AS VARCHAR) AS last_modified FROM events",
)
def src_5(spark, sf):
    rows, _ = sqlite.read_sqlite_table(_databases(spark, sf), "Activity", sqlite.TIMELINE_TABLES["Activity"])
    return timeline_activity(rows).select("os_path", "user", "application", "last_modified")


@query("src_5_unreadable_databases", "SELECT DISTINCT 'C/Users/ann/' || (event_id // 100) || '/ActivitiesCache.db.bad' AS os_path FROM events")
def src_5b(spark, sf):
    return sqlite.read_sqlite_table(_databases(spark, sf), "Activity", sqlite.TIMELINE_TABLES["Activity"])[1].select("os_path")


def _manifest_files(spark, sf):
    """A prefetch collector manifest per two hundred events."""
    e = read(spark, sf, "events").withColumn("no", F.call_function("div", F.col("event_id"), F.lit(200)))
    item = F.struct(F.concat(F.lit("C/p/"), "event_id").alias("archive_path"), F.col("event_type").alias("artifact_kind"), F.col("event_id").alias("size"))
    grouped = e.groupBy("no").agg(F.array_sort(F.collect_list(item)).alias("files"))
    body = F.to_json(F.struct(F.lit("C").alias("volume"), F.lit("succeeded").alias("collection_status"), "files"))
    path = paths.manifest_path(F.lit("C"), F.lit("windows_prefetch"))
    return grouped.select(
        F.concat(F.lit("case"), "no").alias("case_id"), path.alias("os_path"), path.alias("archive_path"), F.lit("C").alias("volume"), F.encode(body, "UTF-8").alias("content")
    )


@query(
    "src_6_collector_manifests",
    "SELECT 'case' || (event_id // 200) AS case_id, 'C' AS volume, 'succeeded' AS collection_status, 'C/p/' || event_id AS archive_path, event_type AS artifact_kind, event_id AS size FROM events",
)
def src_6(spark, sf):
    out = records.read_collector_manifests(_manifest_files(spark, sf), "windows_prefetch")
    return out.select("case_id", "volume", "collection_status", "archive_path", "artifact_kind", "size")


@query("src_7_result_lines", "SELECT event_id, user_id, event_type, true AS has_file FROM events")
def src_7(spark, sf):
    folder = shared_dir(spark, "results")
    read(spark, sf, "events").select("event_id", "user_id", "event_type").write.json(folder)
    out = records.read_results(spark, folder, "event_id bigint, user_id bigint, event_type string")
    return out.select("event_id", "user_id", "event_type", F.col("result_file").startswith("file:").alias("has_file"))


def _detected(spark, sf):
    return det.detect(view(spark, sf, "v_paths")).select("event_id", "case_id", "os_path", "family", "artifact")


@query("snk_1_result_files", WITH_DETECTED + " SELECT event_id, os_path, family, artifact FROM v_detected")
def snk_1(spark, sf):
    folder = shared_dir(spark, "sink")
    results.write_results(_detected(spark, sf), folder)
    return spark.read.schema("event_id bigint, os_path string, family string, artifact string").json(folder)


@query(
    "snk_2_run_manifests",
    WITH_DETECTED + " SELECT case_id, count(*) AS entries, CAST(sum(n) AS BIGINT) AS exported_records FROM (SELECT case_id, artifact, count(*) AS n FROM v_detected GROUP BY ALL) GROUP BY case_id",
)
def snk_2(spark, sf):
    folder = shared_dir(spark, "manifests")
    plans = det.build_plans(_detected(spark, sf).withColumn("grain", F.lit("file")))
    entries = plans.select("case_id", F.col("family").alias("parser"), "collection", "artifact", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), F.col("n_files").alias("exported_records"))
    results.write_manifest(entries, folder)
    text = spark.read.text(folder, wholetext=True)
    doc = F.from_json("value", "case_id string, entries array<struct<artifact:string>>, exported_records bigint")
    return text.select(doc.alias("m")).select("m.case_id", F.size("m.entries").cast("bigint").alias("entries"), "m.exported_records")


@query("jsl_1_foreign_results", WITH_DETECTED + f" SELECT event_id, family || '::' || artifact AS plan_id, {SLUG} AS output_name FROM v_detected")
def jsl_1(spark, sf):
    folder = shared_dir(spark, "foreign")
    found = _detected(spark, sf).withColumn("grain", F.lit("file"))
    plans = det.build_plans(found)
    named = found.join(plans.select("family", "artifact", "output_name").distinct(), ["family", "artifact"])
    named.select(F.concat("output_name", F.lit(".jsonl")).alias("plan"), F.to_json(F.struct("event_id", "os_path")).alias("value")).write.partitionBy("plan").text(folder)
    out = runs.union_results(records.read_raw_results(spark, folder), plans)
    return out.select(F.variant_get("record", "$.event_id", "bigint").alias("event_id"), "plan_id", "output_name")


# ---- user-defined rules and decoders -----------------------------------------------------


@query("udf_1_custom_rule", WITH + " SELECT event_id FROM v_parts WHERE x IN ('docx', 'tmp')")
def udf_1(spark, sf):
    det.register_rule("office", lambda p: p.ext.isin("docx", "tmp"), "custom_office", "Custom.Office")
    try:
        return det.detect(view(spark, sf, "v_paths")).where("artifact = 'Custom.Office'").select("event_id")
    finally:
        det.unregister_rule("office")


def _count_words(batches):
    for batch in batches:
        rows = [
            {"archive_path": r["archive_path"], "lines": r["content"].count(b"\n"), "bytes": len(r["content"])} for r in batch.to_pylist()
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive_path", pa.string()), ("lines", pa.int64()), ("bytes", pa.int64())]))


@query(
    "udf_2_custom_decoder",
    "SELECT 'C/docs/' || doc_id || '.txt' AS archive_path, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents",
)
def udf_2(spark, sf):
    decoders.register_decoder("Custom.Lines", "archive_path string, lines bigint, bytes bigint", _count_words)
    return decoders.decode(_document_files(spark, sf), "Custom.Lines")


def _keys_of(props):
    for key, value in json.loads(props).items():
        yield key, str(value)


@query("udf_2_table_function", "SELECT event_id, 'k' AS key, regexp_extract(props, '[0-9]+', 0) AS value FROM events")
def udf_2b(spark, sf):
    decoders.register_table_function(spark, "json_entries", _keys_of, "key string, value string")
    return spark.sql("SELECT e.event_id, t.key, t.value FROM {e} e, LATERAL json_entries(e.props) t", e=read(spark, sf, "events").select("event_id", "props"))


# ---- streams -----------------------------------------------------------------------------


def _event_log(spark, sf) -> tuple[str, object]:
    """Folder of an event log in several files, and a second part to append later."""
    folder = shared_dir(spark, "events")
    log = view(spark, sf, "v_events")
    log.where("seq % 2 = 0").repartition(4, "seq").write.json(folder)
    return folder, log.where("seq % 2 = 1").repartition(4, "seq")


@query("src_8_event_stream", cte("v_events") + " SELECT run_id, seq, type FROM v_events")
def src_8(spark, sf):
    folder, later = _event_log(spark, sf)
    later.write.mode("append").json(folder)
    out = shared_dir(spark, "stream")
    ev.tail_events(spark, folder, f"{out}-checkpoint", out)
    return spark.read.parquet(out).select("run_id", "seq", "type")


@query("stm_1_incremental_tail", cte("v_events") + " SELECT run_id, seq, type, status FROM v_events")
def stm_1(spark, sf):
    folder, later = _event_log(spark, sf)
    out = shared_dir(spark, "tail")
    ev.tail_events(spark, folder, f"{out}-checkpoint", out)
    later.write.mode("append").json(folder)
    ev.tail_events(spark, folder, f"{out}-checkpoint", out)
    return spark.read.parquet(out).select("run_id", "seq", "type", "status")


@query("stm_2_plan_state_stream", cte("v_events") + STATE)
def stm_2(spark, sf):
    folder, later = _event_log(spark, sf)
    out = shared_dir(spark, "state")
    ev.fold_plan_state_stream(ev.stream_events(spark, folder, files_per_trigger=2), f"{out}-checkpoint", out, fold_every=2, settle_after=1)
    later.write.mode("append").json(folder)
    ev.fold_plan_state_stream(ev.stream_events(spark, folder, files_per_trigger=2), f"{out}-checkpoint", out, fold_every=2, settle_after=1)
    return ev.read_plan_state(spark, out)


@query(
    "stm_3_collector_stream",
    """SELECT CAST(user_id AS VARCHAR) AS run_id, 'c' || event_id % 3 AS collection_title, count(*) FILTER (event_type = 'click') AS completed_jobs,
        least((count(*) FILTER (event_type = 'click') + CASE WHEN max(event_id) FILTER (event_type IN ('view', 'error')) > coalesce(max(event_id) FILTER (event_type = 'click'), -1)
        THEN least(greatest(arg_max(value, event_id) FILTER (event_type IN ('view', 'error')) / 100, 0.0), 1.0) ELSE 0.0 END) / 50, 1.0) AS progress FROM events GROUP BY user_id, event_id % 3""",
)
def stm_3(spark, sf):
    t = F.col("event_type")
    kind = F.when(t == "view", "collector_progress").when(t == "error", "collector_started").when(t == "click", "collector_finished").otherwise("noise")
    folder, out = shared_dir(spark, "collectors"), shared_dir(spark, "progress")
    read(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("type"),
        F.concat(F.lit("c"), F.col("event_id") % 3).alias("collection_title"), (F.col("value") / 100).alias("progress_value"),
    ).repartition(4, "seq").write.json(folder)
    ev.collector_totals_stream(ev.stream_events(spark, folder, files_per_trigger=2), f"{out}-checkpoint", out, fold_every=2)
    return ev.read_collector_progress(spark, out, 50)


def _log_packages(spark, sf) -> str:
    """Packages of thirty users' log files each, named after their case."""
    log = view(spark, sf, "v_log")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    logs = log.groupBy("case_id", "os_path").agg(F.encode(text, "UTF-8").alias("content"))
    folder = shared_dir(spark, "landing")
    name = F.concat("case_id", F.lit("-"), F.call_function("div", F.regexp_extract("os_path", r"(\d+)\.log$", 1).cast("bigint"), F.lit(30)).cast("string"))
    write_packages(logs.select(name.alias("case_id"), F.col("os_path").alias("archive_path"), "content"), folder)
    return folder


@query(
    "stm_4_landing_zone",
    cte("v_log") + f""", {RAW}, {RECORDS} SELECT case_id, CASE k WHEN 0 THEN 'Engine' WHEN 1 THEN 'Threat' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'Warning' WHEN 4 THEN 'Quarantine' WHEN 5 THEN 'Error' ELSE 'Info' END AS event_type,
        count(*) AS n FROM p GROUP BY ALL""",
)
def stm_4(spark, sf):
    folder, out = _log_packages(spark, sf), shared_dir(spark, "parsed")
    landing.parse_landing(spark, folder, f"{out}-checkpoint", out)
    rows = spark.read.schema("case_id string, event_type string").json(f"{out}/batch=*/results/windows_mplogs/Windows.Defender.MPLog")
    case = F.substring_index("case_id", "-", 1).alias("case_id")
    return rows.groupBy(case, "event_type").agg(F.count("*").alias("n"))


@query(
    "run_4_damaged_members",
    """SELECT 'case' || (doc_id // 40) AS case_id, CASE WHEN bool_or(doc_id % 95 = 0) THEN 'error' ELSE 'ok' END AS status,
        count(*) FILTER (WHERE doc_id % 95 <> 0) AS files, count(*) FILTER (WHERE doc_id % 95 = 0) AS problems FROM documents GROUP BY ALL""",
)
def run_4(spark, sf):
    """Documents as shell histories, some of them damaged: their own case's plan fails, all other files are decoded."""
    d = F.col("doc_id")
    files = read(spark, sf, "documents").select(
        F.concat(F.lit("case"), F.call_function("div", d, F.lit(40))).alias("case_id"), F.concat(F.lit("home/u"), d, F.lit("/.bash_history")).alias("archive_path"),
        F.encode(F.concat(F.lit("cd "), "text"), "UTF-8").alias("content"), (d % 95 == 0).alias("damaged"),
    )
    folder, out = shared_dir(spark, "damaged"), shared_dir(spark, "parsed")
    write_packages(files, folder)
    entries = parse.parse_packages(spark, folder, out, f"{out}-scratch").where("parser = 'linux_shell_history'").select("case_id", "status")
    rows = spark.read.schema("case_id string, os_path string").json(f"{out}/linux_shell_history/Linux.Shell.History")
    bad = spark.read.schema("case_id string, os_path string").json(f"{out}/diagnostics/linux_shell_history/Linux.Shell.History")
    count = lambda df, name: df.groupBy("case_id").agg(F.countDistinct("os_path").alias(name))
    joined = entries.join(count(rows, "files"), "case_id", "left").join(count(bad, "problems"), "case_id", "left")
    return joined.fillna(0, ["files", "problems"])
