"""Browser and activity tables, run bookkeeping, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.discovery import FAMILY_VALUES, WITH_DETECTED
from bindings.registry import query
from bindings.scalars import MAPPING_SQL, PATH_SQL, ROLE_SQL, SID_SQL
from bindings.views import cte, read, view
from casework.functions import time
from casework.operators import browser, detect as det, registry as reg, runs
from casework.sinks import results

def _case():
    return F.lit("host").alias("case_id")

WIN_PATH, MAC_PATH = "C/Users/ann/AppData/Local/x/History", "Users/Bob/Library/History"
ISO = "strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.%f') || '000Z'"


def _path(p):
    return F.lit(p).alias("os_path")


# ---- browser and activity ----------------------------------------------------------------


def _chromium_tables(spark, sf):
    p, l, o = (read(spark, sf, t) for t in ("part", "lineitem", "orders"))
    urls = p.select(
        _case(), _path(WIN_PATH), F.col("p_partkey").alias("id"), F.concat(F.lit("http://"), F.replace("p_name", F.lit(" "), F.lit("."))).alias("url"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("bigint")).alias("visit_count"),
        F.col("p_size").cast("bigint").alias("typed_count"), (F.lit(time.WEBKIT_UNIX_EPOCH) + F.col("p_partkey") * 1000003).alias("last_visit_time"), (F.col("p_partkey") % 2).alias("hidden"),
    )
    k = F.col("l_orderkey")
    visits = l.select(
        _case(), _path(WIN_PATH), k.alias("id"), F.col("l_partkey").alias("url"),
        F.when(k % 50 == 0, F.lit(0)).otherwise(F.lit(time.WEBKIT_UNIX_EPOCH) + k * 999983).alias("visit_time"),
        F.when(k % 2 == 0, k).alias("from_visit"), F.col("l_quantity").cast("bigint").alias("visit_duration"), F.col("l_linenumber").cast("bigint").alias("transition"),
    )
    source = o.where("o_orderstatus = 'F'").select(_case(), _path(WIN_PATH), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9).alias("source"))
    return urls, visits, source


@query(
    "join_1_chromium_visits",
    f"""SELECT 'host' AS case_id, 'chrome' AS browser, 'ann' AS "user", p_partkey AS url_id, 'http://' || replace(p_name, ' ', '.') AS visited_url, CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE '' END AS title,
        CAST(CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 0 END AS BIGINT) AS visit_count, CAST(p_size AS BIGINT) AS typed_count, p_partkey % 2 <> 0 AS hidden, CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey ELSE 0 END AS from_url_id,
        CASE coalesce(o_orderkey % 9, 1) WHEN 0 THEN 'Synced' WHEN 2 THEN 'Extension' WHEN 3 THEN 'ImportFromFirefox' WHEN 4 THEN 'ImportFromSafari' WHEN 6 THEN 'ImportFromChromeOrEdge' WHEN 7 THEN 'ImportFromEdgeHTML' ELSE 'Local' END AS source,
        CAST(l_quantity AS BIGINT) AS visit_duration_microseconds, CAST(l_linenumber AS BIGINT) AS transition, '{WIN_PATH}' AS os_path,
        CASE WHEN l_orderkey % 50 <> 0 THEN {ISO.format(us='l_orderkey * 999983')} END AS visit_time, CASE WHEN p_partkey > 0 THEN {ISO.format(us='p_partkey * 1000003')} END AS last_visit_time
        FROM part JOIN lineitem ON p_partkey = l_partkey LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey""",
)
def join_1(spark, sf):
    return browser.chromium_visits(*_chromium_tables(spark, sf), browser=F.lit("chrome"))


@query(
    "join_2_firefox_visits",
    f"""SELECT 'host' AS case_id, 'firefox' AS browser, 'ann' AS "user", o_orderkey AS visit_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END AS from_visit, 'https://' || c_name AS visited_url,
        CASE WHEN c_custkey % 5 <> 0 THEN c_name ELSE '' END AS title, reverse(c_name) AS rev_host, CAST(c_nationkey AS BIGINT) AS visit_count, c_custkey % 2 <> 0 AS hidden, c_custkey % 3 <> 0 AS typed, c_mktsegment AS description, '{WIN_PATH}' AS os_path,
        CASE WHEN o_orderkey % 7 <> 0 THEN {ISO.format(us='o_orderkey * 123457')} END AS visit_time FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_2(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    places = c.select(
        _case(), _path(WIN_PATH), F.col("c_custkey").alias("id"), F.concat(F.lit("https://"), "c_name").alias("url"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("title"),
        F.reverse("c_name").alias("rev_host"), F.col("c_nationkey").cast("bigint").alias("visit_count"), (F.col("c_custkey") % 2).alias("hidden"), (F.col("c_custkey") % 3).alias("typed"), F.col("c_mktsegment").alias("description"),
    )
    k = F.col("o_orderkey")
    visits = o.select(
        _case(), _path(WIN_PATH), k.alias("id"), F.when(k % 2 == 0, F.col("o_custkey")).alias("from_visit"), F.when(k % 7 == 0, -k).otherwise(k * 123457).alias("visit_date"), F.col("o_custkey").alias("place_id")
    )
    return browser.firefox_visits(places, visits)


@query(
    "join_3_timeline_activity",
    f"SELECT 'host' AS case_id, 'ann' AS \"user\", CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'app' || user_id ELSE 'plain ' || event_type END AS application, "
    f"CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 2 = 0 THEN '[\"app' || user_id || '\"]' ELSE 'plain ' || event_type END AS app_id, event_id AS last_modified, '{WIN_PATH}' AS os_path FROM events",
)
def join_3(spark, sf):
    e = F.col("event_id")
    app = F.when(e % 5 == 0, F.lit(None)).when(e % 2 == 0, F.concat(F.lit('["app'), "user_id", F.lit('"]'))).otherwise(F.concat(F.lit("plain "), "event_type"))
    return browser.timeline_activity(read(spark, sf, "events").select(_case(), _path(WIN_PATH), app.alias("AppId"), e.alias("LastModifiedTime")))


@query(
    "join_4_mac_chrome_urls",
    f"""SELECT 'host' AS case_id, 'chrome' AS browser, 'bob' AS "user", url AS visited_url, CASE WHEN page_id % 2 = 0 THEN 'page' || page_id ELSE '' END AS title, page_id AS visit_count, CASE WHEN page_id % 3 = 0 THEN page_id ELSE 0 END AS typed_count,
        '{MAC_PATH}' AS os_path, CASE WHEN page_id > 0 THEN {ISO.format(us='page_id * 7654321')} END AS last_visit_time FROM pages""",
)
def join_4(spark, sf):
    p = F.col("page_id")
    urls = read(spark, sf, "pages").select(
        _case(), _path(MAC_PATH), "url", F.when(p % 2 == 0, F.concat(F.lit("page"), p)).alias("title"), p.alias("visit_count"), F.when(p % 3 == 0, p).alias("typed_count"),
        F.when(p > 0, F.lit(time.WEBKIT_UNIX_EPOCH) + p * 7654321).otherwise(F.lit(0)).alias("last_visit_time"),
    )
    return browser.mac_chrome_urls(urls)


@query(
    "join_5_quarantine_events",
    f"""SELECT 'host' AS case_id, 'bob' AS "user", 'http://x/' || event_id AS download_url, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS origin, event_type AS agent_name, 'com.' || event_type AS agent_bundle, CAST(event_id AS VARCHAR) AS event_uuid,
        '{MAC_PATH}' AS os_path, CASE WHEN event_id % 4 <> 0 THEN strftime(make_timestamp((978307200 + event_id * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.500000000Z' END AS download_time FROM events""",
)
def join_5(spark, sf):
    e = F.col("event_id")
    rows = read(spark, sf, "events").select(
        _case(), _path(MAC_PATH), F.when(e % 4 != 0, e * 60 + 0.5).otherwise(0.0).alias("LSQuarantineTimeStamp"), F.concat(F.lit("http://x/"), e).alias("LSQuarantineDataURLString"),
        F.when(e % 2 == 0, F.col("props")).alias("LSQuarantineOriginURLString"), F.col("event_type").alias("LSQuarantineAgentName"),
        F.concat(F.lit("com."), "event_type").alias("LSQuarantineAgentBundleIdentifier"), e.cast("string").alias("LSQuarantineEventIdentifier"),
    )
    return browser.quarantine_events(rows)


# ---- registry records --------------------------------------------------------------------


@query(
    "reg_8_key_records",
    cte("v_keys") + f""" SELECT k.key_id, role AS hive_role, {PATH_SQL} AS registry_path, {SID_SQL} AS sid, {MAPPING_SQL} AS hive_mapping, 'U' || key_id % 13 AS "user", 'U' || key_id % 13 AS hive_user_context,
        CASE WHEN key_id % 4 <> 0 THEN key_id END AS sub_keys_list_offset_relative, coalesce(n, 0) AS value_count, coalesce(s, 0) AS data_bytes, coalesce(r, 0) AS resident_values
        FROM (SELECT *, {ROLE_SQL.replace('page_id', 'key_id')} AS role FROM v_keys) k LEFT JOIN (SELECT conv_id AS key_id, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS s, count(*) FILTER (turn % 2 = 0) AS r FROM conversations GROUP BY conv_id) v USING (key_id)""",
)
def reg_8(spark, sf):
    k = F.col("key_id")
    keys = view(spark, sf, "v_keys").withColumns(
        {"sub_keys_list_offset_relative_raw": F.when(k % 4 == 0, F.lit(0xFFFFFFFF)).otherwise(k), "key_values_list_offset_relative_raw": k}
    )
    size = F.octet_length("text").cast("bigint")
    values = read(spark, sf, "conversations").select(
        F.col("conv_id").alias("key_id"), F.col("turn").alias("value_no"), F.col("role").alias("value_name"), F.lit("RegSZ").alias("data_type"), F.encode("text", "UTF-8").alias("data"),
        (size + F.when(F.col("turn") % 2 == 0, F.lit(0x80000000)).otherwise(0)).alias("data_size_raw"), F.lit('{"String":"x"}').alias("decoded"),
    )
    out = reg.key_records(keys, values)
    sizes = F.transform("values", lambda v: v["data_size"])
    return out.select(
        "key_id", "hive_role", "registry_path", "sid", "hive_mapping", "user", "hive_user_context", "sub_keys_list_offset_relative", "value_count",
        F.coalesce(F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).cast("bigint").alias("data_bytes"),
        F.coalesce(F.size(F.filter("values", lambda v: v["resident_data"])), F.lit(0)).cast("bigint").alias("resident_values"),
    )


@query(
    "agg_2_hive_counts",
    "SELECT user_id, count(*) FILTER (event_type <> 'error') AS hives, CAST(coalesce(sum(event_id) FILTER (event_type <> 'error'), 0) AS BIGINT) AS keys FROM events GROUP BY user_id",
)
def agg_2(spark, sf):
    hives = read(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("event_id").alias("keys"))
    return reg.hive_counts(hives, ["user_id"])


# ---- run bookkeeping ---------------------------------------------------------------------


@query(
    "agg_1_plan_counts",
    "SELECT f.user_id, f.files, coalesce(r.records, 0) AS records FROM (SELECT user_id, count(DISTINCT props) AS files FROM events GROUP BY user_id) f LEFT JOIN (SELECT user_id, count(*) AS records FROM events WHERE event_type = 'error' AND value > 60 GROUP BY user_id) r USING (user_id)",
)
def agg_1(spark, sf):
    e = read(spark, sf, "events")
    return runs.plan_counts(e.select("user_id", "props"), e.where("event_type = 'error' AND value > 60"), ["user_id"], "props")


@query(
    "agg_3_export_totals",
    "SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN CAST(coalesce(sum(nullif(event_id % 4, 0)), 0) AS BIGINT) END AS exported_records, count(nullif(event_id % 4, 0)) AS entries_with_count FROM events GROUP BY user_id",
)
def agg_3(spark, sf):
    entries = runs.export_counts(read(spark, sf, "events").select("user_id", (F.col("event_id") % 4).alias("exported_records")))
    totals = runs.export_totals(entries, ["user_id"], F.col("user_id") % 3 != 0)
    return totals.join(entries.groupBy("user_id").agg(F.count("exported_records").alias("entries_with_count")), "user_id")


OUTCOME = "CASE event_type WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'failed' ELSE 'copied' END WHEN 'signup' THEN 'skipped' ELSE 'copied' END"


@query(
    "agg_5_collector_status",
    f"""SELECT user_id, count(*) FILTER (o <> 'skipped') AS found, count(*) FILTER (o = 'copied') AS copied, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'failed') AS failed,
        CASE WHEN bool_or(o = 'failed') THEN 'completed_with_errors' ELSE 'succeeded' END AS collection_status FROM (SELECT user_id, {OUTCOME} AS o FROM events) GROUP BY user_id""",
)
def agg_5(spark, sf):
    return runs.collector_status(read(spark, sf, "events").select("user_id", F.expr(OUTCOME).alias("outcome")), ["user_id"])


@query("agg_9_profile_counts", "SELECT c_nationkey, count(*) AS profiles_scanned, count(*) FILTER (c_mktsegment = 'BUILDING') AS profiles_skipped FROM customer GROUP BY c_nationkey")
def agg_9(spark, sf):
    return runs.profile_counts(read(spark, sf, "customer"), ["c_nationkey"], F.col("c_mktsegment") == "BUILDING")


@query(
    "run_1_manifest_entries",
    WITH_DETECTED + f""", pl AS (SELECT case_id, family, artifact, count(*) AS n FROM v_detected GROUP BY ALL)
        SELECT c.case_id, f.family AS parser, f.collection, CASE WHEN f.family IN ('windows_mft', 'windows_shellbags') OR pl.artifact IS NULL THEN '' ELSE pl.artifact END AS artifact,
        CASE WHEN f.family IN ('windows_mft', 'windows_shellbags') OR pl.artifact IS NULL THEN 'skipped' WHEN pl.n % 3 = 0 THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN f.family IN ('windows_mft', 'windows_shellbags') THEN 'parser adapter not registered' WHEN pl.artifact IS NULL THEN 'no matching inputs found in extracted collection' WHEN pl.n % 3 = 0 THEN 'failed' END AS error,
        CASE WHEN f.family NOT IN ('windows_mft', 'windows_shellbags') AND pl.n % 3 <> 0 THEN nullif(pl.n % 2 * pl.n, 0) END AS exported_records
        FROM (SELECT DISTINCT case_id FROM v_paths) c CROSS JOIN (VALUES {FAMILY_VALUES}) f(family, collection) LEFT JOIN pl ON pl.case_id = c.case_id AND pl.family = f.family""",
)
def run_1(spark, sf):
    paths = view(spark, sf, "v_paths")
    plans = det.build_plans(det.detect(paths))
    n = F.col("n_files")
    outcomes = plans.select("case_id", "plan_id", F.when(n % 3 == 0, "failed").alias("error"), (n % 2 * n).alias("exported_records"))
    from casework.plans.catalog import PARSER_FAMILIES

    known = [f for f in PARSER_FAMILIES if f not in ("windows_mft", "windows_shellbags")]
    return runs.manifest_entries(plans, outcomes, paths.select("case_id").distinct(), known)


@query(
    "win_7_counter_rate",
    cte("v_counters") + """ SELECT b.host, b.sample_no, d / e AS bytes_per_second FROM (SELECT DISTINCT host, sample_no FROM v_counters) b LEFT JOIN
        (SELECT host, sample_no, CAST(sum(greatest(bytes - pb, 0)) AS DOUBLE) AS d, 30.0 AS e FROM (SELECT *, lag(bytes) OVER w AS pb, lag(sample_no) OVER w AS pa FROM v_counters WINDOW w AS (PARTITION BY host, volume ORDER BY sample_no)) WHERE pa = sample_no - 1 GROUP BY host, sample_no) r USING (host, sample_no)""",
)
def win_7(spark, sf):
    samples = view(spark, sf, "v_counters").withColumn("seconds", F.col("sample_no") * 30.0)
    return runs.counter_rate(samples, ["host"], "sample_no", "bytes", "seconds")


@query(
    "win_7_counter_rate_of_one",
    cte("v_counters") + """ SELECT b.host, b.sample_no, d / 30.0 AS bytes_per_second FROM (SELECT DISTINCT host, sample_no FROM v_counters) b LEFT JOIN
        (SELECT host, sample_no, CAST(greatest(bytes - lag(bytes) OVER w, 0) AS DOUBLE) AS d, lag(sample_no) OVER w AS pa FROM v_counters WHERE volume = 'V5' WINDOW w AS (PARTITION BY host, volume ORDER BY sample_no)) r ON r.host = b.host AND r.sample_no = b.sample_no AND pa = b.sample_no - 1""",
)
def win_7b(spark, sf):
    samples = view(spark, sf, "v_counters").withColumn("seconds", F.col("sample_no") * 30.0)
    return runs.counter_rate(samples, ["host"], "sample_no", "bytes", "seconds", target="V5")


@query(
    "win_8_busy_fraction",
    """SELECT user_id, event_id, CASE WHEN t > 0 THEN least(greatest(t - i, 0) / CAST(t AS DOUBLE), 1.0) END AS busy FROM (SELECT user_id, event_id, greatest(total - lag(total) OVER w, 0) AS t, greatest(idle - lag(idle) OVER w, 0) AS i
        FROM (SELECT user_id, event_id, event_id // 3 * 7 + event_id // 2 AS total, event_id % 100 * 5 AS idle FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""",
)
def win_8(spark, sf):
    e = F.col("event_id")
    samples = read(spark, sf, "events").select(
        "user_id", "event_id", (F.call_function("div", e, F.lit(3)) * 7).alias("kernel"), F.call_function("div", e, F.lit(2)).alias("usr"), (e % 100 * 5).alias("idle")
    )
    return runs.busy_fraction(samples, ["user_id"], "event_id", "idle", "kernel", "usr")


@query(
    "win_9_progress",
    cte("v_events") + """ SELECT run_id, seq, completed, CASE WHEN total = 0 THEN 0.0 ELSE least(completed / CAST(total AS DOUBLE), 1.0) END AS progress, CASE WHEN completed > 0 AND s > 0 THEN completed / CAST(s AS DOUBLE) END AS rate,
        CASE WHEN completed > 0 AND s > 0 AND total > 0 THEN greatest(total - completed, 0) * s / CAST(completed AS DOUBLE) END AS remaining
        FROM (SELECT run_id, seq, seq % 1000 AS s, CAST(run_id AS BIGINT) % 40 AS total, count(*) FILTER (type = 'plan_finished') OVER (PARTITION BY run_id ORDER BY seq) AS completed FROM v_events)""",
)
def win_9(spark, sf):
    events = view(spark, sf, "v_events").withColumns({"s": F.col("seq") % 1000, "total": F.col("run_id").cast("bigint") % 40})
    return runs.progress(events, ["run_id"], "seq", "s", "total", F.col("type") == "plan_finished")


STATE = """, pe AS (SELECT *, parser || '::' || artifact AS plan_id, CASE WHEN type = 'plan_started' THEN 'Running' WHEN status = 'ok' THEN 'Complete' WHEN type = 'plan_finished' THEN 'Failed' END AS shown FROM v_events WHERE parser IS NOT NULL),
    pp AS (SELECT run_id, plan_id, arg_max(shown, seq) AS status, max(seq) FILTER (type = 'plan_started') AS st, max(seq) FILTER (type = 'plan_finished') AS fi FROM pe GROUP BY ALL),
    pr AS (SELECT run_id, max(seq) FILTER (type = 'plan_started') AS ls, max(seq) FILTER (type = 'completed') AS co FROM v_events GROUP BY run_id)
    SELECT run_id, plan_id, coalesce(status, 'Queued') AS status, coalesce(st = ls AND st > coalesce(fi, -1) AND st > coalesce(co, -1), false) AS active FROM pp JOIN pr USING (run_id)"""


@query("stm_2_plan_state", cte("v_events") + STATE)
def stm_2(spark, sf):
    return runs.fold_plan_state(view(spark, sf, "v_events"))


@query(
    "stm_3_collector_progress",
    """SELECT user_id, event_id, d AS completed_jobs, CASE WHEN user_id % 9 = 0 THEN 0.0 ELSE least((d + CASE WHEN event_type IN ('view', 'error') THEN least(greatest(value / 100, 0.0), 1.0) ELSE 0.0 END) / (user_id % 9 * 10), 1.0) END AS progress
        FROM (SELECT *, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events)""",
)
def stm_3(spark, sf):
    t = F.col("event_type")
    kind = F.when(t == "view", "collector_progress").when(t == "error", "collector_started").when(t == "click", "collector_finished").otherwise("noise")
    events = read(spark, sf, "events").select("user_id", "event_id", kind.alias("type"), (F.col("value") / 100).alias("progress_value"))
    return runs.collector_progress(events, ["user_id"], "event_id", F.col("user_id") % 9 * 10)


@query(
    "set_1_union_outputs",
    "SELECT event_id AS id, event_type AS kind, CAST(NULL AS VARCHAR) AS lang FROM events UNION ALL SELECT doc_id, NULL, lang FROM documents UNION ALL SELECT page_id, 'page', NULL FROM pages",
)
def set_1(spark, sf):
    return runs.union_outputs(
        [
            read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind")),
            read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"),
            read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind")),
        ]
    )


# ---- exports -----------------------------------------------------------------------------


@query(
    "snk_4_bulk_batches",
    """SELECT event_type, batch_no, count(*) AS records, CAST(sum(length('{"index":{}}') + 2 + length('{"event_id":' || event_id || ',"user_id":' || user_id || '}')) AS BIGINT) AS payload_chars
        FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 500 AS batch_no FROM events) GROUP BY event_type, batch_no""",
)
def snk_4(spark, sf):
    df = read(spark, sf, "events").select("event_type", "event_id", F.to_json(F.struct("event_id", "user_id")).alias("doc"))
    out = results.bulk_batches(df, ["event_type"], "event_id", F.col("doc"))
    return out.select("event_type", "batch_no", "records", F.char_length("payload").cast("bigint").alias("payload_chars"))


@query(
    "snk_5_bulk_reconcile",
    """SELECT o_custkey, n AS succeeded, CASE WHEN bad IS NULL AND o_custkey % 13 <> 0 THEN n ELSE 0 END AS indexed,
        CASE WHEN bad IS NOT NULL THEN 'item failed with status ' || CASE WHEN bad % 2 = 0 THEN '429: {"type":"full"}' ELSE '400' END WHEN o_custkey % 13 = 0 THEN 'response reported errors' END AS error
        FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS n, min(o_orderkey) FILTER (o_orderstatus = 'P') AS bad FROM orders GROUP BY o_custkey)""",
)
def snk_5(spark, sf):
    k = F.col("o_orderkey")
    item = F.when(F.col("o_orderstatus") != "P", F.lit('{"index":{"status":201}}')).when(k % 2 == 0, F.lit('{"index":{"status":429,"error":{"type":"full"}}}')).otherwise(F.lit('{"index":{"status":400}}'))
    orders = read(spark, sf, "orders").select("o_custkey", k, item.alias("item"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "item"))), lambda x: x["item"]), ",")
    body = F.concat(F.lit('{"errors":'), F.when(F.col("o_custkey") % 13 == 0, "true").otherwise("false"), F.lit(',"items":['), F.col("items"), F.lit("]}"))
    responses = orders.groupBy("o_custkey").agg(items.alias("items")).select("o_custkey", body.alias("body"))
    return results.reconcile_bulk(responses, ["o_custkey"])


