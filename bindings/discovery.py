"""Detection, plans, catalogs, inventory rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.views import cte, read, view
from casework.functions import paths
from casework.operators import detect as det, inventory as inv
from casework.plans import catalog as cat, targets as T

# SQL of the detection rules, one boolean per artifact, over p (lower path), n (name), x (extension).
DETECT_SQL = {
    ("windows_browser_history", "Windows.Applications.Chrome.History"):
        "p LIKE '%/history' AND NOT contains(p, '/microsoft/edge/user data/') AND (contains(p, '/google/chrome/user data/') OR contains(p, '/bravesoftware/brave-browser/user data/') OR contains(p, '/vivaldi/user data/') OR contains(p, '/opera software/opera') OR contains(p, '/chromium/user data/'))",
    ("windows_browser_history", "Windows.Applications.Edge.History"): "p LIKE '%/history' AND contains(p, '/microsoft/edge/user data/')",
    ("windows_browser_history", "Windows.Applications.Firefox.History"): "p LIKE '%/places.sqlite' AND contains(p, '/mozilla/firefox/profiles/')",
    ("windows_event_logs", "Windows.EventLogs"): "x = 'evtx'",
    ("windows_prefetch", "Windows.Prefetch"): "x = 'pf'",
    ("windows_mplogs", "Windows.Defender.MPLog"): "n LIKE 'mplog%.log'",
    ("windows_bits", "Windows.BITS"): "n IN ('qmgr.db', 'qmgr0.dat', 'qmgr1.dat')",
    ("windows_search", "Windows.Search"): "n IN ('windows.edb', 'windows.db')",
    ("windows_outlook", "Windows.Outlook"): "x IN ('ost', 'pst')",
    ("windows_shimdb", "Windows.ShimDB"): "x = 'sdb'",
    ("windows_userassist", "Windows.Registry.UserAssist"): "n = 'ntuser.dat'",
    ("windows_shimcache", "Windows.Registry.Shimcache"): "n = 'system'",
    ("windows_shellbags", "Windows.Registry.Shellbags"): "n IN ('ntuser.dat', 'usrclass.dat')",
    ("windows_amcache", "Windows.Registry.Amcache"): "n = 'amcache.hve'",
    ("windows_shortcuts", "Windows.Shortcuts"): "x = 'lnk'",
    ("windows_srum", "Windows.SRUM"): "n = 'srudb.dat'",
    ("windows_users", "Windows.Users"): "n = 'sam'",
    ("windows_services", "Windows.Services"): "n = 'system'",
    ("windows_jump_lists", "Windows.JumpLists"): "x IN ('automaticdestinations-ms', 'customdestinations-ms')",
    ("windows_recycle_bin", "Windows.RecycleBin"): "n LIKE '$i%'",
    ("windows_scheduled_tasks", "Windows.ScheduledTasks"): "contains(p, '/windows/system32/tasks/') OR (contains(p, '/windows/tasks/') AND x = 'job')",
    ("windows_wmi_persistence", "Windows.WMIPersistence"): "n = 'objects.data'",
    ("windows_mft", "Windows.MFT"): "n IN ('$mft', '$mft.bin')",
    ("windows_usn_journal", "Windows.NTFS.UsnJournal.RawStream"): "ends_with(n, '_usn_journal_j.bin') OR ends_with('/' || p, '/$extend/$usnjrnl/$j.bin')",
    ("windows_registry", "Windows.Registry.Hive"): "n IN ('ntuser.dat', 'usrclass.dat', 'amcache.hve', 'sam', 'security', 'software', 'system', 'default', 'components', 'settings.dat', 'drvindex.dat')",
    ("windows_restore_point_log", "Windows.Forensics.RestorePoint.Log"): "n = 'rp.log'",
    ("windows_recycle_bin_info2", "Windows.RecycleBin.Info2"): "n = 'info2'",
    ("windows_timeline", "Windows.Forensics.Timeline.ActivitiesCache"): "n = 'activitiescache.db'",
    ("linux_shell_history", "Linux.Shell.History"): "n LIKE '.%' AND ends_with(n, '_history')",
    ("macos_browser_history", "MacOS.Applications.Chrome.History"): "p LIKE '%/history' AND contains(p, '/library/application support/google/chrome/')",
    ("macos_quarantine_events", "MacOS.System.QuarantineEvents"): "n = 'com.apple.launchservices.quarantineeventsv2'",
}
PARTS = """v_parts AS (SELECT *, regexp_extract(p, '[^/]*$', 0) AS n,
    CASE WHEN regexp_matches(regexp_extract(p, '[^/]*$', 0), '^.+[.][^.]*$') THEN regexp_extract(p, '[^.]*$', 0) END AS x,
    regexp_replace(p, '^[a-z]/', '') AS i
    FROM (SELECT *, lower(replace(os_path, chr(92), '/')) AS p FROM v_paths))"""
DETECTED = "v_detected AS (" + " UNION ALL ".join(
    f"SELECT event_id, case_id, os_path, '{f}' AS family, '{a}' AS artifact FROM v_parts WHERE {w}" for (f, a), w in DETECT_SQL.items()
) + ")"
WITH = cte("v_paths") + ", " + PARTS
WITH_DETECTED = WITH + ", " + DETECTED
SLUG = "trim(regexp_replace(lower(artifact), '[^a-z0-9]+', '-', 'g'), '-')"
DIRECTORY = "artifact IN ('Windows.EventLogs', 'Windows.Prefetch', 'Windows.Shortcuts', 'Windows.WMIPersistence')"
COLLECTION = "CASE family " + " ".join(f"WHEN '{f}' THEN '{c}'" for f, c in cat.PARSER_FAMILIES.items()) + " END"


def _paths(spark, sf):
    return view(spark, sf, "v_paths")


def _detected(spark, sf):
    return det.detect(_paths(spark, sf))


@query("det_1_detection", WITH_DETECTED + " SELECT event_id, family, artifact FROM v_detected")
def det_1(spark, sf):
    return _detected(spark, sf).select("event_id", "family", "artifact")


@query(
    "det_2_browser_kind",
    WITH_DETECTED + """ SELECT event_id, CASE artifact WHEN 'Windows.Applications.Chrome.History' THEN 'chrome' WHEN 'Windows.Applications.Edge.History' THEN 'edge'
        WHEN 'Windows.Applications.Firefox.History' THEN 'firefox' WHEN 'MacOS.Applications.Chrome.History' THEN 'mac_chrome' END AS kind
        FROM v_paths LEFT JOIN (SELECT event_id, artifact FROM v_detected WHERE artifact LIKE '%.History' AND artifact <> 'Linux.Shell.History') USING (event_id)""",
)
def det_2(spark, sf):
    return _paths(spark, sf).select("event_id", det.browser_kind(F.col("os_path")).alias("kind"))


@query("det_3_scheduled_task", WITH + f" SELECT event_id, coalesce({DETECT_SQL[('windows_scheduled_tasks', 'Windows.ScheduledTasks')]}, false) AS is_task FROM v_parts")
def det_3(spark, sf):
    return _paths(spark, sf).select("event_id", det.is_scheduled_task(F.col("os_path")).alias("is_task"))


@query("det_4_hive", WITH + f" SELECT event_id, event_id % 3 <> 0 AND {DETECT_SQL[('windows_registry', 'Windows.Registry.Hive')]} AS is_hive FROM v_parts")
def det_4(spark, sf):
    content = F.when(F.col("event_id") % 3 == 0, F.encode(F.lit("junk"), "UTF-8")).otherwise(F.encode(F.lit("regf...."), "UTF-8"))
    return _paths(spark, sf).select("event_id", det.is_hive(F.col("os_path"), content).alias("is_hive"))


@query(
    "det_5_plans",
    WITH_DETECTED + f""" SELECT case_id, family, {COLLECTION} AS collection, artifact, {SLUG} AS output_name, family || '::' || artifact AS plan_id,
        CASE WHEN {DIRECTORY} THEN 'directory' ELSE 'file' END AS grain, count(*) AS n_files FROM v_detected GROUP BY case_id, family, artifact""",
)
def det_5(spark, sf):
    return det.build_plans(_detected(spark, sf))


@query(
    "det_6_work_units",
    WITH_DETECTED + f""" SELECT case_id, family, artifact, CASE WHEN {DIRECTORY} THEN 'directory' ELSE 'file' END AS grain,
        arg_min(unit, event_id) AS unit, count(*) AS n_files
        FROM (SELECT *, CASE WHEN {DIRECTORY} THEN regexp_replace(replace(os_path, chr(92), '/'), '/[^/]*$', '') ELSE os_path END AS unit FROM v_detected)
        GROUP BY case_id, family, artifact, CASE WHEN {DIRECTORY} THEN lower(unit) ELSE unit END""",
)
def det_6(spark, sf):
    return det.work_units(_detected(spark, sf), "event_id")


@query(
    "det_8_plan_selection",
    WITH_DETECTED + """ SELECT case_id, family || '::' || artifact AS plan_id, count(*) AS n_files FROM v_detected
        WHERE family || '::' || artifact IN (SELECT family || '::' || artifact FROM v_detected WHERE case_id = 'click' GROUP BY ALL HAVING count(*) > 30)
        GROUP BY case_id, family, artifact""",
)
def det_8(spark, sf):
    plans = det.build_plans(_detected(spark, sf))
    ids = plans.where((F.col("case_id") == "click") & (F.col("n_files") > 30)).select("plan_id")
    return det.select_plans(plans, ids).select("case_id", "plan_id", "n_files")


FAMILY_VALUES = ", ".join(f"('{f}', '{c}')" for f, c in cat.PARSER_FAMILIES.items())
COLLECTION_VALUES = ", ".join(f"('{n}', '{p}', {str(h).lower()})" for n, p, _, h in cat.COLLECTIONS)


@query(
    "det_9_catalog_validation",
    WITH_DETECTED + f""", fams AS (SELECT family, CASE WHEN length(family) % 5 = 0 THEN ' ' WHEN length(family) % 7 = 0 THEN 'no_such_collection' ELSE {COLLECTION} END AS collection
        FROM (SELECT DISTINCT family FROM v_detected))
        SELECT family, collection, CASE WHEN trim(collection) = '' THEN 'missing collection binding' ELSE 'unregistered collection' END AS problem
        FROM fams WHERE collection NOT IN (SELECT c FROM (VALUES {COLLECTION_VALUES}) t(c, p, h))""",
)
def det_9(spark, sf):
    seen = _detected(spark, sf).select("family").distinct().join(cat.parser_catalog(spark), "family")
    n = F.length("family")
    spoiled = F.when(n % 5 == 0, F.lit(" ")).when(n % 7 == 0, F.lit("no_such_collection")).otherwise(F.col("collection"))
    return cat.validate_catalog(seen.withColumn("collection", spoiled), cat.collection_catalog(spark))


@query(
    "src_9_catalogs",
    WITH_DETECTED + f""" SELECT f.family, f.collection, c.platform, c.has_collector, count(d.event_id) AS n_files
        FROM (VALUES {FAMILY_VALUES}) f(family, collection) JOIN (VALUES {COLLECTION_VALUES}) c(collection, platform, has_collector) USING (collection)
        LEFT JOIN v_detected d ON d.family = f.family GROUP BY ALL""",
)
def src_9(spark, sf):
    counts = _detected(spark, sf).groupBy("family").agg(F.count("*").alias("n"))
    catalog = cat.parser_catalog(spark).join(F.broadcast(cat.collection_catalog(spark)), "collection")
    return catalog.join(counts, "family", "left").select(
        "family", "collection", "platform", "has_collector", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_files")
    )


@query(
    "inv_12_coverage",
    WITH_DETECTED + f""" SELECT coalesce(c.collection, f.collection) AS collection, coalesce(f.n, 0) AS parsers,
        CASE WHEN f.n > 0 AND c.h THEN 'both' WHEN c.h THEN 'collector_without_parser' WHEN f.n > 0 THEN 'parser_without_collector' ELSE 'neither' END AS coverage
        FROM (VALUES {COLLECTION_VALUES}) c(collection, p, h)
        FULL JOIN (SELECT {COLLECTION} AS collection, count(DISTINCT family) AS n FROM v_detected GROUP BY 1) f USING (collection)""",
)
def inv_12(spark, sf):
    seen = _detected(spark, sf).select("family").distinct().join(cat.parser_catalog(spark), "family")
    return cat.coverage(seen, cat.collection_catalog(spark))


# ---- inventory rules ---------------------------------------------------------------------

PROFILE = "nullif(trim(regexp_extract(i, '^users/([^/]+)/', 1)), '')"


@query("inv_1_profile_exclusion", WITH + f" SELECT event_id FROM v_parts WHERE coalesce({PROFILE}, '') NOT IN ('all users', 'default', 'default user', 'defaultapppool', 'defaultuser0', 'public')")
def inv_1(spark, sf):
    df = _paths(spark, sf)
    return inv.exclude_profiles(df, inv.profile_of(F.col("os_path"))).select("event_id")


PS_FIXED = "CASE " + " ".join(f"WHEN r = '{p.lower()}' THEN '{k}'" for p, k in T.POWERSHELL_FIXED.items()) + " END"
PS_ROOT = "CASE " + " ".join(f"WHEN starts_with(r, '{p.lower()}/') THEN '{k}'" for p, k in T.POWERSHELL_ROOTS.items()) + " END"
PS_EXT = " OR ".join(f"ends_with(n, '{e}')" for e in T.POWERSHELL_EXTENSIONS)


@query(
    "inv_2_powershell_policy",
    WITH + f""", a AS (SELECT *, regexp_extract(i, '^users/[^/]+/(.*)$', 1) AS r FROM v_parts),
        b AS (SELECT *, {PS_FIXED} AS fixed, {PS_ROOT} AS root, r LIKE 'documents/powershell_transcript%.txt' AND r NOT LIKE 'documents/%/%' AS tr FROM a),
        c AS (SELECT *, CASE WHEN coalesce({PROFILE}, '') IN ('all users', 'default', 'default user', 'defaultapppool', 'defaultuser0', 'public') THEN NULL ELSE coalesce(fixed, CASE WHEN tr THEN 'transcript' END,
            CASE root WHEN 'modules_root' THEN 'module_support_file' WHEN 'transcript_root' THEN 'transcript'
                 WHEN 'power_shell_data_root' THEN CASE WHEN n = 'consolehost_history.txt' THEN 'ps_read_line_history' ELSE 'power_shell_data_file' END END) END AS kind FROM b),
        d AS (SELECT *, CASE WHEN kind IS NULL OR fixed IS NOT NULL THEN NULL WHEN is_reparse THEN 'reparse_or_symlink'
            WHEN NOT tr AND NOT ({PS_EXT}) THEN 'unsupported_extension' WHEN size > 20971520 THEN 'size_limit_exceeded:20971520' END AS reason FROM c)
        SELECT event_id, kind, CASE WHEN reason IS NOT NULL THEN 'skip' WHEN kind IS NOT NULL THEN 'collect' END AS decision, reason FROM d""",
)
def inv_2(spark, sf):
    return inv.powershell_policy(_paths(spark, sf)).select("event_id", "kind", "decision", "reason")


@query(
    "inv_3_powershell_kind",
    WITH + """ SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'module_support_file' WHEN 1 THEN 'transcript'
        ELSE CASE WHEN n = 'consolehost_history.txt' THEN 'ps_read_line_history' ELSE 'power_shell_data_file' END END AS kind FROM v_parts""",
)
def inv_3(spark, sf):
    dirs = F.get(F.array(*[F.lit(k) for k in ("modules_root", "transcript_root", "power_shell_data_root")]), (F.col("event_id") % 3).cast("int"))
    return _paths(spark, sf).select("event_id", inv.powershell_kind(dirs, paths.file_name(F.col("os_path"))).alias("kind"))


@query(
    "inv_4_prefetch_kind",
    WITH + """ SELECT event_id, CASE WHEN n = 'layout.ini' THEN 'layout_ini' WHEN n LIKE 'ag%.db' THEN 'superfetch_database'
        WHEN n = 'ntosboot-b00dfaad.pf' THEN 'boot_prefetch' WHEN x = 'pf' THEN 'application_prefetch' END AS kind FROM v_parts""",
)
def inv_4(spark, sf):
    return _paths(spark, sf).select("event_id", inv.prefetch_kind(paths.file_name(F.col("os_path"))).alias("kind"))


@query(
    "inv_5_task_and_wmi_kinds",
    WITH + """ SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'modern_definition' WHEN n = 'schedlgu.txt' THEN 'scheduler_log' WHEN x = 'job' THEN 'legacy_job' ELSE 'other' END AS task,
        CASE WHEN x IN ('mof', 'mfl') THEN x END AS wbem, n LIKE 'repository%' AS is_repository FROM v_parts""",
)
def inv_5(spark, sf):
    dirs = F.when(F.col("event_id") % 2 == 1, "modern_tasks_root").otherwise("legacy_tasks_root")
    name = paths.file_name(F.col("os_path"))
    return _paths(spark, sf).select(
        "event_id", inv.task_kind(dirs, name).alias("task"), inv.wbem_kind(F.col("os_path")).alias("wbem"),
        inv.is_repository_root(name).alias("is_repository"),
    )


def _recycle(spark, sf):
    df = _paths(spark, sf).withColumn("rel", F.regexp_extract("os_path", r"(?i)^[a-z]/(?:\$recycle\.bin|recycler)/(.*)$", 1)).where("rel <> ''")
    root = F.when(F.lower("os_path").contains("/recycler/"), "legacy").otherwise("modern")
    return df.withColumn("c", inv.classify_recycle(root, F.col("rel"))).select("event_id", "case_id", "os_path", "c.*")


RECYCLE = WITH + r""", r0 AS (SELECT event_id, case_id, os_path, regexp_extract(os_path, '(?i)^[a-z]/(?:\$recycle\.bin|recycler)/(.*)$', 1) AS rel, contains(p, '/recycler/') AS legacy, n FROM v_parts),
    r1 AS (SELECT *, regexp_extract(rel, '[^/]*$', 0) AS nm, regexp_extract(rel, '^[^/]+', 0) AS first FROM r0 WHERE rel <> ''),
    r2 AS (SELECT event_id, case_id, os_path, CASE WHEN upper(first) LIKE 'S-%' THEN first END AS recycle_sid,
        CASE WHEN n = 'desktop.ini' THEN 'desktop_ini' WHEN n = 'info2' THEN 'info2' WHEN regexp_matches(nm, '(?i)^\$i.') THEN 'metadata_i' WHEN regexp_matches(nm, '(?i)^\$r.') THEN 'payload_r'
             WHEN regexp_matches(rel, '(?i)/\$[ir][^/]+/') THEN 'recycled_directory_member' WHEN NOT contains(rel, '/') THEN 'root_file' WHEN legacy THEN 'legacy_renamed' ELSE 'other' END AS artifact_kind,
        nm, regexp_extract(rel, '(?i)/\$[ir]([^/.]+)[^/]*/', 1) AS anc FROM r1),
    r3 AS (SELECT event_id, case_id, os_path, recycle_sid, artifact_kind,
        CASE WHEN artifact_kind IN ('metadata_i', 'payload_r') THEN regexp_extract(nm, '^..([^.]+)', 1) WHEN artifact_kind = 'recycled_directory_member' THEN anc END AS pair_id,
        CASE WHEN artifact_kind = 'info2' THEN NULL ELSE nullif(regexp_extract(nm, '[.][^.]*$', 0), '') END AS extension FROM r2)"""


@query("inv_6_recycle_classification", RECYCLE + " SELECT event_id, recycle_sid, artifact_kind, pair_id, extension FROM r3")
def inv_6(spark, sf):
    return _recycle(spark, sf).select("event_id", "recycle_sid", "artifact_kind", "pair_id", "extension")


@query(
    "join_9_recycle_pairs",
    RECYCLE + """, i AS (SELECT case_id, recycle_sid, pair_id, arg_min(os_path, event_id) AS i_path FROM r3 WHERE artifact_kind = 'metadata_i' GROUP BY ALL),
        r AS (SELECT case_id, recycle_sid, pair_id, arg_min(os_path, event_id) AS r_path FROM r3 WHERE artifact_kind = 'payload_r' GROUP BY ALL),
        m AS (SELECT case_id, recycle_sid, pair_id, count(*) AS members FROM r3 WHERE artifact_kind = 'recycled_directory_member' GROUP BY ALL)
        SELECT case_id, recycle_sid, pair_id, i_path, r_path, coalesce(members, 0) AS members,
        CASE WHEN i_path IS NOT NULL AND r_path IS NOT NULL THEN 'paired' WHEN i_path IS NOT NULL THEN 'orphan_i' WHEN r_path IS NOT NULL THEN 'orphan_r' ELSE 'members_only' END AS state
        FROM i FULL JOIN r USING (case_id, recycle_sid, pair_id) FULL JOIN m USING (case_id, recycle_sid, pair_id)""",
)
def join_9(spark, sf):
    return inv.pair_recycle(_recycle(spark, sf), "event_id")


@query(
    "inv_7_link_location",
    WITH + r""" SELECT event_id, CASE WHEN regexp_matches(i, '^users/[^/]+/appdata/roaming/microsoft/windows/recent/[^/]+\.lnk$') THEN 'recent'
        WHEN regexp_matches(i, '^users/[^/]+/desktop/[^/]+\.lnk$') THEN 'desktop'
        WHEN x = 'lnk' AND regexp_matches(i, '^users/[^/]+/appdata/roaming/microsoft/windows/start menu/') THEN 'user_start_menu'
        WHEN x = 'lnk' AND starts_with(i, 'programdata/microsoft/windows/start menu/') THEN 'common_start_menu' END AS location FROM v_parts""",
)
def inv_7(spark, sf):
    return _paths(spark, sf).select("event_id", inv.link_location(F.col("os_path")).alias("location"))


def _targets(spark, sf, rules):
    return inv.find_targets(_paths(spark, sf), rules).select("event_id", "collector", "kind")


@query(
    "inv_8_browser_targets",
    WITH + r""" SELECT * FROM (SELECT event_id, 'windows_browser_artifacts' AS collector, CASE
        WHEN regexp_matches(i, '^users/[^/]+/appdata/local/(google/chrome|microsoft/edge)/user data/[^/]+/history(-[^/]*)?$') THEN 'profile_file'
        WHEN regexp_matches(i, '^users/[^/]+/appdata/local/(google/chrome|microsoft/edge)/user data/[^/]+/extensions/[^/]+/[^/]+/manifest\.json$') THEN 'extension_manifest'
        WHEN regexp_matches(i, '^users/[^/]+/appdata/roaming/mozilla/firefox/.+') THEN 'user_dir'
        WHEN regexp_matches(i, '^users/[^/]+/ntuser\.dat(\.log[^/]*)?$') THEN 'user_hive'
        WHEN i IN ('windows/system32/config/system', 'windows/system32/config/security', 'windows/system32/config/software') THEN 'system_hive' END AS kind FROM v_parts) WHERE kind IS NOT NULL""",
)
def inv_8(spark, sf):
    return _targets(spark, sf, T.BROWSER_TARGETS)


@query(
    "inv_9_registry_targets",
    WITH + rf""" SELECT * FROM (SELECT event_id, 'windows_registry' AS collector, CASE
        WHEN i IN ('windows/system32/config/system', 'windows/system32/config/software', 'windows/appcompat/programs/amcache.hve', 'windows/serviceprofiles/localservice/ntuser.dat') THEN 'registry_hive'
        WHEN i IN ('boot/bcd', 'efi/microsoft/boot/bcd') THEN 'registry_artifact'
        WHEN regexp_matches(i, '^users/[^/]+/(ntuser\.dat|appdata/local/microsoft/windows/usrclass\.dat)$') AND {PROFILE} NOT IN ('all users', 'default', 'default user', 'defaultuser0', 'public') THEN 'registry_hive'
        END AS kind FROM v_parts) WHERE kind IS NOT NULL""",
)
def inv_9(spark, sf):
    return _targets(spark, sf, T.REGISTRY_TARGETS)


@query(
    "inv_10_other_targets",
    WITH + r""" SELECT event_id, 'windows_evtx' AS collector, 'event_log' AS kind FROM v_parts WHERE regexp_matches(i, '^windows/system32/winevt/logs/[^/]+\.evtx$')
        UNION ALL SELECT event_id, 'windows_srum', CASE WHEN starts_with(i, 'windows/system32/sru/') THEN 'srum_file' ELSE 'registry_hive' END FROM v_parts
            WHERE starts_with(i, 'windows/system32/sru/') OR i IN ('windows/system32/config/system', 'windows/system32/config/software')
        UNION ALL SELECT event_id, 'windows_mplogs', 'support_log' FROM v_parts WHERE starts_with(i, 'programdata/microsoft/windows defender/support/') AND n LIKE 'mplog%.log'
        UNION ALL SELECT event_id, 'windows_scheduled_tasks', CASE WHEN starts_with(i, 'windows/tasks/') THEN 'legacy_tasks' WHEN starts_with(i, 'windows/system32/tasks/') THEN 'modern_definition' ELSE 'scheduler_log' END
            FROM v_parts WHERE starts_with(i, 'windows/tasks/') OR starts_with(i, 'windows/system32/tasks/') OR i = 'windows/schedlgu.txt'
        UNION ALL SELECT event_id, 'windows_wmi_repository', CASE WHEN starts_with(i, 'windows/system32/wbem/repository') THEN 'repository_file' ELSE 'mof' END FROM v_parts WHERE starts_with(i, 'windows/system32/wbem/')
        UNION ALL SELECT event_id, 'windows_prefetch', 'prefetch' FROM v_parts WHERE starts_with(i, 'windows/prefetch/')""",
)
def inv_10(spark, sf):
    return _targets(spark, sf, T.OTHER_TARGETS)


DETAIL_SQL = "CASE " + " ".join(
    "WHEN " + (f"contains(q, '{frag}')" if frag else "true")
    + (" AND (" + " OR ".join(f"ends_with(q, '{e}')" for e in ends) + ")" if ends else "")
    + f" THEN '{label}'"
    + (" WHEN contains(q, '/programdata/microsoft/windows defender/support/') AND n LIKE 'mplog%.log' THEN 'Microsoft Protection Log (MPLog) file'" if label == "Legacy Task Scheduler log" else "")
    for label, frag, ends in T.ARTIFACT_DETAILS
) + f" ELSE '{T.OTHER_DETAIL}' END"


@query(
    "inv_13_artifact_labels",
    WITH + f""" SELECT event_id, {DETAIL_SQL} AS detail, CASE WHEN ends_with(q, '/manifest.json') THEN 'Collection manifest' WHEN ends_with(q, '$j.bin') THEN '$J.bin'
        WHEN ends_with(q, '$mft.bin') THEN '$MFT.bin' WHEN ends_with(q, '/windows/schedlgu.txt') THEN 'SchedLgU.txt' ELSE regexp_extract(os_path, '[^/]*$', 0) END AS name
        FROM (SELECT *, lower(os_path) AS q FROM v_parts)""",
)
def inv_13(spark, sf):
    return _paths(spark, sf).select("event_id", inv.artifact_label(F.col("os_path")).alias("l")).select("event_id", "l.detail", "l.name")


EXPECTED_VALUES = ", ".join(f"('{t}', '{e}', '{rx}')" for t, e, rx in T.EXPECTED)


@query(
    "inv_13_expected_vs_found",
    WITH + f""" SELECT c.case_id, e.title, e.expected, count(v.event_id) AS found FROM (SELECT DISTINCT case_id FROM v_parts) c
        CROSS JOIN (VALUES {EXPECTED_VALUES}) e(title, expected, rx) LEFT JOIN v_parts v ON v.case_id = c.case_id AND regexp_matches(v.i, e.rx) GROUP BY ALL""",
)
def inv_13b(spark, sf):
    return inv.expected_vs_found(_paths(spark, sf))


# ---- sidecars and families ---------------------------------------------------------------


def _hives(spark, sf):
    return _paths(spark, sf).select("case_id", "os_path").distinct().where(
        F.lower(paths.file_name(F.col("os_path"))).isin(*cat.HIVE_NAMES)
    )


HIVES = """ds AS (SELECT DISTINCT case_id, os_path, p, n, regexp_replace(p, '/[^/]*$', '') AS d FROM v_parts),
    hv AS (SELECT * FROM ds WHERE n IN ('ntuser.dat', 'usrclass.dat', 'amcache.hve', 'sam', 'security', 'software', 'system', 'default', 'components', 'settings.dat', 'drvindex.dat'))"""


@query(
    "join_10_hive_sidecars",
    WITH + ", " + HIVES + """ SELECT h.case_id, h.os_path AS hive_path, f.os_path AS sidecar_path, 'named' AS kind FROM hv h JOIN ds f ON f.case_id = h.case_id AND f.d = h.d AND f.n IN (h.n || '.log', h.n || '.log1', h.n || '.log2')
        UNION ALL SELECT h.case_id, h.os_path, f.os_path, 'folder' FROM hv h JOIN ds f ON f.case_id = h.case_id AND f.d = h.d AND (f.n LIKE '%.blf' OR f.n LIKE '%.regtrans-ms')""",
)
def join_10(spark, sf):
    return inv.with_sidecars(_hives(spark, sf), _paths(spark, sf).select("case_id", "os_path").distinct())


@query(
    "join_10_transaction_logs",
    WITH + ", " + HIVES + """ SELECT h.case_id, h.os_path AS hive_path, coalesce(string_agg(f.os_path, ',' ORDER BY f.p), '') AS logs, count(f.p) > 0 AS transaction_logs_found
        FROM hv h LEFT JOIN ds f ON f.case_id = h.case_id AND f.d = h.d AND f.n IN (h.n || '.log1', h.n || '.log2') GROUP BY h.case_id, h.os_path""",
)
def join_10b(spark, sf):
    out = inv.sidecar_lists(_hives(spark, sf), _paths(spark, sf).select("case_id", "os_path").distinct())
    return out.select("case_id", "hive_path", F.array_join("transaction_logs", ",").alias("logs"), "transaction_logs_found")


@query(
    "join_11_sqlite_family",
    WITH + """, ds AS (SELECT DISTINCT case_id, os_path, n, regexp_replace(p, '/[^/]*$', '') AS d FROM v_parts)
        SELECT b.case_id, b.os_path AS base_path, f.os_path AS member_path FROM ds b JOIN ds f ON f.case_id = b.case_id AND f.d = b.d AND (f.n = b.n OR starts_with(f.n, b.n || '-'))
        WHERE b.n IN ('history', 'places.sqlite')""",
)
def join_11(spark, sf):
    files = _paths(spark, sf).select("case_id", "os_path").distinct()
    bases = files.where(F.lower(paths.file_name(F.col("os_path"))).isin("history", "places.sqlite"))
    return inv.sqlite_family(bases, files)


# ---- dedup, order, limits ----------------------------------------------------------------


@query(
    "dst_1_distinct_first_seen",
    "SELECT key, min(event_id) AS first_seq FROM (SELECT event_id, upper(substring(event_type, 1, 1)) || ':' AS key FROM events WHERE event_id % 4 <> 3) GROUP BY key",
)
def dst_1(spark, sf):
    letter = F.substring("event_type", 1, 1)
    k = F.col("event_id") % 4
    spelled = F.when(k == 0, letter).when(k == 1, F.concat(F.lit("\\\\.\\"), letter, F.lit(":"))).when(k == 2, F.concat(letter, F.lit(":\\"))).otherwise(F.lit("none"))
    df = read(spark, sf, "events").select("event_id", spelled.alias("v"))
    return inv.distinct_first_seen(df, paths.drive_volume(F.col("v")), "event_id")


@query("dst_2_path_dedup", cte("v_paths") + " SELECT case_id, arg_min(os_path, event_id) AS os_path, min(event_id) AS event_id FROM v_paths GROUP BY case_id, replace(os_path, chr(92), '/')")
def dst_2(spark, sf):
    return inv.dedup_paths(_paths(spark, sf).select("event_id", "case_id", "os_path"), "os_path", "event_id")


@query("srt_1_case_insensitive_order", cte("v_paths") + " SELECT event_id, os_path FROM v_paths ORDER BY lower(os_path), os_path")
def srt_1(spark, sf):
    return inv.sort_ci(_paths(spark, sf).select("event_id", "os_path"))


@query(
    "lim_1_group_limit",
    """SELECT event_id, event_type AS case_id, user_id FROM (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS r
        FROM events WHERE (event_type, user_id) IN (SELECT event_type, user_id FROM events GROUP BY ALL HAVING bool_or(event_id % 3 = 0))) WHERE r <= 10""",
)
def lim_1(spark, sf):
    df = read(spark, sf, "events").select("event_id", F.col("event_type").alias("case_id"), "user_id")
    return inv.limit_groups(df, ["case_id"], "user_id", F.col("event_id") % 3 == 0, 10)


@query("agg_4_distinct_sorted", WITH_DETECTED + f" SELECT DISTINCT {COLLECTION} AS collection FROM v_detected ORDER BY 1")
def agg_4(spark, sf):
    return inv.distinct_sorted(det.build_plans(_detected(spark, sf)), "collection")


# ---- verification ------------------------------------------------------------------------


def _copies(spark, sf):
    """Documents as copied files, and a manifest of them with altered and missing entries."""
    docs = read(spark, sf, "documents")
    path = F.concat(F.lit("C/docs/"), F.col("doc_id"), F.lit(".txt"))
    files = docs.where("doc_id % 89 <> 1").select(F.col("source").alias("case_id"), path.alias("archive_path"), F.encode("text", "UTF-8").alias("content"))
    sha = F.sha2(F.encode(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), "UTF-8"), 256)
    manifest = docs.where("doc_id % 97 <> 0").select(F.col("source").alias("case_id"), path.alias("archive_path"), sha.alias("sha256"))
    return files, manifest


VERIFY = """v AS (SELECT source AS case_id, 'C/docs/' || doc_id || '.txt' AS archive_path, CASE WHEN doc_id % 89 <> 1 THEN sha256(text) END AS actual_sha256,
    CASE WHEN doc_id % 97 <> 0 THEN sha256(CASE WHEN doc_id % 50 = 0 THEN text || 'x' ELSE text END) END AS recorded_sha256 FROM documents),
    w AS (SELECT *, CASE WHEN actual_sha256 IS NULL THEN 'missing' WHEN recorded_sha256 IS NULL THEN 'extra' WHEN actual_sha256 = recorded_sha256 THEN 'ok' ELSE 'mismatch' END AS status
    FROM v WHERE actual_sha256 IS NOT NULL OR recorded_sha256 IS NOT NULL)"""


@query("inv_11_hash_verification", f"WITH {VERIFY} SELECT * FROM w")
def inv_11(spark, sf):
    return inv.verify_hashes(*_copies(spark, sf))


@query(
    "inv_11_hash_failures",
    f"WITH {VERIFY} SELECT case_id, archive_path, CASE status WHEN 'missing' THEN 'copy' ELSE 'verify' END AS operation, CASE status WHEN 'missing' THEN 'file is not in the package' ELSE 'SHA-256 mismatch: recorded ' || recorded_sha256 || ', found ' || actual_sha256 END AS error FROM w WHERE status IN ('missing', 'mismatch')",
)
def inv_11b(spark, sf):
    return inv.hash_failures(inv.verify_hashes(*_copies(spark, sf)))
