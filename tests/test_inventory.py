import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from casework.functions import paths
from casework.operators import detect as det, inventory as inv, runs
from casework.plans import catalog as cat, decoders, parse, targets as T
from casework.sinks import results
from casework.sources import files as src, records


def files_df(spark, names, extra=()):
    rows = [("c", p, i, 10, False) for i, p in enumerate(names)]
    return spark.createDataFrame(rows, "case_id string, os_path string, seq bigint, size bigint, is_reparse boolean")


def families(spark, path):
    return sorted(r.family for r in det.detect(files_df(spark, [path])).collect())


@pytest.mark.parametrize(
    "path,expected",
    [
        ("C/Windows/System32/config/SYSTEM", ["windows_registry", "windows_services", "windows_shimcache"]),
        ("C/$Extend/$UsnJrnl/$J.bin", ["windows_usn_journal"]), ("C/other/$J.bin", []), ("x/C_USN_JOURNAL_J.BIN", ["windows_usn_journal"]),
        ("C/Windows/Tasks/a.job", ["windows_scheduled_tasks"]), ("C/Windows/Tasks/a.txt", []), ("C/Windows/Tasks/.job", []),
        ("mplog-x.LOG", ["windows_mplogs"]), (".bash_history", ["linux_shell_history"]), (".evtx", []), ("a.evtx", ["windows_event_logs"]),
        (r"C\Users\a\AppData\Local\Microsoft\Edge\User Data\D\History", ["windows_browser_history"]), ("C/$Recycle.Bin/S-1/$Iabc", ["windows_recycle_bin"]),
    ],
)
def test_detection(spark, path, expected):
    assert families(spark, path) == expected


def test_detection_needs_magic_when_content_is_given(spark):
    df = spark.createDataFrame([("c", "SAM", bytearray(b"regf1")), ("c", "x/SAM", bytearray(b"no"))], "case_id string, os_path string, content binary")
    hit = det.detect(df, content="content").where("family = 'windows_registry'").collect()
    assert [r.os_path for r in hit] == ["SAM"]


def test_rules_cover_the_catalog():
    assert {r.family for r in cat.DETECTION_RULES} == set(cat.PARSER_FAMILIES) and len(cat.COLLECTIONS) == 25


def test_work_units_and_selection(spark):
    found = det.detect(files_df(spark, ["C/Logs/a.evtx", "c/logs/b.EVTX", "C/x/c.evtx", "C/NTUSER.DAT"]))
    units = {(r.family, r.unit): r.n_files for r in det.work_units(found, "seq").collect()}
    assert units[("windows_event_logs", "C/Logs")] == 2 and units[("windows_event_logs", "C/x")] == 1
    plans = det.build_plans(found)
    assert det.select_plans(plans, ["windows_event_logs::Windows.EventLogs"]).count() == 1
    with pytest.raises(det.NoPlanSelected):
        det.select_plans(plans, ["nothing"], check=True)


@pytest.mark.parametrize(
    "root,path,kind,pair,ext,sid",
    [
        ("modern", "S-1-5-21/$IABC.txt", "metadata_i", "ABC", ".txt", "S-1-5-21"), ("modern", "S-1-5-21/$rABC", "payload_r", "ABC", None, "S-1-5-21"),
        ("modern", "S-1-5-21/$RDIR.d/sub/$I", "recycled_directory_member", "DIR", None, "S-1-5-21"), ("modern", "desktop.ini", "desktop_ini", None, ".ini", None),
        ("legacy", "S-1/Dc1.txt", "legacy_renamed", None, ".txt", "S-1"), ("legacy", "S-1/INFO2", "info2", None, None, "S-1"), ("modern", "S-1/x", "other", None, None, "S-1"),
        ("modern", "x.y", "root_file", None, ".y", None),
    ],
)
def test_recycle(spark, root, path, kind, pair, ext, sid):
    r = spark.range(1).select(inv.classify_recycle(F.lit(root), F.lit(path)).alias("r")).first().r
    assert (r.artifact_kind, r.pair_id, r.extension, r.recycle_sid) == (kind, pair, ext, sid)


@pytest.mark.parametrize(
    "path,size,reparse,kind,decision,reason",
    [
        ("C/Users/a/Documents/PowerShell/profile.ps1", 10, False, "profile_script", "collect", None),
        ("C/Users/a/Documents/PowerShell/Modules/x.dll", 10, False, "module_support_file", "skip", "unsupported_extension"),
        ("C/Users/a/Documents/PowerShell/Modules/x.dll", 10, True, "module_support_file", "skip", "reparse_or_symlink"),
        ("C/Users/a/Documents/PowerShell/Modules/x.ps1", 20971521, False, "module_support_file", "skip", "size_limit_exceeded:20971520"),
        ("C/Users/a/Documents/PowerShell_transcript.1.txt", 10, False, "transcript", "collect", None),
        ("C/Users/Public/Documents/PowerShell/profile.ps1", 10, False, None, None, None), ("C/Users/a/Documents/PowerShell_transcript/x.txt", 1, False, None, None, None),
    ],
)
def test_powershell(spark, path, size, reparse, kind, decision, reason):
    df = spark.createDataFrame([(path, size, reparse)], "os_path string, size bigint, is_reparse boolean")
    r = inv.powershell_policy(df).first()
    assert (r.kind, r.decision, r.reason) == (kind, decision, reason)


def test_targets(spark):
    names = [
        "C/Users/a/AppData/Local/Google/Chrome/User Data/P/Network/Cookies-journal", "C/Users/a/AppData/Local/Google/Chrome/User Data/P/Sessions/1",
        "C/Users/defaultapppool/NTUSER.DAT", "C/Users/Public/NTUSER.DAT", "C/Windows/System32/wbem/Repository2/x/y",
    ]
    found = inv.find_targets(files_df(spark, names), T.BROWSER_TARGETS + T.REGISTRY_TARGETS + T.OTHER_TARGETS)
    got = sorted((r.seq, r.collector, r.kind) for r in found.collect())
    assert got == [
        (0, "windows_browser_artifacts", "network_cookies"), (1, "windows_browser_artifacts", "profile_dir"), (2, "windows_browser_artifacts", "user_hive"),
        (2, "windows_registry", "registry_hive"), (3, "windows_browser_artifacts", "user_hive"), (4, "windows_wmi_repository", "repository_file"),
    ]


def test_sidecars_and_families(spark):
    files = files_df(spark, ["C/c/SYSTEM", "C/C/system.log1", "C/c/SYSTEM.LOG2", "C/c/a.blf", "C/d/SYSTEM.LOG1", "C/c/History", "C/c/history-wal", "C/c/Historyx"])
    hives = files.where("os_path = 'C/c/SYSTEM'")
    got = {(r.sidecar_path, r.kind) for r in inv.with_sidecars(hives, files).collect()}
    assert got == {("C/C/system.log1", "named"), ("C/c/SYSTEM.LOG2", "named"), ("C/c/a.blf", "folder")}
    assert inv.sidecar_lists(hives, files).first().transaction_logs == ["C/C/system.log1", "C/c/SYSTEM.LOG2"]
    family = inv.sqlite_family(files.where("os_path = 'C/c/History'"), files)
    assert {r.member_path for r in family.collect()} == {"C/c/History", "C/c/history-wal"}


def test_dedup_is_case_sensitive_and_first_wins(spark):
    out = inv.dedup_paths(files_df(spark, ["a/b", r"a\b", "A/b"]), "os_path", "seq")
    assert sorted(r.os_path for r in out.collect()) == ["A/b", "a/b"]
    with pytest.raises(inv.NoVolumeSelected):
        inv.distinct_first_seen(files_df(spark, ["xy"]), paths.drive_volume(F.col("os_path")), "seq", check=True)


def test_plan_state(spark):
    rows = [
        ("r", 1, "plan_started", "p", "a", None), ("r", 2, "plan_started", "p", "b", None), ("r", 3, "plan_finished", "p", "a", "ok"),
        ("r", 4, "plan_queued", "p", "c", None), ("s", 1, "plan_started", "p", "a", None), ("s", 2, "completed", None, None, None),
    ]
    df = spark.createDataFrame(rows, "run_id string, seq bigint, type string, parser string, artifact string, status string")
    got = {(r.run_id, r.plan_id): (r.status, r.active) for r in runs.fold_plan_state(df).collect()}
    assert got == {("r", "p::a"): ("Complete", False), ("r", "p::b"): ("Running", True), ("r", "p::c"): ("Queued", False), ("s", "p::a"): ("Running", False)}


def test_bulk(spark):
    df = spark.createDataFrame([("p", i, f'{{"i":{i}}}') for i in range(5)], "plan string, n bigint, doc string")
    got = {r.batch_no: (r.records, r.payload) for r in results.bulk_batches(df, ["plan"], "n", F.col("doc"), 2, width=3).collect()}
    assert got[0] == (2, '{"index":{}}\n{"i":0}\n{"index":{}}\n{"i":1}\n') and got[2][0] == 1
    assert results.batch_ids(df, ["plan"], "n", 0).agg(F.countDistinct("batch_no")).first()[0] == 5
    bodies = [('{"errors":false,"items":[{"index":{"status":201}}]}',), ('{"errors":true,"items":[{"index":{"status":200}}]}',), ("junk",)]
    out = results.reconcile_bulk(spark.createDataFrame(bodies, "body string"), ["body"]).collect()
    assert [(r.indexed, r.error) for r in out] == [(1, None), (0, "response reported errors"), (0, "response reported errors")]


def test_unknown_decoder(spark):
    with pytest.raises(decoders.UnknownDecoder):
        decoders.decode(files_df(spark, ["a"]), "No.Such")


@pytest.mark.parametrize("name,kept", [("a/../b", "b"), ("../a", None), ("/a", None), ("a/./b", "a/b"), ("C:/x", None)])
def test_enclosed(name, kept):
    assert src.enclosed(name) == kept


def test_packages_end_to_end(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    with zipfile.ZipFile(folder / "case1.zip", "w") as z:
        z.writestr("C/S/MPLog-1.log", "2026-01-01T00:00:00 Engine: started\nBeginning quarantine\n")
        z.writestr("home/bob/.bash_history", "#1714929600\nls -la\n")
        z.writestr("C/x/INFO2", b"short")
        z.writestr("../evil.txt", "x")
    (folder / "broken.zip").write_bytes(b"not a zip")
    listed = {r.member: r.status for r in src.list_packages(spark, str(folder)).collect()}
    assert listed["../evil.txt"] == "rejected" and any(s.startswith("unreadable") for s in listed.values())
    with pytest.raises(Exception, match="leaves its root"):
        src.read_packages(spark, str(folder), fail_fast=True).collect()
    entries = parse.parse_packages(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "scratch"))
    got = {r.parser: (r.status, r.records) for r in entries.where("case_id = 'case1'").collect() if r.status != "skipped"}
    assert got == {
        "windows_mplogs": ("ok", 2), "linux_shell_history": ("ok", 1), "windows_recycle_bin_info2": ("ok", None), "package": ("error", None),
    }
    broken = [r for r in entries.where("case_id = 'broken' AND status = 'error'").collect()]
    assert [r.parser for r in broken] == ["package"] and broken[0].error.startswith("unreadable")
    problems = spark.read.json(str(tmp_path / "out/diagnostics/windows_recycle_bin_info2/Windows.RecycleBin.Info2")).collect()
    assert [(r.case_id, r.error) for r in problems] == [("case1", "file too small")]
    shell = spark.read.json(str(tmp_path / "out/linux_shell_history/Linux.Shell.History")).first()
    assert (shell.user, shell.command, shell.timestamp) == ("bob", "ls -la", "2024-05-05T17:20:00Z")


def test_chunked_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("a.bin", bytes(range(256)) * 10)
        z.writestr("empty", b"")
    members = src.list_packages(spark, str(tmp_path))
    rows = src.read_member_chunks(members, 1000).collect()
    joined = b"".join(bytes(r.content) for r in sorted(rows, key=lambda r: r.chunk_no) if r.member == "a.bin")
    assert joined == bytes(range(256)) * 10 and len(rows) == 4
    big = {r.archive_path: r.status for r in src.read_packages(spark, str(tmp_path), max_content=100).collect()}
    assert big == {"a.bin": "oversize", "empty": "ok"}


def test_one_damaged_member_stays_alone(spark, tmp_path):
    folder = tmp_path / "ev one #1 50% done"  # blanks, # and % belong to the name
    folder.mkdir()
    for case in ("good", "hurt"):
        with zipfile.ZipFile(folder / f"{case}.zip", "w") as z:
            z.writestr("C/S/MPLog-1.log", f"2026-01-01T00:00:00 Engine: {case}\n")
            z.writestr("C/S/MPLog-2.log", f"2026-01-01T00:00:00 Engine: second {case}\n")
            z.writestr("home/bob/.bash_history", "ls\n")
    raw = (folder / "hurt.zip").read_bytes()
    at = raw.index(b"Engine: hurt")
    (folder / "hurt.zip").write_bytes(raw[:at] + b"EnginX" + raw[at + 6 :])
    entries = parse.parse_packages(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "scratch")).collect()
    got = {(r.case_id, r.parser): (r.status, r.records) for r in entries if r.status != "skipped"}
    assert got == {
        ("good", "windows_mplogs"): ("ok", 2), ("good", "linux_shell_history"): ("ok", 1), ("hurt", "windows_mplogs"): ("error", None),
        ("hurt", "linux_shell_history"): ("ok", 1),
    }
    assert {r.exported_records for r in entries} == {None}
    assert {r.output_path.rsplit("/", 1)[-1] for r in entries if r.parser == "windows_mplogs"} == {"Windows.Defender.MPLog"}
    rows = spark.read.json(str(tmp_path / "out/windows_mplogs/Windows.Defender.MPLog")).groupBy("case_id").count().collect()
    assert {r[0]: r[1] for r in rows} == {"good": 2, "hurt": 1}
    bad = spark.read.json(str(tmp_path / "out/diagnostics/windows_mplogs/Windows.Defender.MPLog")).collect()
    assert [(r.case_id, r.os_path) for r in bad] == [("hurt", "C/S/MPLog-1.log")] and "CRC" in bad[0].error


def test_members_larger_than_a_cell_are_reported_and_hashed(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("C/RECYCLER/S-1-5-1/INFO2", b"x" * 3000)
    members = src.list_packages(spark, str(tmp_path))
    entries = parse.parse_members(spark, members, str(tmp_path / "out"), str(tmp_path / "scratch"), cell=1000).collect()
    assert [(r.status, r.error) for r in entries if r.parser == "windows_recycle_bin_info2"] == [("error", "larger than one cell: 3000 bytes")]
    digest = hashlib.sha256(b"x" * 3000).hexdigest()
    hashed = src.hash_members(members).withColumn("case_id", F.lit("c"))
    manifest = spark.createDataFrame([("c", "C/RECYCLER/S-1-5-1/INFO2", digest)], "case_id string, archive_path string, sha256 string")
    assert [r.status for r in inv.verify_hashes(hashed, manifest).collect()] == ["ok"]


def test_line_based_members_larger_than_a_cell_give_the_same_rows(spark, tmp_path):
    """Logs and histories beyond one cell are read by pieces; a damaged one has an error and no rows."""
    folder = tmp_path / "in"
    folder.mkdir()
    log = "".join(f"2026-01-01T00:00:{i % 60:02d} Engine: scan {i} path=C:\\\\f{i}\n" + "  more, indented\n" * (i % 3) for i in range(400))
    with zipfile.ZipFile(folder / "one.zip", "w") as z:
        z.writestr("C/S/MPLog-1.log", b"\xff\xfe" + log.encode("utf-16-le"))
        z.writestr("C/S/MPLog-2.log", log)
        z.writestr("home/bob/.bash_history", "#1714929600\nls \xff\n" * 300)
        z.writestr("home/al/.bash_history", "#1714929600\nls\n")
    with zipfile.ZipFile(folder / "two.zip", "w") as z:
        z.writestr("C/S/MPLog-1.log", log)
    raw = bytearray((folder / "two.zip").read_bytes())
    raw[3000] ^= 1
    (folder / "two.zip").write_bytes(raw)
    results = {}
    for name, cell in (("whole", 1 << 30), ("cut", 1000)):
        out = str(tmp_path / name)
        entries = parse.parse_members(spark, src.list_packages(spark, str(folder)), out, f"{out}-scratch", cell=cell).collect()
        rows = [sorted(map(repr, spark.read.json(f"{out}/{p}").collect())) for p in ("windows_mplogs/Windows.Defender.MPLog", "linux_shell_history/Linux.Shell.History")]
        results[name] = (sorted((r.case_id, r.parser, r.status, r.records) for r in entries if r.status != "skipped"), rows)
    assert results["cut"] == results["whole"] and ("two", "windows_mplogs", "error", None) in results["cut"][0]


def test_a_hive_without_its_magic_gets_no_plan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for case, magic in (("real", b"regf"), ("fake", b"nope")):
        with zipfile.ZipFile(tmp_path / "in" / f"{case}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("C/Windows/System32/config/SYSTEM", magic + bytes(100_000))
            z.writestr("C/Users/a/NTUSER.DAT", b"re")
    out = str(tmp_path / "out")
    entries = parse.parse_packages(spark, str(tmp_path / "in"), out, f"{out}-scratch").collect()
    hives = {r.case_id: r.status for r in entries if r.parser == "windows_registry"}
    assert set(hives) <= {"real", "fake"} and hives.get("fake", "skipped") == "skipped"
    plans = {(r.case_id, r.family) for r in spark.read.parquet(f"{out}-scratch/plans").collect()}
    assert ("real", "windows_registry") in plans and ("fake", "windows_registry") not in plans and ("fake", "windows_shimcache") in plans
    members = src.list_packages(spark, str(tmp_path / "in"))
    heads = [bytes(r.head) for r in src.read_member_heads(members, 4).collect()]
    assert sorted(heads) == [b"nope", b"re", b"re", b"regf"]


def test_unsupported_scheme_is_loud():
    with pytest.raises(src.UnsupportedScheme):
        src.located("wasb://container/x.zip")
    assert src.located("file:/a b/c#1%.zip")[1] == "/a b/c#1%.zip"


def test_malformed_results_fail(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert records.read_results(spark, str(tmp_path), "a bigint").count() == 2
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="bad.jsonl"):
        records.read_results(spark, str(tmp_path), "a bigint").collect()
