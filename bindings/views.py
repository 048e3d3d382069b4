"""Derived inputs over the given tables, in text that both Spark and DuckDB run.

Forensic artifacts do not occur in the tables, so paths, log lines, byte runs and so on are derived
from their rows; every view grows with the table it is derived from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Path shapes: @U user, @E event, @Q event/60, @S one of five ids.
PATHS = r"""
C/Users/u@U/NTUSER.DAT
C/Users/u@U/Desktop/a@E.lnk
C/$Recycle.Bin/S-1-5-@S/$I@Q.txt
C/$Recycle.Bin/S-1-5-@S/$R@Q.txt
C/$Recycle.Bin/S-1-5-@S/$R@Q/sub/f@E.bin
C/Users/u@U/AppData/Local/Google/Chrome/User Data/Default/History
C/Users/u@U/AppData/Local/Microsoft/Edge/User Data/Default/History
C/Users/u@U/AppData/Roaming/Mozilla/Firefox/Profiles/p@E/places.sqlite
Macintosh/Users/Mac@U/Library/Application Support/Google/Chrome/Default/History
C/ProgramData/Microsoft/Windows Defender/Support/MPLog-@E.log
C/Windows/System32/winevt/Logs/Sec@E.evtx
C/WINDOWS/system32/WinEvt/logs/App@E.EVTX
C/Windows/Prefetch/CMD-@E.pf
C/Windows/Prefetch/AgRobust@E.db
C/Windows/System32/config/SYSTEM
C/Windows/System32/config/SOFTWARE.LOG1
C/Windows/System32/config/txr@E.blf
C/Windows/System32/Tasks/My/task@E
C/Windows/Tasks/old@E.job
C/Windows/Tasks/old@E.txt
C/Users/u@U/AppData/Local/Microsoft/Windows/UsrClass.dat
C/$Extend/$UsnJrnl/$J.bin
C/data/c_usn_journal_j.bin
home/l@U/.bash_history
srv/root/.zsh_history
C/Users/u@U/AppData/Roaming/Microsoft/Windows/PowerShell/PSReadLine/ConsoleHost_history.txt
C/Users/u@U/Documents/PowerShell/Modules/m@E/m.psm1
C/Users/u@U/Documents/PowerShell/Modules/m@E/big.dll
C/Users/Public/Desktop/p@E.lnk
C/Users/u@U/AppData/Roaming/Microsoft/Windows/Recent/AutomaticDestinations/@E.automaticDestinations-ms
C/Windows/System32/sru/SRUDB.dat
C/Windows/System32/wbem/Repository/OBJECTS.DATA
C/Windows/System32/wbem/x@E.mof
C/$MFT.bin
C/Windows/AppCompat/Programs/Amcache.hve
C/RECYCLER/S-1-5-@S/INFO2
C/System Volume Information/RP@Q/rp.log
C/Users/u@U/AppData/Local/ConnectedDevicesPlatform/L.u@U/ActivitiesCache.db
C\Users\u@U\Downloads\file@E.docx
C/Users/u@U/Mail/box@E.pst
C/ProgramData/Microsoft/Network/Downloader/qmgr0.dat
C/ProgramData/Microsoft/Search/Data/Applications/Windows/Windows.edb
C/Windows/AppPatch/Custom/x@E.sdb
Macintosh/Users/Mac@U/Library/Preferences/com.apple.LaunchServices.QuarantineEventsV2
C/Users/u@U/AppData/Local/Google/Chrome/User Data/Default/History-journal
C/Users/u@U/AppData/Local/Google/Chrome/User Data/Default/Extensions/ext@E/1.0/manifest.json
$metadata/collectors/C/windows_prefetch/manifest.json
C/Documents and Settings/Old@U/Recent/x@E.tmp
C/Users/u@U/Documents/PowerShell_transcript.@E.txt
C/Windows/ServiceProfiles/LocalService/NTUSER.DAT
C/$Recycle.Bin/S-1-5-@S/desktop.ini
C/Users/u@U/AppData/Roaming/Microsoft/Windows/Start Menu/Programs/deep/p@E.lnk
C/Users/u@U/ntuser.dat.LOG1
C/Windows/System32/config/SYSTEM.LOG2
C/Users/Default/NTUSER.DAT
C/EFI/Microsoft/Boot/BCD
D/data/notes@E.txt
C/Users/u@U/Documents/PowerShell/Modules/m@E/m.dll.config
C/Windows/SchedLgU.txt
c/users/u@U/desktop/A@E.LNK
""".strip().split("\n")

_TOKENS = {
    "@U": "CAST(user_id AS STRING)",
    "@E": "CAST(event_id AS STRING)",
    "@Q": "CAST(CAST(floor(event_id / 60) AS BIGINT) AS STRING)",
    "@S": "CAST(CAST(floor(event_id / 60) AS BIGINT) % 5 AS STRING)",
}


def literal(template: str) -> str:
    """SQL text expression of a template; backslashes become ``chr(92)`` in both dialects."""
    parts = []
    for piece in re.split(r"(@[UEQS]|\\)", template):
        if piece in _TOKENS:
            parts.append(_TOKENS[piece])
        elif piece == "\\":
            parts.append("chr(92)")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return "concat(" + ", ".join([*parts, "''"]) + ")"


def choose(selector: str, templates: list[str]) -> str:
    """SQL picking one template by number and filling in its tokens."""
    picked = "split_part('{}', '|', CAST({} AS INT) + 1)".format("|".join(templates).replace("\\", "~"), selector)
    for token, value in [("~", "chr(92)"), *_TOKENS.items()]:
        picked = f"replace({picked}, '{token}', {value})"
    return picked


def _two(expression: str) -> str:
    return f"lpad(CAST({expression} AS STRING), 2, '0')"


_CLOCK = f"concat({_two('hour(ts)')}, ':', {_two('minute(ts)')}, ':', {_two('second(ts)')})"
_ISO = f"concat(CAST(CAST(ts AS DATE) AS STRING), 'T', {_CLOCK}, '.', lpad(CAST(event_id % 1000 AS STRING), 3, '0'))"
_US = f"concat(CAST(month(ts) AS STRING), '/', CAST(day(ts) AS STRING), '/', CAST(year(ts) AS STRING), ' ', {_CLOCK})"

LOG_LINES = {
    0: (_ISO, r' Engine:Setting original file name "app@U" for "c:\dir\app@E.dll", hr=0x0'),
    1: (_ISO, r" [RTP] [MpRtp] Engine scan: \Device\HarddiskVolume4\f@E.exe. status=0x4005, threatid=0x8@U, sigseq=0x55"),
    2: (None, r"  C:\Users\u@U\cont@E"),
    3: (f"concat({_ISO}, '+02:30')", " WARNING: the previous shutdown was not expected"),
    4: (None, "Beginning quarantine recovery"),
    5: (None, "IDynamicConfig::ReportError value=MpBlockLevel hr=0x8007000d"),
    6: (_US, " INFO: something=Eicar@U, status=0"),
    7: (None, ""),
}


def _log_case() -> str:
    cases = []
    for i, (stamp, tail) in LOG_LINES.items():
        text = literal(tail) if stamp is None else f"concat({stamp}, {literal(tail)})"
        cases.append(f"WHEN {i} THEN {text}")
    return "CASE event_id % 8 " + " ".join(cases) + " END"


VIEWS = {
    "v_paths": f"""
        SELECT event_id, event_type AS case_id, user_id, {choose('event_id % 60', PATHS)} AS os_path,
               event_id * 4001 % 41943040 AS size, event_id % 7 = 0 AS is_reparse
        FROM @events@""",
    "v_log": f"""
        SELECT event_type AS case_id, {literal('C/Support/MPLog-@U.log')} AS os_path, user_id, event_id, ts,
               event_id + 1 AS line_no, {_log_case()} AS line
        FROM @events@""",
    "v_shell": f"""
        SELECT 'host' AS case_id, {literal('home/l@U/.bash_history')} AS os_path, event_id + 1 AS line_no,
               CASE event_type
                 WHEN 'error' THEN concat('#', CAST(1714929600 + event_id * 60 AS STRING))
                 WHEN 'view' THEN concat(': ', CAST(1700000000 + event_id AS STRING), ':0;cmd ', CAST(event_id AS STRING))
                 WHEN 'signup' THEN '#'
                 ELSE concat('  run ', CAST(event_id AS STRING), ' ') END AS line
        FROM @events@""",
    "v_runs": """
        SELECT 'host' AS case_id, CAST(user_id AS STRING) AS os_path, event_id AS seq,
               (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 64 AS logical_offset,
               CAST(64 AS BIGINT) AS length, event_type = 'error' AS sparse,
               CASE WHEN event_type = 'view' THEN CAST(NULL AS BIGINT)
                    ELSE 4096 + (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 64 END AS volume_offset
        FROM @events@""",
    "v_windows": """
        SELECT 'host' AS case_id, CAST(user_id AS STRING) AS os_path, user_id * 3 AS window_start,
               count(*) * 64 - 100 AS window_end
        FROM @events@ GROUP BY user_id""",
    "v_events": """
        SELECT CAST(user_id AS STRING) AS run_id, event_id AS seq,
               CASE event_type WHEN 'view' THEN 'plan_started' WHEN 'click' THEN 'plan_finished'
                    WHEN 'purchase' THEN 'plan_finished' WHEN 'signup' THEN 'completed' ELSE 'noise' END AS type,
               CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'family' END AS parser,
               CASE WHEN event_type IN ('view', 'click', 'purchase') THEN concat('artifact', CAST(event_id % 5 AS STRING)) END AS artifact,
               CASE event_type WHEN 'click' THEN 'ok' WHEN 'purchase' THEN 'ERROR' END AS status
        FROM @events@""",
    "v_counters": """
        SELECT l_suppkey, CAST(l_suppkey % 7 AS BIGINT) AS host, concat('V', CAST(l_suppkey AS STRING)) AS volume,
               (year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS sample_no, sum(CAST(l_quantity AS BIGINT)) AS bytes
        FROM @lineitem@ GROUP BY l_suppkey, year(l_shipdate), month(l_shipdate)""",
    "v_keys": r"""
        SELECT page_id AS key_id,
               CASE page_id % 11 WHEN 0 THEN 'NTUSER.DAT' WHEN 1 THEN 'UsrClass.dat' WHEN 2 THEN 'Amcache.hve'
                    WHEN 3 THEN 'SAM' WHEN 4 THEN 'SECURITY' WHEN 5 THEN 'SOFTWARE' WHEN 6 THEN 'SYSTEM'
                    WHEN 7 THEN 'DEFAULT' WHEN 8 THEN 'settings.dat' WHEN 9 THEN 'other.bin' ELSE 'drvindex.dat' END AS hive_name,
               concat('C/Users/U', CAST(page_id % 13 AS STRING), '/hive') AS source_path,
               concat(chr(92), CASE WHEN page_id % 3 = 0 THEN 'ROOT' ELSE concat('S-1-5-21-', CAST(page_id AS STRING), CASE WHEN page_id % 2 = 0 THEN '_Classes' ELSE '' END) END,
                      chr(92), replace(substring(url, 8), '/', chr(92))) AS key_path
        FROM @pages@""",
}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if f"@{t}@" in text]
    for table in used:
        text = text.replace(f"@{table}@", "{" + table + "}")
    return spark.sql(text, **{t: read(spark, sf, t) for t in used})


def cte(*names: str) -> str:
    """``WITH`` clause of derived inputs for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({plain(n)})" for n in names)


def plain(name: str) -> str:
    return re.sub(r"@([a-z]+)@", r"\1", VIEWS[name])
