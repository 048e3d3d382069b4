"""Parser-family and collection catalogs, and the path rules that bind files to families.

Everything here is a fixed value: names and rules must be exactly these for results to agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casework.functions.flags import present
from casework.functions.paths import extension, file_name, norm_path

# Parser family -> collection it reads.
PARSER_FAMILIES = {
    "windows_browser_history": "windows_browser_artifacts_collection",
    "windows_event_logs": "windows_evtx_collection",
    "windows_prefetch": "windows_prefetch_collection",
    "windows_mplogs": "windows_mplogs_collection",
    "windows_bits": "windows_bits_collection",
    "windows_search": "windows_search_collection",
    "windows_outlook": "windows_outlook_collection",
    "windows_shimdb": "windows_shimdb_collection",
    "windows_userassist": "windows_registry_collection",
    "windows_shimcache": "windows_registry_collection",
    "windows_shellbags": "windows_registry_collection",
    "windows_amcache": "windows_registry_collection",
    "windows_shortcuts": "windows_lnk_collection",
    "windows_srum": "windows_srum_collection",
    "windows_users": "windows_registry_collection",
    "windows_services": "windows_registry_collection",
    "windows_jump_lists": "windows_jump_lists_collection",
    "windows_recycle_bin": "windows_recycle_bin_info2_collection",
    "windows_scheduled_tasks": "windows_scheduled_tasks_collection",
    "windows_wmi_persistence": "windows_wmi_repository_collection",
    "windows_mft": "windows_mft_collection",
    "windows_usn_journal": "windows_usn_journal_collection",
    "windows_registry": "windows_registry_collection",
    "windows_restore_point_log": "windows_restore_point_log_collection",
    "windows_recycle_bin_info2": "windows_recycle_bin_info2_collection",
    "windows_timeline": "windows_timeline_collection",
    "linux_shell_history": "linux_shell_history_collection",
    "macos_browser_history": "macos_browser_history_collection",
    "macos_quarantine_events": "macos_quarantine_events_collection",
}

# Collection name, platform, artifact title, has a live collector.
COLLECTIONS = [
    ("linux_shell_history_collection", "linux", "Linux shell history", False),
    ("macos_browser_history_collection", "macos", "macOS browser history", False),
    ("macos_quarantine_events_collection", "macos", "macOS quarantine events", False),
    ("windows_browser_artifacts_collection", "windows", "Windows Browser Artifacts", True),
    ("windows_prefetch_collection", "windows", "Windows Prefetch", True),
    ("windows_mplogs_collection", "windows", "Windows Microsoft Protection Logs", True),
    ("windows_bits_collection", "windows", "Windows BITS", False),
    ("windows_search_collection", "windows", "Windows Search", False),
    ("windows_outlook_collection", "windows", "Windows Outlook Stores", False),
    ("windows_shimdb_collection", "windows", "Windows Shim Databases", False),
    ("windows_powershell_activity_collection", "windows", "Windows PowerShell Activity", True),
    ("windows_scheduled_tasks_collection", "windows", "Windows Scheduled Tasks", True),
    ("windows_wmi_repository_collection", "windows", "Windows WMI Repository", True),
    ("windows_jump_lists_collection", "windows", "Windows Jump Lists", True),
    ("windows_lnk_collection", "windows", "Windows LNK Files", True),
    ("windows_evtx_collection", "windows", "Windows Event Logs", True),
    ("windows_registry_collection", "windows", "Windows Registry hives", True),
    ("windows_mft_collection", "windows", "Windows Master File Table", True),
    ("windows_logfile_collection", "windows", "Windows NTFS $LogFile", True),
    ("windows_indx_collection", "windows", "Windows NTFS INDX directory indexes", True),
    ("windows_srum_collection", "windows", "Windows SRUM", True),
    ("windows_restore_point_log_collection", "windows", "Windows restore point logs", False),
    ("windows_recycle_bin_info2_collection", "windows", "Windows Recycle Bin", True),
    ("windows_timeline_collection", "windows", "Windows Timeline", False),
    ("windows_usn_journal_collection", "windows", "Windows USN Journal", True),
]

# The hive files that carry registry keys, and their magic.
HIVE_NAMES = (
    "ntuser.dat", "usrclass.dat", "amcache.hve", "sam", "security", "software", "system",
    "default", "components", "settings.dat", "drvindex.dat",
)
HIVE_MAGIC = "72656766"


@dataclass(frozen=True)
class PathParts:
    """Lower-case views of a path that rules test; computed once per file."""

    path: Column
    name: Column
    ext: Column


@dataclass(frozen=True)
class Rule:
    """One binding of a path shape to a family's artifact.

    ``grain`` is the unit of work: each file, or each distinct parent directory. ``magic`` (hex)
    additionally needs the leading bytes of the file.
    """

    family: str
    artifact: str
    grain: str
    names: tuple[str, ...] = ()
    exts: tuple[str, ...] = ()
    prefix: str = ""
    suffix: str = ""
    contains: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    path_regex: str = ""
    path_suffix: str = ""
    magic: str = ""

    def matches(self, p: PathParts, head_hex: Column | None = None) -> Column:
        test = F.lit(True)
        if self.names:
            test = test & p.name.isin(*self.names)
        if self.exts:
            test = test & p.ext.isin(*self.exts)
        if self.prefix:
            test = test & p.name.startswith(self.prefix)
        if self.suffix:
            test = test & p.name.endswith(self.suffix)
        if self.path_suffix:
            test = test & p.path.endswith(self.path_suffix)
        if self.contains:
            any_of = F.lit(False)
            for fragment in self.contains:
                any_of = any_of | p.path.contains(fragment)
            test = test & any_of
        for fragment in self.excludes:
            test = test & ~p.path.contains(fragment)
        if self.path_regex:
            test = test & p.path.rlike(self.path_regex)
        if self.magic and head_hex is not None:
            test = test & F.coalesce(head_hex == self.magic, F.lit(False))
        return F.coalesce(test, F.lit(False))


EDGE = "/microsoft/edge/user data/"

# Vendor roots of Chromium-family profiles.
CHROMIUM_ROOTS = (
    "/google/chrome/user data/",
    "/bravesoftware/brave-browser/user data/",
    "/vivaldi/user data/",
    "/opera software/opera",
    "/chromium/user data/",
)

# Detection rules.
DETECTION_RULES = [
    Rule("windows_browser_history", "Windows.Applications.Chrome.History", "file",
         path_suffix="/history", contains=CHROMIUM_ROOTS, excludes=(EDGE,)),
    Rule("windows_browser_history", "Windows.Applications.Edge.History", "file",
         path_suffix="/history", contains=(EDGE,)),
    Rule("windows_browser_history", "Windows.Applications.Firefox.History", "file",
         path_suffix="/places.sqlite", contains=("/mozilla/firefox/profiles/",)),
    Rule("windows_event_logs", "Windows.EventLogs", "directory", exts=("evtx",)),
    Rule("windows_prefetch", "Windows.Prefetch", "directory", exts=("pf",)),
    Rule("windows_mplogs", "Windows.Defender.MPLog", "file", prefix="mplog", suffix=".log"),
    Rule("windows_bits", "Windows.BITS", "file", names=("qmgr.db", "qmgr0.dat", "qmgr1.dat")),
    Rule("windows_search", "Windows.Search", "file", names=("windows.edb", "windows.db")),
    Rule("windows_outlook", "Windows.Outlook", "file", exts=("ost", "pst")),
    Rule("windows_shimdb", "Windows.ShimDB", "file", exts=("sdb",)),
    Rule("windows_userassist", "Windows.Registry.UserAssist", "file", names=("ntuser.dat",)),
    Rule("windows_shimcache", "Windows.Registry.Shimcache", "file", names=("system",)),
    Rule("windows_shellbags", "Windows.Registry.Shellbags", "file", names=("ntuser.dat", "usrclass.dat")),
    Rule("windows_amcache", "Windows.Registry.Amcache", "file", names=("amcache.hve",)),
    Rule("windows_shortcuts", "Windows.Shortcuts", "directory", exts=("lnk",)),
    Rule("windows_srum", "Windows.SRUM", "file", names=("srudb.dat",)),
    Rule("windows_users", "Windows.Users", "file", names=("sam",)),
    Rule("windows_services", "Windows.Services", "file", names=("system",)),
    Rule("windows_jump_lists", "Windows.JumpLists", "file",
         exts=("automaticdestinations-ms", "customdestinations-ms")),
    Rule("windows_recycle_bin", "Windows.RecycleBin", "file", prefix="$i"),
    Rule("windows_scheduled_tasks", "Windows.ScheduledTasks", "file",
         path_regex=r"/windows/system32/tasks/|/windows/tasks/.*(?<!/)\.job$"),
    Rule("windows_wmi_persistence", "Windows.WMIPersistence", "directory", names=("objects.data",)),
    Rule("windows_mft", "Windows.MFT", "file", names=("$mft", "$mft.bin")),
    Rule("windows_usn_journal", "Windows.NTFS.UsnJournal.RawStream", "file",
         path_regex=r"_usn_journal_j\.bin$|(^|/)\$extend/\$usnjrnl/\$j\.bin$"),
    Rule("windows_registry", "Windows.Registry.Hive", "file", names=HIVE_NAMES, magic=HIVE_MAGIC),
    Rule("windows_restore_point_log", "Windows.Forensics.RestorePoint.Log", "file", names=("rp.log",)),
    Rule("windows_recycle_bin_info2", "Windows.RecycleBin.Info2", "file", names=("info2",)),
    Rule("windows_timeline", "Windows.Forensics.Timeline.ActivitiesCache", "file",
         names=("activitiescache.db",)),
    Rule("linux_shell_history", "Linux.Shell.History", "file", prefix=".", suffix="_history"),
    Rule("macos_browser_history", "MacOS.Applications.Chrome.History", "file",
         path_suffix="/history", contains=("/library/application support/google/chrome/",)),
    Rule("macos_quarantine_events", "MacOS.System.QuarantineEvents", "file",
         names=("com.apple.launchservices.quarantineeventsv2",)),
]


def with_path_parts(df: DataFrame, path: str = "os_path") -> tuple[DataFrame, PathParts]:
    """Add the lower-case path, name and extension columns rules work on."""
    df = df.withColumn("__lp", norm_path(F.col(path)))
    df = df.withColumn("__ln", file_name(F.col("__lp")))
    df = df.withColumn("__le", extension(F.col("__ln")))
    return df, PathParts(F.col("__lp"), F.col("__ln"), F.col("__le"))


def tag(df: DataFrame, tests: list[Column], labels: list[dict[str, str]]) -> DataFrame:
    """One row per test that holds, with the columns of its label.

    Tests give an array of their numbers, which is exploded: no join and no shuffle. The explode is an
    outer one because a plain one would have its filter, and with it every test, evaluated twice.
    """
    return tag_numbers(df, present([F.when(test, F.lit(i)) for i, test in enumerate(tests)]), labels)


def tag_numbers(df: DataFrame, numbers: Column, labels: list[dict[str, str]]) -> DataFrame:
    """One row per number in an array, with the columns of its label."""
    hits = df.withColumn("__numbers", numbers).withColumn("__hit", F.explode_outer("__numbers"))
    hits = hits.where(F.col("__hit").isNotNull())
    named = {
        name: F.get(F.array(*[F.lit(label[name]) for label in labels]), F.col("__hit")) for name in labels[0]
    }
    return hits.withColumns(named).drop("__numbers", "__hit")


def parser_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, f, c, True) for i, (f, c) in enumerate(PARSER_FAMILIES.items())]
    return spark.createDataFrame(rows, "family_order int, family string, collection string, enabled boolean")


def collection_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        COLLECTIONS, "collection string, platform string, artifact string, has_collector boolean"
    )


def validate_catalog(families: DataFrame, collections: DataFrame) -> DataFrame:
    """Families whose collection binding is blank or not registered; empty when all is well."""
    blank = F.trim("collection") == ""
    unknown = families.join(
        collections.select("collection"), "collection", "left_anti"
    ).where(~blank)
    return (
        families.where(blank).select("family", "collection", F.lit("missing collection binding").alias("problem"))
        .unionByName(unknown.select("family", "collection", F.lit("unregistered collection").alias("problem")))
    )


def coverage(families: DataFrame, collections: DataFrame) -> DataFrame:
    """Per collection: number of parser families, and which side is missing."""
    parsers = families.groupBy("collection").agg(F.count("*").alias("parsers"))
    joined = collections.join(parsers, "collection", "full_outer")
    has_parser, has_collector = F.col("parsers").isNotNull(), F.coalesce("has_collector", F.lit(False))
    return joined.select(
        "collection",
        F.coalesce("parsers", F.lit(0)).cast("bigint").alias("parsers"),
        F.when(has_parser & has_collector, "both")
        .when(has_collector, "collector_without_parser")
        .when(has_parser, "parser_without_collector")
        .otherwise("neither")
        .alias("coverage"),
    )
