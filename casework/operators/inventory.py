"""Inventory rules, pairing, sidecars, deduplication and verification of collected files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from casework.functions import paths, text
from casework.operators.ordered import first_by
from casework.operators.shape import settled
from casework.plans import targets as T
from casework.plans.catalog import tag_numbers
from casework.plans.ruleindex import RuleIndex


def inside_volume(path: Column) -> Column:
    """Lower-case path below the volume folder (or drive) it starts with."""
    return F.regexp_replace(paths.norm_path(path), "^/?[a-z]:?/", "")


def profile_of(path: Column) -> Column:
    """Lower-case, trimmed profile name of a path under ``Users``; null elsewhere."""
    return text.null_if_empty(text.strip(F.regexp_extract(inside_volume(path), "^users/([^/]+)/", 1)))


def exclude_profiles(df: DataFrame, profile: Column, names: Sequence[str] = T.LOW_VALUE_PROFILES) -> DataFrame:
    return df.where(~F.coalesce(text.ascii_lower(text.strip(profile)).isin(*names), F.lit(False)))


def find_targets(files: DataFrame, rules: Sequence[T.Target], path: str = "os_path") -> DataFrame:
    """Files each collector wants, with the first kind that fits; a file may serve several collectors."""
    df = files.withColumns({"__in": inside_volume(F.col(path)), "__profile": profile_of(F.col(path))})
    df = df.withColumn("__folders", F.split("__in", "/"))
    numbers = RuleIndex([r.regex for r in rules]).hits("__in", "__folders")
    for profiles in {r.skip_profiles for r in rules if r.skip_profiles}:
        without = F.array(*[F.lit(i) for i, r in enumerate(rules) if r.skip_profiles == profiles])
        numbers = F.when(F.coalesce(F.col("__profile").isin(*profiles), F.lit(False)), F.array_except(numbers, without)).otherwise(numbers)
    df = df.withColumn("__fit", numbers)
    collectors = F.array(*[F.lit(r.collector) for r in rules])
    first = F.filter("__fit", lambda i: ~F.exists("__fit", lambda j: (j < i) & (F.get(collectors, j) == F.get(collectors, i))))
    found = tag_numbers(df, first, [{"collector": r.collector, "kind": r.kind} for r in rules])
    return found.select(*files.columns, "collector", "kind")


def powershell_kind(dir_kind: Column, name: Column) -> Column:
    history = text.ascii_lower(name) == "consolehost_history.txt"
    return (
        F.when(dir_kind == "modules_root", "module_support_file")
        .when(dir_kind == "transcript_root", "transcript")
        .when(dir_kind == "power_shell_data_root", F.when(history, "ps_read_line_history").otherwise("power_shell_data_file"))
    )


def powershell_policy(files: DataFrame, path: str = "os_path", size: str = "size", reparse: str = "is_reparse") -> DataFrame:
    """Add ``kind, decision, reason`` for files under user profiles; other files have null decision.

    Under a policy root the checks run in order: reparse point, extension, size.
    """
    df = files.withColumns({"__in": inside_volume(F.col(path)), "__profile": profile_of(F.col(path))})
    df = df.withColumn("__rest", F.regexp_extract("__in", T.USER + "(.*)$", 1)).withColumn(
        "__name", paths.file_name(F.col("__in"))
    )
    rest, name = F.col("__rest"), F.col("__name")
    fixed = F.create_map(*[F.lit(x) for p, k in T.POWERSHELL_FIXED.items() for x in (p.lower(), k)])
    fixed_kind = F.try_element_at(fixed, rest)
    transcript = rest.rlike(r"^documents/powershell_transcript[^/]*\.txt$")
    root = F.coalesce(*[F.when(rest.startswith(p.lower() + "/"), F.lit(k)) for p, k in T.POWERSHELL_ROOTS.items()])
    allowed = F.lit(False)
    for ext in T.POWERSHELL_EXTENSIONS:
        allowed = allowed | name.endswith(ext)
    kind = F.coalesce(fixed_kind, F.when(transcript, F.lit("transcript")), powershell_kind(root, name))
    wanted = kind.isNotNull() & ~F.coalesce(F.col("__profile").isin(*T.LOW_VALUE_PROFILES), F.lit(False))
    too_big = F.col(size) > T.POWERSHELL_MAX_BYTES
    reason = F.when(
        fixed_kind.isNull(),
        F.when(F.col(reparse), "reparse_or_symlink")
        .when(~transcript & ~allowed, "unsupported_extension")
        .when(too_big, f"size_limit_exceeded:{T.POWERSHELL_MAX_BYTES}"),
    )
    df = df.withColumns({"kind": F.when(wanted, kind), "reason": F.when(wanted, reason)})
    decision = F.when(F.col("reason").isNotNull(), "skip").when(F.col("kind").isNotNull(), "collect")
    return df.select(*files.columns, "kind", decision.alias("decision"), "reason")


def prefetch_kind(name: Column) -> Column:
    n = text.ascii_lower(name)
    return (
        F.when(n == "layout.ini", "layout_ini")
        .when(n.startswith("ag") & n.endswith(".db"), "superfetch_database")
        .when(n == "ntosboot-b00dfaad.pf", "boot_prefetch")
        .when(n.endswith(".pf"), "application_prefetch")
    )


def task_kind(dir_kind: Column, name: Column) -> Column:
    n = text.ascii_lower(name)
    legacy = F.when(n == "schedlgu.txt", "scheduler_log").when(n.endswith(".job"), "legacy_job").otherwise("other")
    return F.when(dir_kind == "legacy_tasks_root", legacy).when(dir_kind == "modern_tasks_root", "modern_definition")


def wbem_kind(path: Column) -> Column:
    """mof or mfl by extension; null for other files."""
    ext = text.ascii_lower(paths.extension(paths.file_name(path)))
    return F.when(ext.isin("mof", "mfl"), ext)


def is_repository_root(name: Column) -> Column:
    return text.ascii_lower(name).startswith("repository")


def link_location(path: Column) -> Column:
    """Which link folder a shortcut lies in; null when in none, or too deep for a flat one."""
    inside = inside_volume(path)
    return F.coalesce(*[F.when(inside.rlike(rx), F.lit(name)) for name, rx in T.LINK_LOCATIONS.items()])


# ---- recycle bin -------------------------------------------------------------------------


def _pair_of(name: Column) -> Column:
    """struct(pair_id, extension) of a ``$I``/``$R`` name; null for other names."""
    rest = F.substring(name, F.lit(3), F.char_length(name))
    pair = name.rlike(r"^\$[IiRr]") & (text.strip(rest) != "")
    has_ext = rest.rlike(r"^.+\.[^.]*$")
    stem = F.when(has_ext, F.regexp_replace(rest, r"\.[^.]*$", "")).otherwise(rest)
    ext = F.when(has_ext, F.concat(F.lit("."), F.substring_index(rest, ".", -1)))
    return F.when(pair, F.struct(stem.alias("pair_id"), ext.alias("extension")))


def classify_recycle(root_kind: Column, relative_path: Column) -> Column:
    """struct(recycle_sid, artifact_kind, pair_id, extension) of an item below a recycle-bin root."""
    parts = F.filter(F.split(paths.slashed(relative_path), "/"), lambda p: p != "")
    name = F.try_element_at(parts, F.lit(-1))
    low = text.ascii_lower(name)
    own = _pair_of(name)
    parents = F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    ancestor = F.get(F.filter(F.transform(parents, _pair_of), lambda p: p.isNotNull()), F.lit(0))
    dot_ext = F.concat(F.lit("."), paths.extension(name))
    first = F.get(parts, F.lit(0))
    sid = F.when(F.upper(text.strip(first)).startswith("S-"), first)
    kind = (
        F.when(low == "desktop.ini", "desktop_ini")
        .when(low == "info2", "info2")
        .when(own.isNotNull(), F.when(F.substring(low, 2, 1) == "i", "metadata_i").otherwise("payload_r"))
        .when(ancestor.isNotNull(), "recycled_directory_member")
        .when(F.size(parts) == 1, "root_file")
        .when(root_kind == "legacy", "legacy_renamed")
        .otherwise("other")
    )
    paired = kind.isin("metadata_i", "payload_r")
    pair_id = F.when(paired, own["pair_id"]).when(kind == "recycled_directory_member", ancestor["pair_id"])
    extension = F.when(paired, own["extension"]).when(kind != "info2", dot_ext)
    return F.struct(
        sid.alias("recycle_sid"), kind.alias("artifact_kind"), pair_id.alias("pair_id"), extension.alias("extension")
    )


def pair_recycle(items: DataFrame, order: str = "seq") -> DataFrame:
    """One row per (case, sid, pair): its metadata file, payload, member count and state.

    A combinable aggregate rather than a self join: a recycled folder with very many members adds to
    a counter only.
    """
    kind = F.col("artifact_kind")

    def path_of(k: str) -> Column:
        return F.min_by(F.when(kind == k, F.col("os_path")), F.when(kind == k, F.col(order)))

    grouped = settled(items).where(F.col("pair_id").isNotNull()).groupBy("case_id", "recycle_sid", "pair_id").agg(
        path_of("metadata_i").alias("i_path"),
        path_of("payload_r").alias("r_path"),
        F.count_if(kind == "recycled_directory_member").cast("bigint").alias("members"),
    )
    state = (
        F.when(F.col("i_path").isNotNull() & F.col("r_path").isNotNull(), "paired")
        .when(F.col("i_path").isNotNull(), "orphan_i")
        .when(F.col("r_path").isNotNull(), "orphan_r")
        .otherwise("members_only")
    )
    return grouped.withColumn("state", state)


# ---- sidecars ----------------------------------------------------------------------------

# Hive companions by suffix of the hive name, and by file ending anywhere in its folder.
HIVE_SUFFIXES = (".log", ".log1", ".log2")
PARSER_HIVE_SUFFIXES = (".log1", ".log2")
FOLDER_SIDECARS = (".blf", ".regtrans-ms")


def _located(df: DataFrame, path: str) -> DataFrame:
    return df.withColumns(
        {"__dir": text.ascii_lower(paths.parent_dir(F.col(path))), "__name": text.ascii_lower(paths.file_name(F.col(path)))}
    )


def with_sidecars(
    hives: DataFrame, files: DataFrame, suffixes: Sequence[str] = HIVE_SUFFIXES,
    folder_endings: Sequence[str] = FOLDER_SIDECARS, path: str = "os_path",
) -> DataFrame:
    """Rows (case_id, hive_path, sidecar_path, kind): named companions and folder-wide ones.

    Only files that can be a sidecar reach the joins. Named ones meet their hive on the exact name.
    Folder-wide ones attach to the folder's hives; a folder holds at most one hive per hive name and
    spelling, so the fan-out is bounded by the short list of hive names.
    """
    h = _located(hives.select("case_id", F.col(path).alias("hive_path")), "hive_path")
    f = _located(files.select("case_id", F.col(path).alias("sidecar_path")), "sidecar_path")
    stem = F.coalesce(
        *[F.when(F.col("__name").endswith(s), F.expr(f"substring(__name, 1, char_length(__name) - {len(s)})")) for s in suffixes]
    )
    named = f.withColumn("__name", stem).where(F.col("__name").isNotNull())
    out = h.join(named, ["case_id", "__dir", "__name"]).select(
        "case_id", "hive_path", "sidecar_path", F.lit("named").alias("kind")
    )
    if folder_endings:
        ending = F.lit(False)
        for e in folder_endings:
            ending = ending | F.col("__name").endswith(e)
        wide = h.select("case_id", "__dir", "hive_path").join(
            f.where(ending).select("case_id", "__dir", "sidecar_path"), ["case_id", "__dir"]
        )
        out = out.unionByName(wide.select("case_id", "hive_path", "sidecar_path", F.lit("folder").alias("kind")))
    return out


def sidecar_lists(hives: DataFrame, files: DataFrame, path: str = "os_path") -> DataFrame:
    """Per hive the transaction logs its parser applies, sorted; at most two names fit, so lists are short."""
    rows = with_sidecars(hives, files, PARSER_HIVE_SUFFIXES, (), path)
    lists = rows.groupBy("case_id", "hive_path").agg(
        F.array_sort(F.collect_list(F.struct(text.ascii_lower(F.col("sidecar_path")).alias("k"), "sidecar_path"))).alias("l")
    )
    return hives.select("case_id", F.col(path).alias("hive_path")).join(lists, ["case_id", "hive_path"], "left").select(
        "case_id", "hive_path",
        F.coalesce(F.transform("l", lambda x: x["sidecar_path"]), F.array().cast("array<string>")).alias("transaction_logs"),
        F.col("l").isNotNull().alias("transaction_logs_found"),
    )


def sqlite_family(bases: DataFrame, files: DataFrame, path: str = "os_path") -> DataFrame:
    """Rows (case_id, base_path, member_path): a database and its ``name-*`` companions, any case.

    Each file name is expanded to the database names it could belong to (its own, and every prefix
    before a dash), which turns the prefix test into an equi-join.
    """
    b = _located(bases.select("case_id", F.col(path).alias("base_path")), "base_path")
    f = _located(files.select("case_id", F.col(path).alias("member_path")), "member_path")
    pieces = F.split("__name", "-")
    owners = F.transform(
        F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "-")
    )
    f = f.select("case_id", "__dir", "member_path", F.explode(owners).alias("__name"))
    return b.join(f, ["case_id", "__dir", "__name"]).select("case_id", "base_path", "member_path")


# ---- dedup, order, limits ----------------------------------------------------------------


class NoVolumeSelected(ValueError):
    """No source volume is left."""


def distinct_first_seen(df: DataFrame, key: Column, seq: str, name: str = "key", check: bool = False) -> DataFrame:
    """Distinct non-null keys in the order they were first met."""
    out = df.select(key.alias(name), F.col(seq).alias("__s")).where(F.col(name).isNotNull())
    out = out.groupBy(name).agg(F.min("__s").alias("first_seq")).orderBy("first_seq", name)
    if check and out.isEmpty():
        raise NoVolumeSelected("select at least one source volume")
    return out


def dedup_paths(entries: DataFrame, path: str, seq: str, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """First entry per archive path; separators are unified, case is not."""
    return first_by(entries, [*keys, paths.slashed(F.col(path))], F.col(seq))


def sort_ci(df: DataFrame, path: str = "os_path") -> DataFrame:
    """Case-insensitive path order; a range-partitioned sort, spelling breaks ties."""
    return df.orderBy(text.ascii_lower(F.col(path)), path)


def limit_groups(df: DataFrame, keys: Sequence[str], group: str, qualifies: Column, n: int) -> DataFrame:
    """Rows of the first ``n`` qualifying groups per ``keys``, in group order.

    Groups are reduced first and a ranked limit is pushed below the shuffle, so a task ranks at most
    ``n`` groups per upstream task.
    """
    good = df.groupBy(*keys, group).agg(F.bool_or(qualifies).alias("__q")).where("__q").select(*keys, group)
    w = Window.partitionBy(*keys).orderBy(group)
    chosen = good.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
    return df.join(chosen, [*keys, group], "left_semi")


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in order, as rows: nothing is gathered into one list."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


# ---- verification ------------------------------------------------------------------------


def verify_hashes(files: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("case_id", "archive_path")) -> DataFrame:
    """Recomputed against recorded SHA-256 per file: ok, mismatch, missing or extra.

    ``files`` has the content, or ``sha256`` already where a member is too large for one cell (``hash_members``).
    Hashing happens before the join, so file contents are never shuffled. A file that is there but gave no hash is
    ``unreadable``, not missing.
    """
    digest = F.col("sha256") if "sha256" in files.columns else F.sha2("content", 256)
    actual = files.select(*keys, digest.alias("actual_sha256"), F.lit(True).alias("__there"))
    recorded = manifest.select(*keys, F.lower("sha256").alias("recorded_sha256"))
    joined = actual.join(recorded, list(keys), "full_outer")
    status = (
        F.when(F.col("__there").isNull(), "missing")
        .when(F.col("actual_sha256").isNull(), "unreadable")
        .when(F.col("recorded_sha256").isNull(), "extra")
        .when(F.col("actual_sha256") == F.col("recorded_sha256"), "ok")
        .otherwise("mismatch")
    )
    return joined.select(*keys, "actual_sha256", "recorded_sha256", status.alias("status"))


def hash_failures(verified: DataFrame, keys: Sequence[str] = ("case_id", "archive_path")) -> DataFrame:
    """Failure rows (operation, error) of a verification."""
    bad = verified.where(F.col("status").isin("mismatch", "missing", "unreadable"))
    return bad.select(
        *keys,
        F.when(F.col("status") == "missing", "copy").otherwise("verify").alias("operation"),
        F.when(F.col("status") == "missing", "file is not in the package").when(
            F.col("status") == "unreadable", "file cannot be read"
        ).otherwise(
            F.concat(F.lit("SHA-256 mismatch: recorded "), "recorded_sha256", F.lit(", found "), "actual_sha256")
        ).alias("error"),
    )


# ---- expected artifacts ------------------------------------------------------------------


def artifact_detail(path: Column) -> Column:
    """What a collected path is, by the first rule that fits."""
    low = text.ascii_lower(path)
    mplog = (
        low.contains("/programdata/microsoft/windows defender/support/")
        & low.endswith(".log")
        & F.substring_index(low, "/", -1).startswith("mplog")
    )
    cases: list[tuple[Column, str]] = []
    for label, fragment, endings in T.ARTIFACT_DETAILS:
        test = low.contains(fragment) if fragment else F.lit(True)
        if endings:
            any_end = F.lit(False)
            for e in endings:
                any_end = any_end | low.endswith(e)
            test = test & any_end
        cases.append((test, label))
        if label == "Legacy Task Scheduler log":
            cases.append((mplog, "Microsoft Protection Log (MPLog) file"))
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return out.otherwise(T.OTHER_DETAIL)


# Short names of paths that do not show their file name.
ARTIFACT_NAMES = {
    "/manifest.json": "Collection manifest",
    "/collection.log": "Collection log",
    "$j.bin": "$J.bin",
    "$j.bin.metadata.json": "$J.bin metadata",
    "$mft.bin": "$MFT.bin",
    "$mft.bin.sha256": "$MFT.bin.sha256",
    "$logfile.bin": "$LogFile.bin",
    "$logfile.bin.sha256": "$LogFile.bin.sha256",
    "indx.rawpack": "INDX.rawpack",
    "indx.rawpack.sha256": "INDX.rawpack.sha256",
    "/lnk_manifest.jsonl": "lnk_manifest.jsonl",
    "/recycle_bin_manifest.jsonl": "recycle_bin_manifest.jsonl",
    "/jump_lists_manifest.jsonl": "jump_lists_manifest.jsonl",
    "/windows/schedlgu.txt": "SchedLgU.txt",
}


def artifact_name(path: Column) -> Column:
    low = text.ascii_lower(path)
    named = F.coalesce(*[F.when(low.endswith(e), F.lit(n)) for e, n in ARTIFACT_NAMES.items()])
    last = text.null_if_empty(F.substring_index(path, "/", -1))
    return F.coalesce(named, last, path)


def artifact_label(path: Column) -> Column:
    return F.struct(artifact_name(path).alias("name"), artifact_detail(path).alias("detail"))


def expected_vs_found(files: DataFrame, path: str = "os_path", keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Per case every expected artifact with the number of files that arrived (0 when none).

    Files are tagged in one pass, each by the few rules its folders lead to, and counted with map-side combine. A case has one
    row of counts, at most one per expectation, from which the fixed list is exploded: no join, no second pass.
    """
    df = files.select(*keys, inside_volume(F.col(path)).alias("__in")).select(*keys, "__in", F.split("__in", "/").alias("__folders"))
    numbers = RuleIndex([rx for _, _, rx in T.EXPECTED]).hits("__in", "__folders")
    # a file that nothing expects still counts its case
    hits = df.select(*keys, F.explode_outer(numbers).alias("__hit")).groupBy(*keys, "__hit").agg(F.count("*").alias("__n"))
    cases = hits.groupBy(*keys).agg(F.collect_list(F.when(F.col("__hit").isNotNull(), F.struct("__hit", "__n"))).alias("__counts"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("title"), F.lit(e).alias("expected")) for i, (t, e, _) in enumerate(T.EXPECTED)])
    every = cases.select(*keys, F.map_from_entries("__counts").alias("__counts"), F.explode(wanted).alias("w"))
    return every.select(*keys, "w.title", "w.expected", F.coalesce(F.try_element_at("__counts", F.col("w.i")), F.lit(0)).cast("bigint").alias("found"))
