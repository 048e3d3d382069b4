"""End-to-end parse of packages: list, detect, select, decode, write results and manifests."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casework.operators import runs, usn
from casework.operators.detect import build_plans, detect, select_plans
from casework.plans import decoders
from casework.plans.catalog import DETECTION_RULES
from casework.sinks.results import write_manifest
from casework.sources.files import MEMBER_ERRORS, _Packages, list_packages, located, read_member_chunks, read_member_heads, spread, together

USN_ARTIFACT = "Windows.NTFS.UsnJournal.RawStream"
CELL = 1 << 30
TEXT_CELL = 64 << 20  # of members made of lines: larger ones are read by several tasks


def package_files(members: DataFrame) -> DataFrame:
    """Member listing in the shape of ``files`` without content."""
    return members.where(F.col("status") == "ok").select(
        F.regexp_replace(F.substring_index("package", "/", -1), r"(?i)\.zip$", "").alias("case_id"),
        F.col("archive_path").alias("os_path"),
        "*",
    )


def without_wrong_magic(found: DataFrame) -> DataFrame:
    """Detected members (with package and member_no) less those that a rule binds by first bytes they do not have.

    Only members of such rules are opened, and only their first bytes inflated.
    """
    magic = {(r.family, r.artifact): r.magic for r in DETECTION_RULES if r.magic}
    if not magic:
        return found
    bound = F.lit(None).cast("string")
    for (family, artifact), head in magic.items():
        bound = F.when((F.col("family") == family) & (F.col("artifact") == artifact), head).otherwise(bound)
    longest = max(len(m) // 2 for m in magic.values())
    asked = found.where(bound.isNotNull()).select("package", "member_no", "status").distinct()
    heads = read_member_heads(asked, longest)
    tested = found.where(bound.isNotNull()).join(heads, ["package", "member_no"])
    return found.where(bound.isNull()).unionByName(tested.where(F.startswith(F.hex("head"), bound)).select(*found.columns))


def inspect_packages(spark: SparkSession, path: str) -> DataFrame:
    """Plans a parse of the packages would run by their names; reads central directories only, so first bytes are not tested."""
    return build_plans(detect(package_files(list_packages(spark, path))))


def case_of(package: Column) -> Column:
    return F.regexp_replace(F.substring_index(package, "/", -1), r"(?i)\.zip$", "")


def contents(members: DataFrame, cell: int = CELL) -> DataFrame:
    """Content of listed members, one row each, and ``error``: null, or why a member has no content.

    A member that is larger than one cell may be is such an error too, so that its plan says so.
    """
    fits = read_member_chunks(members.where(F.col("size") <= cell), cell)
    large = members.where((F.col("status") == "ok") & (F.col("size") > cell)).withColumns(
        {"status": F.concat(F.lit("larger than one cell: "), F.col("size").cast("string"), F.lit(" bytes")), "content": F.lit(None).cast("binary")}
    )
    columns = ["package", "archive_path", "size", "status", "content"]
    return fits.select(*columns).unionByName(large.select(*columns)).select(
        case_of(F.col("package")).alias("case_id"),
        F.col("archive_path").alias("os_path"),
        "archive_path", "size", "content", F.when(F.col("status") != "ok", F.col("status")).alias("error"),
    )


def package_problems(members: DataFrame) -> DataFrame:
    """(case_id, os_path, error) of packages that cannot be listed and members that would leave their root."""
    why = F.when(F.col("status") == "rejected", "member leaves its root").otherwise(F.col("status"))
    return members.where(F.col("status") != "ok").select(
        case_of(F.col("package")).alias("case_id"), F.coalesce("member", F.lit("")).alias("os_path"), why.alias("error")
    )


def extract_members(members: DataFrame, folder: str) -> DataFrame:
    """Write members below a shared folder; returns (case_id, archive_path, size, os_path, error) of the copies.

    Needed where a decoder reads byte ranges, which a compressed member cannot serve.
    """
    schema = pa.schema([("case_id", pa.string()), ("archive_path", pa.string()), ("size", pa.int64()), ("os_path", pa.string()), ("error", pa.string())])

    def copy(batches):
        packages = _Packages()
        target_fs, base = located(folder)
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    case = re.sub(r"(?i)\.zip$", "", row["package"].rsplit("/", 1)[-1])
                    target, problem = f"{base}/{case}/{row['archive_path']}", None
                    target_fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    try:  # a retried task rewrites the same file
                        archive, info = packages.member(row)
                        with archive.open(info) as member, target_fs.open_output_stream(target) as out:
                            while data := member.read(1 << 20):
                                out.write(data)
                    except MEMBER_ERRORS as error:
                        problem = f"unreadable: {error}"
                    yield pa.RecordBatch.from_pylist(
                        [{"case_id": case, "archive_path": row["archive_path"], "size": row["size"], "os_path": target, "error": problem}],
                        schema=schema,
                    )
        finally:
            packages.close()

    dealt = spread(members, "package", together()).sortWithinPartitions("package", "member_no")
    return dealt.mapInArrow(copy, "case_id string, archive_path string, size bigint, os_path string, error string")


def large_text(spark: SparkSession, members: DataFrame, artifact: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows of line-based members beyond one cell, and (case_id, os_path, error) of them all.

    A compressed member cannot be read from its middle, so it is copied to the shared folder first.
    """
    extract_members(members, f"{folder}/files").write.mode("overwrite").parquet(f"{folder}/listing")
    copies = spark.read.parquet(f"{folder}/listing")
    named = copies.select("case_id", F.col("archive_path").alias("os_path"), F.col("os_path").alias("path"), "size", "error")
    rows, problems = decoders.decode_text(named.where(F.col("error").isNull()).drop("error"), artifact)
    known = named.join(problems.withColumnRenamed("error", "unread"), ["case_id", "os_path"], "left")
    return rows, known.select("case_id", "os_path", F.coalesce("error", "unread").alias("error"))


def parse_members(
    spark: SparkSession, members: DataFrame, out: str, scratch: str, selection: Sequence[str] | None = None, cell: int = CELL
) -> DataFrame:
    """Decode all detected artifacts of listed members into ``out``; returns the manifest entries.

    The listing is stored once. Members are classified from their names; only those a decoder wants are opened, once, into
    ``scratch``. Each artifact is written on its own. A member that cannot be read, or not decoded, goes to
    ``out``/diagnostics; its plan gets an error entry in its own case only, and all other rows stay. A package that cannot
    be listed, or holds members that would leave their root, has an error entry of its own. A member beyond ``cell`` counts as
    unreadable, unless its artifact is made of lines: those beyond TEXT_CELL already go through the line source.
    """
    members.write.mode("overwrite").parquet(f"{scratch}/members")
    members = spark.read.parquet(f"{scratch}/members")
    listed = package_files(members)
    without_wrong_magic(detect(listed)).write.mode("overwrite").parquet(f"{scratch}/found")
    found = spark.read.parquet(f"{scratch}/found")
    plans = build_plans(found)
    if selection is not None:
        plans = select_plans(plans, selection, check=True)
        found = found.where(F.concat_ws("::", "family", "artifact").isin(*selection))
    plans.write.mode("overwrite").parquet(f"{scratch}/plans")
    plans = spark.read.parquet(f"{scratch}/plans")
    outcomes = []
    present = {(r.family, r.artifact) for r in plans.select("family", "artifact").distinct().collect()}
    for family, artifact in sorted(present):
        plan = F.lit(f"{family}::{artifact}").alias("plan_id")
        mine = found.where((F.col("family") == family) & (F.col("artifact") == artifact))
        try:
            if artifact == USN_ARTIFACT:
                extract_members(mine, f"{scratch}/streams").write.mode("overwrite").parquet(f"{scratch}/extracted")
                opened = spark.read.parquet(f"{scratch}/extracted")
                beside = usn.sidecar_paths(opened).select("case_id", "archive_path").distinct()
                sidecars = contents(listed.join(beside, ["case_id", "archive_path"], "left_semi"), cell)
                rows, problems = usn.parse_usn(sidecars, opened.where(F.col("error").isNull()))
                problems = problems.select("case_id", "os_path", F.col("problem").alias("error"))
            elif artifact in decoders.registered():
                most = min(cell, TEXT_CELL)
                large = mine.where((F.col("size") > most) & F.lit(decoders.has_lines(artifact)))
                contents(mine.where(F.col("size") <= most) if decoders.has_lines(artifact) else mine, cell).write.mode("overwrite").parquet(f"{scratch}/contents/{artifact}")
                opened = spark.read.parquet(f"{scratch}/contents/{artifact}")
                readable = opened.where(F.col("error").isNull()).drop("error")
                rows, problems = decoders.decode(readable, artifact), decoders.problems(readable, artifact)
                opened = opened.select("case_id", "os_path", "error")
                if not large.isEmpty():
                    more, unread = large_text(spark, large, artifact, f"{scratch}/large/{artifact}")
                    rows, opened = rows.unionByName(more), opened.unionByName(unread)
            else:
                continue  # decoded elsewhere; its lines join through union_results
            target = f"{out}/{family}/{artifact}"
            rows.write.mode("overwrite").json(target)
            bad = opened.where(F.col("error").isNotNull()).select("case_id", "os_path", "error")
            bad = bad if problems is None else bad.unionByName(problems)
            bad.write.mode("overwrite").json(f"{out}/diagnostics/{family}/{artifact}")
            unread = opened.groupBy("case_id").agg(F.min("error").alias("error"))
            counts = spark.read.schema("case_id string").json(target).groupBy("case_id").agg(F.count("*").alias("n"))
            done = unread.join(counts, "case_id", "left")
            # kept: the entries are read more than once, the rows that were written only here
            done.select("case_id", plan, "error", F.col("n").alias("exported_records")).write.mode("overwrite").parquet(f"{scratch}/outcomes/{family}/{artifact}")
            outcomes.append(spark.read.parquet(f"{scratch}/outcomes/{family}/{artifact}"))
        except Exception as error:  # noqa: BLE001 - one failing artifact must not end the run
            cases = mine.select("case_id").distinct()
            outcomes.append(cases.select("case_id", plan, F.lit(str(error)).alias("error"), F.lit(None).cast("bigint").alias("exported_records")))
    done = runs.union_outputs(outcomes) if outcomes else spark.createDataFrame(
        [], "case_id string, plan_id string, error string, exported_records bigint"
    )
    cases = members.select(case_of(F.col("package")).alias("case_id")).distinct()
    entries = runs.manifest_entries(plans, done, cases, selection=selection is not None)
    package = package_problems(members).select(
        "case_id", F.lit("package").alias("parser"), F.lit("").alias("collection"), F.col("os_path").alias("artifact"),
        F.lit("error").alias("status"), "error", F.lit(None).cast("bigint").alias("exported_records"),
    )
    # rows written are no export; that count stays open until an export has run
    decoded = (F.col("status") != "skipped") & (F.col("parser") != "package")
    under = lambda *parts: F.when(decoded, F.concat_ws("/", *[F.lit(x) if isinstance(x, str) else x for x in parts]))
    entries = entries.unionByName(package).withColumnRenamed("exported_records", "records").withColumns({
        "args": F.create_map().cast("map<string,string>"),
        "output_path": under(out, F.col("parser"), F.col("artifact")),
        "log_path": under(out, "diagnostics", F.col("parser"), F.col("artifact")),
        "exported_records": F.lit(None).cast("bigint"),
    })
    write_manifest(entries, f"{out}/manifests")
    return entries


def parse_packages(
    spark: SparkSession, path: str, out: str, scratch: str, selection: Sequence[str] | None = None
) -> DataFrame:
    return parse_members(spark, list_packages(spark, path), out, scratch, selection)


