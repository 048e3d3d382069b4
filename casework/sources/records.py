"""JSON inputs: collector manifests, result lines, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casework.functions import paths, text

# The parts of a collector manifest that are read.
_FILE = (
    "archive_path string, live_path string, vss_path string, artifact_kind string, file_name string, "
    "size bigint, created_utc string, modified_utc string, accessed_utc string, file_attributes bigint, "
    "source_sha256 string, sha256 string, copy_status string"
)
_FAILURE = "live_path string, vss_path string, archive_path string, operation string, error string"
_SKIPPED = (
    "profile_username string, live_path string, vss_path string, archive_path string, size bigint, reason string"
)
_DIRECTORY = "archive_path string, live_path string, vss_path string, directory_kind string, directory_name string"
def _struct(ddl: str) -> str:
    return "array<struct<" + ",".join(part.strip().replace(" ", ":", 1) for part in ddl.split(",")) + ">>"


MANIFEST_SCHEMA = (
    "metadata_schema string, artifact_type string, artifact_name string, volume string, "
    "collection_status string, collection_start_utc string, collection_end_utc string, "
    "total_files_found bigint, total_files_copied bigint, total_files_skipped bigint, total_files_failed bigint, "
    f"files {_struct(_FILE)}, failures {_struct(_FAILURE)}, skipped_files {_struct(_SKIPPED)}, "
    f"directories {_struct(_DIRECTORY)}, warnings array<string>"
)
MANIFEST_ARRAYS = ("files", "failures", "skipped_files", "directories")


def parse_manifests(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per manifest file, its JSON under ``manifest`` (null when it does not parse)."""
    body = text.utf8_lossy(F.col(content))
    return files.select("case_id", "os_path", F.from_json(body, MANIFEST_SCHEMA).alias("manifest"))


def read_collector_manifests(files: DataFrame, collector: str, part: str = "files") -> DataFrame:
    """Rows of one array of every manifest a collector left at its conventional place."""
    here = files.where(
        F.col("archive_path") == paths.manifest_path(F.col("volume"), F.lit(collector))
    )
    rows = parse_manifests(here).select(
        "case_id", "os_path", F.col("manifest.volume").alias("volume"),
        F.col("manifest.collection_status").alias("collection_status"),
        F.posexplode_outer(f"manifest.{part}").alias("item_no", "__item"),
    )
    return rows.select("case_id", "os_path", "volume", "collection_status", "item_no", "__item.*")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result lines under a declared schema, with their file; a malformed line fails the read."""
    read = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)
    return read.select("*", F.col("_metadata.file_path").alias("result_file"))


def read_raw_results(spark: SparkSession, path: str) -> DataFrame:
    """Result lines of foreign decoders: the text itself plus a VARIANT of it."""
    read = spark.read.option("recursiveFileLookup", "true").text(path)
    return read.where(F.trim("value") != "").select(
        F.col("value").alias("raw"),
        F.try_parse_json("value").alias("record"),
        F.col("_metadata.file_path").alias("result_file"),
    )
