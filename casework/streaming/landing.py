"""Incremental parse of packages that arrive in a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casework.plans.parse import parse_members
from casework.sources.files import MEMBERS_DDL, _list_members

_BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_packages(spark: SparkSession, path: str) -> DataFrame:
    """URIs of packages as they appear; file bodies are not read here."""
    files = spark.readStream.format("binaryFile").schema(_BINARY_FILE).option("pathGlobFilter", "*.zip").load(path)
    return files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("package"))


def parse_landing(spark: SparkSession, path: str, checkpoint: str, out: str) -> None:
    """Parse every package that arrived since the last call.

    Each micro-batch writes below its own number, so a replay replaces what it wrote before.
    """

    def handle(packages: DataFrame, batch: int) -> None:
        target = f"{out}/batch={batch}"
        listing = f"{target}/members"
        packages.mapInArrow(_list_members, MEMBERS_DDL).write.mode("overwrite").parquet(listing)
        parse_members(packages.sparkSession, packages.sparkSession.read.parquet(listing), f"{target}/results", f"{target}/scratch")

    (
        stream_packages(spark, path)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(handle)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
