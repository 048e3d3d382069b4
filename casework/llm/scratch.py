"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local session (tests) may leave that setting out."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str, group_bytes: int | None = None) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back: lineage ends there.

    Writers and readers hold a row group at a time, which has 100 rows at least unless ``group_bytes`` is given; rows of several MB need it.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.option("parquet.block.size", str(group_bytes)).option("parquet.page.size.row.check.min", "1")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """A name for each wanted one that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    longest = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in taken), default=0))
    return [f"{longest}{w}" for w in wanted]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
