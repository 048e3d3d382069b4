"""A versioned snapshot and the batches after it: what a stream has folded so far, at the cost of one read of each.

Micro-batches write what they add as deltas, each into its own folder. ``fold`` merges a snapshot with the deltas behind it
into the next snapshot and then publishes it by writing one small pointer file; a reader takes the pointer, that snapshot and the deltas
it does not hold yet. Merging is associative, so no state is kept in the stream itself, and a batch that is replayed
replaces its delta.

Groups that have ended and were left alone for ``settle_after`` folds move to a cold part that later folds do not touch. An event
that comes for such a group after all is not lost: it is a delta like any other, and is merged with the group's cold rows.

Defined cases: without a pointer all deltas are read; without deltas and pointer there are no rows; a fold with nothing new
publishes nothing; one that fails before its pointer is written leaves the snapshot before it in force.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from casework.sources.files import located

POINTER = "_current"


@dataclass(frozen=True)
class Snapshots:
    """``merge`` folds rows of equal keys; ``group`` is what ends as a whole, where ``ended`` says so of merged rows."""

    spark: SparkSession
    root: str
    schema: str
    merge: Callable[[DataFrame], DataFrame]
    group: Sequence[str] = ()
    ended: Callable[[DataFrame], DataFrame] | None = None
    settle_after: int | None = None

    def save(self, delta: DataFrame, batch: int) -> None:
        delta.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def pointer(self) -> dict:
        filesystem, path = located(f"{self.root}/{POINTER}")
        if filesystem.get_file_info(path).type == pafs.FileType.NotFound:
            return {"version": -1, "folds": 0, "hot": None, "cold": []}
        with filesystem.open_input_file(path) as handle:
            return json.loads(handle.read())

    def _publish(self, pointer: dict) -> None:
        filesystem, path = located(f"{self.root}/{POINTER}")
        name = f"{path}.{uuid.uuid4().hex}"
        with filesystem.open_output_stream(name) as out:
            out.write(json.dumps(pointer).encode())
        filesystem.move(name, path)

    def batches(self, after: int = -1) -> list[int]:
        """Numbers of the deltas behind a version."""
        filesystem, path = located(self.root)
        found = filesystem.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        numbers = [int(f.base_name[6:]) for f in found if f.base_name.startswith("batch=") and f.base_name[6:].isdigit()]
        return sorted(n for n in numbers if n > after)

    def _read(self, names: Sequence[str], schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.root}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def _live(self, pointer: dict) -> DataFrame:
        """Merged rows of the hot part and the deltas behind it, with the fold that last changed their group."""
        hot = self._read([pointer["hot"]] if pointer["hot"] else [], f"{self.schema}, touched bigint")
        deltas = self._read([f"batch={n}" for n in self.batches(pointer["version"])], self.schema)
        rows = hot.drop("touched").unionByName(deltas)
        if not self.group:
            return self.merge(rows).withColumn("touched", F.lit(0).cast("bigint"))
        cold = self._read(pointer["cold"], self.schema)
        rows = rows.unionByName(cold.join(deltas.select(*self.group).distinct(), list(self.group), "left_semi"))
        touched = hot.select(*self.group, "touched").unionByName(deltas.select(*self.group).withColumn("touched", F.lit(pointer["folds"] + 1).cast("bigint")))
        return self.merge(rows).join(touched.groupBy(*self.group).agg(F.max("touched").alias("touched")), list(self.group))

    def fold(self) -> int:
        """Publishes the next snapshot; returns how many rows stay hot."""
        old = self.pointer()
        new = self.batches(old["version"])
        if not new:
            return self._read([old["hot"]] if old["hot"] else [], self.schema).count()
        version, folds, name = new[-1], old["folds"] + 1, f"snapshot-{new[-1]}-{uuid.uuid4().hex[:8]}"
        merged, cold = self._live(old), list(old["cold"])
        merged.write.parquet(f"{self.root}/{name}/merged")
        merged = self.spark.read.schema(f"{self.schema}, touched bigint").parquet(f"{self.root}/{name}/merged")
        hot = f"{name}/merged"
        if self.ended is not None and self.settle_after is not None:
            over = self.ended(merged.where(F.col("touched") <= folds - self.settle_after)).select(*self.group).distinct()
            merged.join(over, list(self.group), "left_semi").drop("touched").write.parquet(f"{self.root}/{name}/cold")
            merged.join(over, list(self.group), "left_anti").write.parquet(f"{self.root}/{name}/hot")
            cold, hot = [*cold, f"{name}/cold"], f"{name}/hot"
        self._publish({"version": version, "folds": folds, "hot": hot, "cold": cold})
        return self._read([hot], self.schema).count()

    def rows(self) -> DataFrame:
        """All merged rows: live ones, and cold ones of groups that are not live again."""
        pointer = self.pointer()
        live = self._live(pointer).drop("touched")
        if not pointer["cold"]:
            return live
        # a group that settled more than once has the same or older rows in earlier cold parts: merging keeps the newest
        asleep = self._read(pointer["cold"], self.schema).join(live.select(*self.group).distinct(), list(self.group), "left_anti")
        return live.unionByName(self.merge(asleep))
