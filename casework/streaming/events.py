"""Event logs as streams: tailing, plan state, collector progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casework.operators.runs import merge_marks, plan_marks, state_from_marks
from casework.streaming.snapshots import Snapshots

# Fields of parse and collection events; each event type uses some of them.
EVENT_SCHEMA = (
    "type string, run_id string, seq bigint, parser string, artifact string, index bigint, total bigint, "
    "status string, exported_records bigint, error string, collection_title string, volume string, "
    "progress_value double, detail string, progress_text string, artifact_paths array<string>"
)


def stream_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """New event lines below ``path``; what was already delivered is remembered by the checkpoint."""
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def tail_events(spark: SparkSession, path: str, checkpoint: str, out: str, schema: str = EVENT_SCHEMA) -> None:
    """Append the events that arrived since the last call to the table at ``out``."""
    (
        stream_events(spark, path, schema)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


MARKS = "run_id string, plan_id string, last struct<pos:bigint,status:string>, started bigint, finished bigint, completed bigint"
TOTALS = "run_id string, collection_title string, completed_jobs bigint, last_part struct<seq:bigint,value:double>, last_finish bigint"
FOLD_EVERY, SETTLE_AFTER = 16, 2


def plan_snapshots(spark: SparkSession, out: str, settle_after: int | None = SETTLE_AFTER) -> Snapshots:
    """Marks are maxima; a run whose completion is marked and that had no event for ``settle_after`` folds goes cold."""
    completed = lambda marks: marks.where(F.col("completed").isNotNull())
    return Snapshots(spark, out, MARKS, merge_marks, ("run_id",), completed, settle_after)


def merge_totals(totals: DataFrame) -> DataFrame:
    return totals.groupBy("run_id", "collection_title").agg(
        F.sum("completed_jobs").alias("completed_jobs"), F.max("last_part").alias("last_part"), F.max("last_finish").alias("last_finish")
    )


def total_snapshots(spark: SparkSession, out: str) -> Snapshots:
    return Snapshots(spark, out, TOTALS, merge_totals)


def _fold_stream(events: DataFrame, checkpoint: str, snapshots: Snapshots, part, fold_every: int) -> None:  # noqa: ANN001
    """Every micro-batch adds its own part, and every ``fold_every``-th folds; the stream itself holds no state."""

    def save(batch: DataFrame, number: int) -> None:
        snapshots.save(part(batch), number)
        if (number + 1) % fold_every == 0:
            snapshots.fold()

    events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start().awaitTermination()


def fold_plan_state_stream(events: DataFrame, checkpoint: str, out: str, fold_every: int = FOLD_EVERY, settle_after: int | None = SETTLE_AFTER) -> None:
    """Keep plan marks of an event stream up to date at ``out``.

    Each batch combines its own marks map-side and overwrites only its own folder, so a replayed batch leaves no duplicate.
    """
    _fold_stream(events, checkpoint, plan_snapshots(events.sparkSession, out, settle_after), plan_marks, fold_every)


def read_plan_state(spark: SparkSession, out: str) -> DataFrame:
    """Current plan state from the snapshot and the batches behind it."""
    return state_from_marks(plan_snapshots(spark, out).rows())


def collector_totals(events: DataFrame) -> DataFrame:
    """Finished jobs and latest job share per collector, of the events of one batch."""
    position = F.struct("seq", F.least(F.greatest(F.coalesce("progress_value", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("value"))
    running = F.col("type").isin("collector_started", "collector_progress")
    finished = F.col("type") == "collector_finished"
    return events.where(F.col("collection_title").isNotNull()).groupBy("run_id", "collection_title").agg(
        F.count_if(finished).alias("completed_jobs"),
        F.max(F.when(running, position)).alias("last_part"),
        F.max(F.when(finished, F.col("seq"))).alias("last_finish"),
    )


def collector_totals_stream(events: DataFrame, checkpoint: str, out: str, fold_every: int = FOLD_EVERY) -> None:
    """Finished jobs and latest job share per collector, updated as events arrive."""
    _fold_stream(events, checkpoint, total_snapshots(events.sparkSession, out), collector_totals, fold_every)


def read_collector_progress(spark: SparkSession, out: str, total_jobs: int) -> DataFrame:
    """Share done per collector: finished jobs plus the part of a job still running, over all jobs."""
    latest = total_snapshots(spark, out).rows()
    active = F.col("last_part.seq") > F.coalesce("last_finish", F.lit(-1))
    part = F.when(active, F.col("last_part.value")).otherwise(0.0)
    share = F.least((F.col("completed_jobs") + part) / total_jobs, F.lit(1.0)) if total_jobs else F.lit(0.0)
    return latest.select("run_id", "collection_title", F.col("completed_jobs").cast("bigint").alias("completed_jobs"), share.alias("progress"))
