"""Run bookkeeping: counts, manifests, state folds, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casework.operators.ordered import DEFAULT_WIDTH, Carry, carry_forward, lagged
from casework.plans.catalog import PARSER_FAMILIES


def plan_counts(files: DataFrame, records: DataFrame, keys: Sequence[str] = ("plan_id",), path: str = "os_path") -> DataFrame:
    """Files and records per plan; plans whose files gave nothing stay with 0 records."""
    f = files.groupBy(*keys).agg(F.countDistinct(path).cast("bigint").alias("files"))
    r = records.groupBy(*keys).agg(F.count("*").cast("bigint").alias("records"))
    return f.join(r, list(keys), "left").withColumn("records", F.coalesce("records", F.lit(0).cast("bigint")))


def export_counts(entries: DataFrame) -> DataFrame:
    """Entries whose count of exported records is null instead of zero."""
    return entries.withColumn("exported_records", F.nullif(F.col("exported_records").cast("bigint"), F.lit(0).cast("bigint")))


def export_totals(entries: DataFrame, keys: Sequence[str], sink_active: bool | Column = True) -> DataFrame:
    """Exported records per run: 0 with a sink that got none, null without a sink."""
    active = F.lit(sink_active) if isinstance(sink_active, bool) else F.bool_or(sink_active)
    return entries.groupBy(*keys).agg(
        F.when(active, F.coalesce(F.sum("exported_records"), F.lit(0))).cast("bigint").alias("exported_records")
    )


def collector_status(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status and totals of a collector from its item outcomes (copied, skipped, failed)."""
    def n(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome).cast("bigint")

    return items.groupBy(*keys).agg(
        (n("copied") + n("failed")).alias("found"), n("copied").alias("copied"),
        n("skipped").alias("skipped"), n("failed").alias("failed"),
        F.when(n("failed") == 0, "succeeded").otherwise("completed_with_errors").alias("collection_status"),
    )


def profile_counts(profiles: DataFrame, keys: Sequence[str], skipped: Column) -> DataFrame:
    """Profiles scanned (skipped ones included) and skipped."""
    return profiles.groupBy(*keys).agg(
        F.count("*").cast("bigint").alias("profiles_scanned"), F.count_if(skipped).cast("bigint").alias("profiles_skipped")
    )


NOT_REGISTERED = "parser adapter not registered"
NO_INPUTS = "no matching inputs found in extracted collection"


def manifest_entries(
    plans: DataFrame, outcomes: DataFrame, cases: DataFrame, registered: Sequence[str] | None = None,
    selection: bool = False,
) -> DataFrame:
    """Entries of every case's run manifest.

    ``plans`` are (case_id, family, collection, artifact, plan_id); ``outcomes`` are (case_id,
    plan_id, error, exported_records). Families without adapter or without inputs give one skipped
    entry, left out while a selection is active. The fixed family list is exploded per case.
    """
    registered = set(PARSER_FAMILIES if registered is None else registered)
    families = F.array(
        *[
            F.struct(F.lit(f).alias("family"), F.lit(c).alias("collection"), F.lit(f in registered).alias("known"))
            for f, c in PARSER_FAMILIES.items()
        ]
    )
    every = cases.select("case_id", F.explode(families).alias("x")).select("case_id", "x.*")
    done = plans.select("case_id", "family", "artifact", "plan_id").join(outcomes, ["case_id", "plan_id"], "left")
    joined = every.join(done, ["case_id", "family"], "left")
    planned = F.col("known") & F.col("plan_id").isNotNull()
    entries = joined.select(
        "case_id",
        F.col("family").alias("parser"),
        "collection",
        F.when(planned, F.col("artifact")).otherwise("").alias("artifact"),
        F.when(~planned, "skipped").when(F.col("error").isNotNull(), "error").otherwise("ok").alias("status"),
        F.when(~F.col("known"), NOT_REGISTERED).when(~planned, NO_INPUTS).otherwise(F.col("error")).alias("error"),
        F.when(planned & F.col("error").isNull(), F.nullif(F.col("exported_records"), F.lit(0).cast("bigint"))).alias("exported_records"),
    )
    # several plans of an unregistered family would repeat its one entry
    entries = entries.where(F.col("status") != "skipped").unionByName(
        entries.where(F.col("status") == "skipped").distinct()
    )
    return entries.where(F.col("status") != "skipped") if selection else entries


def counter_rate(
    samples: DataFrame, keys: Sequence[str], at: str, counter: str, seconds: str, volume: str = "volume",
    target: str | None = None, width: int | None = DEFAULT_WIDTH,
) -> DataFrame:
    """Bytes per second at each sample, over all volumes or one.

    A volume counts only where it also has the previous sample; a counter that went back counts 0.
    ``at`` numbers samples 0, 1, 2, ... and ``seconds`` is their time.
    """
    rows = samples if target is None else samples.where(F.col(volume) == target)
    prev = lagged(
        rows, [*keys, volume], at,
        {"__at": F.col(at), "__counter": F.col(counter), "__seconds": F.col(seconds)}, width,
    )
    matched = prev.where(F.col("__at") == F.col(at) - 1)
    per = matched.groupBy(*keys, at).agg(
        F.sum(F.greatest(F.col(counter) - F.col("__counter"), F.lit(0))).alias("delta"),
        F.max(F.col(seconds) - F.col("__seconds")).alias("elapsed"),
    )
    base = samples.select(*keys, at).distinct()
    return base.join(per, [*keys, at], "left").select(
        *keys, at, F.when(F.col("elapsed") > 0, F.col("delta") / F.col("elapsed")).alias("bytes_per_second")
    )


def busy_fraction(
    samples: DataFrame, keys: Sequence[str], at: str, idle: str, kernel: str, user: str, width: int | None = DEFAULT_WIDTH
) -> DataFrame:
    """Share of non-idle time since the previous sample, within [0, 1]; null when no time passed."""
    total = F.col(kernel) + F.col(user)
    prev = lagged(samples, keys, at, {"__total": total, "__idle": F.col(idle)}, width)
    delta = F.greatest(total - F.col("__total"), F.lit(0))
    idle_delta = F.greatest(F.col(idle) - F.col("__idle"), F.lit(0))
    busy = F.greatest(delta - idle_delta, F.lit(0)) / delta
    return prev.select(
        *keys, at, F.when(F.col("__total").isNotNull() & (delta > 0), F.least(busy, F.lit(1.0))).alias("busy")
    )


def progress(
    events: DataFrame, keys: Sequence[str], order: str, seconds: str, total: str, finished: Column,
    width: int | None = DEFAULT_WIDTH,
) -> DataFrame:
    """Completed plans, share, rate and remaining time at every event of a run.

    ``seconds`` is the elapsed time of the event, ``total`` the number of plans of its run.
    """
    done = carry_forward(
        events, keys, order, {"completed": Carry("sum", F.when(finished, 1).otherwise(0), inclusive=True)}, width
    )
    c, n, s = F.col("completed"), F.col(total), F.col(seconds)
    rated = (c > 0) & (s > 0)
    return done.select(
        *keys, order,
        c.cast("bigint").alias("completed"),
        F.when(n == 0, F.lit(0.0)).otherwise(F.least(c / n, F.lit(1.0))).alias("progress"),
        F.when(rated, c / s).alias("rate"),
        F.when(rated & (n > 0), F.greatest(n - c, F.lit(0)) * s / c).alias("remaining"),
    )


# How a plan's outcome is shown.
STATUS_LABELS = {"ok": "Complete", "error": "Failed", "skipped": "Skipped"}


OTHER_STATUS = "Finished"


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, F.lower(status)), F.lit(OTHER_STATUS))


def plan_marks(events: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Latest positions per (run, plan) that decide plan state; run-level events have a null plan.

    Every mark is a maximum, so marks of parts of an event log merge by taking maxima again: the same
    expression serves a batch, a streaming aggregation and the union of its updates.
    """
    kind, pos = F.col("type"), F.col(seq)
    shown = F.when(kind == "plan_started", F.lit("Running")).when(kind == "plan_finished", status_label(F.col("status")))
    plan = F.when(F.col("parser").isNotNull(), F.concat_ws("::", "parser", "artifact"))
    return events.groupBy(F.col(run).alias("run_id"), plan.alias("plan_id")).agg(
        F.max(F.when(shown.isNotNull(), F.struct(pos.alias("pos"), shown.alias("status")))).alias("last"),
        F.max(F.when(kind == "plan_started", pos)).alias("started"),
        F.max(F.when(kind == "plan_finished", pos)).alias("finished"),
        F.max(F.when(kind == "completed", pos)).alias("completed"),
    )


def merge_marks(marks: DataFrame) -> DataFrame:
    return marks.groupBy("run_id", "plan_id").agg(
        *[F.max(c).alias(c) for c in ("last", "started", "finished", "completed")]
    )


def state_from_marks(marks: DataFrame) -> DataFrame:
    """Status and activity per plan. Starting a plan deactivates the run's others, completion all."""
    per_run = marks.groupBy("run_id").agg(F.max("started").alias("__last"), F.max("completed").alias("__done"))
    active = (
        (F.col("started") == F.col("__last"))
        & (F.col("started") > F.coalesce("finished", F.lit(-1)))
        & (F.col("started") > F.coalesce("__done", F.lit(-1)))
    )
    plans = marks.where(F.col("plan_id").isNotNull())
    return plans.join(per_run, "run_id").select(
        "run_id", "plan_id",
        F.coalesce("last.status", F.lit("Queued")).alias("status"),
        F.coalesce(active, F.lit(False)).alias("active"),
    )


def fold_plan_state(events: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Final status and activity of every plan of every run.

    Events are plan_started, plan_finished (with status) and completed. Marks combine before the
    shuffle, so a run with very many events never sits in one task.
    """
    return state_from_marks(plan_marks(events, run, seq))


def collector_progress(
    events: DataFrame, keys: Sequence[str], order: str, total: Column, width: int | None = DEFAULT_WIDTH
) -> DataFrame:
    """Share done of a collector at each of its events: finished jobs plus the running one's part."""
    done = carry_forward(
        events, keys, order,
        {"__done": Carry("sum", F.when(F.col("type") == "collector_finished", 1).otherwise(0), inclusive=True)}, width,
    )
    part = F.when(
        F.col("type").isin("collector_started", "collector_progress"),
        F.least(F.greatest(F.col("progress_value"), F.lit(0.0)), F.lit(1.0)),
    ).otherwise(0.0)
    value = F.when(total == 0, F.lit(0.0)).otherwise(F.least((F.col("__done") + part) / total, F.lit(1.0)))
    return done.select(*keys, order, F.col("__done").cast("bigint").alias("completed_jobs"), value.alias("progress"))


def union_outputs(outputs: Sequence[DataFrame]) -> DataFrame:
    """All outputs of a plan appended; a column missing in one is null there."""
    result = outputs[0]
    for other in outputs[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


#: What a line and a plan must agree on, as far as both tables have it.
PROVENANCE = ("case_id", "package")


def _named_results(results: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Lines and plans with the ``<output_name>.jsonl`` file or folder that binds them, and the columns to join by."""
    by = [c for c in PROVENANCE if c in results.columns and c in plans.columns]
    named = results.withColumn("output_name", F.regexp_extract("result_file", r"([^/=]+)\.jsonl", 1))
    return named, plans.select(*by, "output_name", "plan_id").distinct(), [*by, "output_name"]


def union_results(results: DataFrame, plans: DataFrame) -> DataFrame:
    """Lines of foreign decoders with the plan they belong to.

    The plan is found by the file or folder a line was read from, in the line's own case and package where both tables have them.
    Lines without a plan are in :func:`unplanned_results`.
    """
    named, bound, by = _named_results(results, plans)
    return named.join(bound, by)


def unplanned_results(results: DataFrame, plans: DataFrame) -> DataFrame:
    """Per source (case, package, file): how many lines belong to no plan; their own table instead of nowhere."""
    named, bound, by = _named_results(results, plans)
    lost = named.join(bound, by, "left_anti")
    return lost.groupBy(*[c for c in PROVENANCE if c in results.columns], "result_file").agg(F.count("*").alias("lines"), F.lit("no plan has this output").alias("error"))
