"""Snapshots of streams against folding all events at once."""

import random

import pytest

from casework.operators.runs import fold_plan_state
from casework.streaming import events as ev

EVENTS = "type string, run_id string, seq bigint, parser string, artifact string, status string, collection_title string, progress_value double"


def log(runs=6, seed=1):
    r, rows, seq = random.Random(seed), [], 0
    for k in range(runs):
        for p in range(4):
            for kind in ("plan_started", "plan_finished"):
                seq += 1
                rows.append((kind, f"r{k}", seq, "fam", f"p{p}", r.choice(["ok", "error", "skipped"]), f"c{p % 2}", None))
                rows.append((r.choice(["collector_started", "collector_finished", "collector_progress"]), f"r{k}", seq, None, None, None, f"c{p % 2}", r.random()))
        seq += 1
        rows.append(("completed", f"r{k}", seq, None, None, None, None, None))
    return rows


def df(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def state(rows):
    return sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("settle_after", [None, 0, 1, 3])
def test_snapshot_and_deltas_equal_one_fold(spark, tmp_path, settle_after):
    rows = log()
    order = rows[:]
    if settle_after != 0:
        random.Random(3).shuffle(order)
    snaps, seen, hot = ev.plan_snapshots(spark, str(tmp_path / "s"), settle_after), [], []
    for n in range(6):
        batch = order[n * len(order) // 6 : (n + 1) * len(order) // 6]
        seen += batch
        snaps.save(ev.plan_marks(df(spark, batch)), n)
        if n in (1, 2, 4):
            hot.append(snaps.fold())
        assert state(ev.read_plan_state(spark, str(tmp_path / "s"))) == state(fold_plan_state(df(spark, seen)))
    assert snaps.fold() <= 30 and snaps.batches(snaps.pointer()["version"]) == []


def test_state_falls_when_runs_end_and_late_events_still_count(spark, tmp_path):
    rows, out = log(), str(tmp_path / "s")
    snaps = ev.plan_snapshots(spark, out, settle_after=1)
    snaps.save(ev.plan_marks(df(spark, rows)), 0)
    assert snaps.fold() == 30  # four plans and the run itself, six times
    more = [("plan_started", "new", 999, "fam", "p0", None, None, None)]
    snaps.save(ev.plan_marks(df(spark, more)), 1)
    assert snaps.fold() == 1
    late = [("plan_started", "r2", 5000, "fam", "p1", None, None, None)]
    snaps.save(ev.plan_marks(df(spark, late)), 2)
    want = state(fold_plan_state(df(spark, rows + more + late)))
    assert state(ev.read_plan_state(spark, out)) == want
    assert snaps.fold() == 6  # the run is back with all its marks
    snaps.save(ev.plan_marks(df(spark, more)), 3)
    assert snaps.fold() == 1 and state(ev.read_plan_state(spark, out)) == want


def test_a_replayed_batch_counts_once(spark, tmp_path):
    rows, out = log(3), str(tmp_path / "s")
    snaps = ev.total_snapshots(spark, out)
    half = len(rows) // 2
    whole = state(ev.merge_totals(ev.collector_totals(df(spark, rows))))
    snaps.save(ev.collector_totals(df(spark, rows[:half])), 0)
    snaps.save(ev.collector_totals(df(spark, rows[half:])), 1)
    snaps.save(ev.collector_totals(df(spark, rows[half:])), 1)
    assert state(snaps.rows()) == whole
    snaps.fold()
    snaps.save(ev.collector_totals(df(spark, rows[half:])), 1)  # replayed after its fold was published
    assert state(snaps.rows()) == whole and snaps.batches(snaps.pointer()["version"]) == []


def test_nothing_yet(spark, tmp_path):
    snaps = ev.plan_snapshots(spark, str(tmp_path / "none"))
    assert snaps.fold() == 0 and snaps.rows().count() == 0 and snaps.pointer()["version"] == -1
