import random

import pytest
from pyspark.sql import functions as F

from casework.operators import lines, ordered, ranges
from casework.operators.ordered import Carry, carry_forward, cut_points, first_by, lagged, numbered, scan


def rows_of(seed=1, n=400):
    rng = random.Random(seed)
    order = sorted(rng.sample(range(-50, 3000), n))
    # one key holds most rows, another has a null name
    return [(None if i % 11 == 0 else ("hot" if i % 3 else f"k{i % 5}"), o, rng.choice([None, 1, 2, 5])) for i, o in enumerate(order)]


@pytest.mark.parametrize("width", [1, 7, 100, 10**6])
@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_carry_matches_a_sequential_loop(spark, width, partitions):
    rows = rows_of()
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(partitions)
    out = carry_forward(
        df, ["k"], "o",
        {"s": Carry("sum", F.col("v")), "last": Carry("last", F.col("v")), "m": Carry("max", F.col("v")), "inc": Carry("sum", F.col("v"), True)},
        width,
    )
    got = {(r.k, r.o): (r.s, r.last, r.m, r.inc) for r in out.collect()}
    expected, state = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        s, last, m = state.get(k, (0, None, None))
        after = (s + (v or 0), v if v is not None else last, max(x for x in (m, v) if x is not None) if (m, v) != (None, None) else None)
        expected[k, o] = (s, last, m, after[0])
        state[k] = after
    assert got == expected


def test_lag_and_rank(spark):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {(r.k, r.o): r.p for r in lagged(df, ["k"], "o", {"p": F.col("o")}, 13).collect()}
    rank = {(r.k, r.o): r.rn for r in numbered(df, ["k"], "o", width=13).collect()}
    prev, count = {}, {}
    for k, o, _ in rows:
        count[k] = count.get(k, 0) + 1
        assert got[k, o] == prev.get(k) and rank[k, o] == count[k]
        prev[k] = o


def islands(rows, gap):
    """Rows with the row before and the number of the stretch they lie in, by a loop."""
    out, last, island = {}, {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        before = last.get(k)
        island[k] = island.get(k, 0) + (before is None or o - before[0] > gap)
        out[k, o] = (before[0] if before else None, before[1] if before else None, island[k])
        last[k] = (o, v)
    return out


@pytest.mark.parametrize("spacing", [1, 10**9])
@pytest.mark.parametrize("width", [None, 1, 3, 40, 1000])
def test_a_sum_may_depend_on_the_row_before(spark, spacing, width):
    """Lag and islands in one scan, whether positions are dense or 10 ** 9 apart."""
    rows = [(k, o * spacing, v) for k, o, v in rows_of(3)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(5)
    starts = F.when(F.col("po").isNull() | (F.col("o") - F.col("po") > 9 * spacing), 1).otherwise(0)
    out = scan(df, ["k"], "o", {"po": F.col("o"), "pv": F.col("v")}, {"island": Carry("sum", starts, True)}, width)
    assert {(r.k, r.o): (r.po, r.pv, r.island) for r in out.collect()} == islands(rows, 9 * spacing)


@pytest.mark.parametrize("spacing", [1, 10**9, 10**13])
def test_chunks_hold_about_equally_many_rows_whatever_the_gaps(spark, spacing):
    n, width = 40_000, 2_000
    df = spark.range(n).select((F.col("id") * spacing + F.when(F.col("id") > n // 2, 5 * 10**17).otherwise(0)).alias("o"))
    cuts = [o for _, o in cut_points(df, n, F.lit(1).cast("bigint"), "o", width)]
    places = sorted((o - (5 * 10**17 if o > 5 * 10**17 else 0)) // spacing for o in cuts)
    sizes = [b - a for a, b in zip([0, *places], [*places, n])]
    assert len(sizes) == n // width and max(sizes) < 2 * width


def test_a_scan_shuffles_rows_once_and_states_in_addition(spark):
    df = spark.createDataFrame(rows_of(4, 800), "k string, o bigint, v bigint")
    out = scan(df, ["k"], "o", {"p": F.col("v")}, {"n": Carry("sum", F.when(F.col("p").isNull(), 1).otherwise(0), True), "m": Carry("max", F.col("v"))}, 50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hash" in line for line in plan.splitlines()) == 3  # rows, rows of divided sequences, one state per chunk


def test_scan_of_nothing_and_without_keys(spark):
    df = spark.createDataFrame([], "k string, o bigint, v bigint")
    assert numbered(df, ["k"], "o").count() == 0
    one = spark.range(300).select((F.col("id") * 7).alias("o"))
    assert {r.o: r.rn for r in numbered(one, [], "o", width=11).collect()} == {7 * i: i + 1 for i in range(300)}


def test_first_by(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert sorted(tuple(r) for r in first_by(df, ["k"], F.col("o")).collect()) == [("a", 1, "y"), ("b", 3, None)]


@pytest.mark.parametrize("width", [2, 1000])
def test_continuations(spark, width):
    texts = ["  first", " second", "", "head", "\tmore", "   ", " last  ", "tail"]
    df = spark.createDataFrame([("c", "f", i + 1, t) for i, t in enumerate(texts)], "case_id string, os_path string, line_no bigint, line string")
    got = sorted((r.line_no, r.head, r.message, r.raw) for r in lines.merge_continuations(df, width).collect())
    assert got == [
        (1, "  first", "first\nsecond", "  first\n second"), (4, "head", "head\nmore\nlast", "head\n\tmore\n last"), (8, "tail", "tail", "tail"),
    ]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_pending_time_is_consumed_once(spark, width):
    texts = ["a", "#10", "#20", ": 30:0;zsh", "b", "c", "#", "#0", "#40", "", "d"]
    df = spark.createDataFrame([("c", "f", i + 1, t) for i, t in enumerate(texts)], "case_id string, os_path string, line_no bigint, line string")
    got = {r.command: r.timestamp for r in lines.attach_pending_time(df, width).collect()}
    assert got == {
        "a": None, "zsh": "1970-01-01T00:00:30Z", "b": "1970-01-01T00:00:20Z", "c": None, "#": None, "#0": None, "d": "1970-01-01T00:00:40Z",
    }


def test_lines_follow_text_rules(spark):
    data = bytearray(b"a\r\nb\rc\n\nlast\r")
    df = spark.createDataFrame([("c", "f", data), ("c", "empty", bytearray(b"")), ("c", "nl", bytearray(b"\n"))], "case_id string, os_path string, content binary")
    got = sorted((r.os_path, r.line_no, r.line) for r in lines.read_lines(df).collect())
    assert got == [("f", 1, "a"), ("f", 2, "b\rc"), ("f", 3, ""), ("f", 4, "last\r"), ("nl", 1, "")]


def test_split_lines_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = lines.read_split_lines(spark, str(path))
        assert out.rdd.getNumPartitions() >= 1
        assert {r.line_no: r.line for r in out.collect()} == {i + 1: f"line {i}" for i in range(5000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")


def test_tail(spark):
    data = bytearray(b"".join(b"line %d\n" % i for i in range(1000)))
    df = spark.createDataFrame([("c", "f", data), ("c", "short", bytearray(b"x\ny"))], "case_id string, os_path string, content binary")
    got = sorted((r.os_path, r.from_end, r.line) for r in lines.tail_lines(df, 2, 12).collect())
    assert got == [("f", 1, "line 999"), ("short", 1, "y"), ("short", 2, "x")]


def runs_df(spark, runs):
    return spark.createDataFrame([("c", "s", i, *r) for i, r in enumerate(runs)], "case_id string, os_path string, seq bigint, logical_offset bigint, length bigint, sparse boolean, volume_offset bigint")


def windows_df(spark, start, end):
    return spark.createDataFrame([("c", "s", start, end)], "case_id string, os_path string, window_start bigint, window_end bigint")


@pytest.mark.parametrize("width", [1, 100])
def test_coalesce_ranges(spark, width):
    runs = runs_df(spark, [(0, 128, True, None), (128, 64, False, None), (192, 32, False, None), (300, 10, False, None), (310, 0, False, None)])
    got = sorted((r.start, r.length) for r in ranges.coalesce_ranges(runs, windows_df(spark, 128, 400), width=width).collect())
    assert got == [(128, 96), (300, 10)]
    whole = ranges.coalesce_ranges(runs, windows_df(spark, 500, 600), width=width).collect()
    assert [(r.start, r.length) for r in whole] == [(500, 100)]


def test_coalesce_and_runs_exchange_four_times(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 20)
    many = runs_df(spark, [(i * 10 + 5 * (i % 7 == 0), 10, i % 5 == 0, None if i % 3 else i) for i in range(200)])
    for df in (ranges.coalesce_ranges(many, windows_df(spark, 55, 1500)), ranges.build_runs(many)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange hash" in line for line in plan.splitlines()) == 4


def test_ranges_over_many_chunks_equal_a_loop(spark, monkeypatch):
    r = random.Random(6)
    at, runs = 0, []
    for _ in range(300):
        at += r.choice([0, 0, 0, 64])
        runs.append((at, r.choice([0, 32, 64]), r.random() < 0.2, None))
        at += runs[-1][1]
    want, end = [], None
    for o, n, sparse, _ in runs:
        a, b = max(o, 500), min(o + n, 9000)
        if sparse or n == 0 or a >= b:
            continue
        if a == end:
            want[-1][1] += b - a
        else:
            want.append([a, b - a])
        end = b
    for width in (1, 13, None):
        got = ranges.coalesce_ranges(runs_df(spark, runs), windows_df(spark, 500, 9000), width=width).collect()
        assert sorted([x.start, x.length] for x in got) == sorted(want)


@pytest.mark.parametrize("width", [1, 100])
def test_build_runs(spark, width):
    extents = [(0, 10, False, 100), (10, 10, False, 110), (20, 10, False, 500), (30, 10, True, None), (40, 10, True, None), (50, 10, False, None)]
    got = sorted((r.logical_offset, r.volume_offset, r.length, r.sparse) for r in ranges.build_runs(runs_df(spark, extents), width=width).collect())
    assert got == [(0, 100, 20, False), (20, 500, 10, False), (30, None, 20, True), (50, None, 10, False)]


@pytest.mark.parametrize(
    "first,after,base,size,active,parse",
    [
        ("4096", "5000", 0, 8192, (4096, 904), (4096, 5000)), ("0", "8192", 0, 8192, None, (0, 8192)), ("9", "5", 0, 100, None, (0, 100)),
        ("", "50", 0, 100, None, (0, 50)), ("4096", "4200", 4096, 200, None, (0, 104)), ("10", "x", 20, 100, None, (0, 100)),
    ],
)
def test_windows(spark, first, after, base, size, active, parse):
    df = spark.createDataFrame([(first, after, base, size)], "f string, n string, b bigint, s bigint")
    r = df.select(ranges.active_window(F.col("f"), F.col("n"), F.col("s")).alias("a"), ranges.parse_window(F.col("f"), F.col("n"), F.col("b"), F.col("s")).alias("p")).first()
    assert (tuple(r.a) if r.a else None) == active and tuple(r.p) == parse
