"""The byte-range data source and reads of parts of files."""

import pickle
import random

import pytest
from pyspark.sql import functions as F

from casework.operators import artifacts, lines
from casework.sources import ranges
from casework.sources.files import CHUNK

PLAN = "case_id string, os_path string, seq bigint, start bigint, length bigint"


@pytest.fixture
def data(tmp_path):
    content = random.Random(5).randbytes(3 * CHUNK + 777)
    (tmp_path / "d.bin").write_bytes(content)
    (tmp_path / "short.bin").write_bytes(b"only this")
    return tmp_path, content


def planned(spark, folder, rows):
    return spark.createDataFrame([(c, str(folder / f), i, s, n) for i, (c, f, s, n) in enumerate(rows)], PLAN)


@pytest.mark.parametrize("piece", [1000, CHUNK, 64 * CHUNK])
def test_ranges_give_their_bytes(spark, data, piece):
    folder, content = data
    spans = [("a", "d.bin", 10, 2 * CHUNK + 5), ("a", "d.bin", 3 * CHUNK, 777), ("b", "d.bin", 0, 0), ("b", "d.bin", 5, 1)]
    if piece == 1000:
        spans = [("a", "d.bin", 10, 30_000), ("b", "d.bin", 5, 1)]
    df = ranges.read_ranges(planned(spark, folder, spans), piece)
    rows = df.collect()
    for seq, (_, _, start, n) in enumerate(spans):
        parts = sorted((r.chunk_offset, bytes(r.bytes)) for r in rows if r.seq == seq)
        assert b"".join(p for _, p in parts) == content[start : start + n]
    assert all(r.error is None for r in rows)
    if piece == 1000:
        assert df.rdd.getNumPartitions() >= 30


def test_a_short_or_missing_file_leaves_others_whole(spark, data):
    folder, content = data
    out = ranges.read_ranges(planned(spark, folder, [("a", "d.bin", 0, 100), ("b", "short.bin", 0, 50), ("c", "gone.bin", 0, 5)])).collect()
    got = {(r.case_id, bytes(r.bytes) if r.bytes is not None else None, r.error is None) for r in out}
    assert got == {("a", content[:100], True), ("b", b"only this", True), ("b", None, False), ("c", None, False)}


def test_filters_of_one_query_do_not_reach_the_next(spark, data):
    folder, content = data
    plan = planned(spark, folder, [(c, "d.bin", k * 10, 10) for k, c in enumerate("abcab")] + [("c", "gone.bin", 0, 5)])
    df = ranges.read_ranges(plan, 10)
    assert sorted((r.seq, bytes(r.bytes)) for r in df.where("case_id = 'a'").collect()) == [(0, content[:10]), (3, content[30:40])]
    assert df.count() == 6 == df.rdd.getNumPartitions()
    assert ranges.read_ranges(plan.where("case_id = 'a'"), 10).rdd.getNumPartitions() == 2


def test_stretches_pack_short_ranges_and_cut_long_ones():
    cut = ranges.stretches([("c", "p", i, 0, 3) for i in range(5)] + [("c", "q", 9, 100, 25)], 10)
    assert [[p[3:] for p in s.pieces] for s in cut] == [[(0, 3)] * 3, [(0, 3)] * 2, [(100, 10)], [(110, 10)], [(120, 5)]]
    assert ranges.stretches([], 10) == []


def listed(spark, folder, contents):
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    return spark.createDataFrame([("c", str(folder / n), len(b)) for n, b in contents.items()], "case_id string, os_path string, size bigint")


def whole(spark, folder, contents):
    return spark.createDataFrame([("c", str(folder / n), bytearray(b)) for n, b in contents.items()], "case_id string, os_path string, content binary")


def test_parts_of_files_equal_whole_cells(spark, tmp_path):
    r = random.Random(3)
    page = lambda magic: magic + r.randbytes(4092)
    contents = {
        "pages": b"".join(page(r.choice([b"INDX", b"none"])) for _ in range(600)) + b"IND", "pages_more": page(b"INDX") * 300 + b"INDX", "empty": b"", "tiny": b"FI",
        "log": b"".join(b"line %d\r\n" % i for i in range(20_000)) + b"end", "records": b"".join(r.choice([b"FILE", b"BAAD", b"RSTR"]) + bytes(1020) for _ in range(100)),
    }
    files, cells = listed(spark, tmp_path, contents), whole(spark, tmp_path, contents)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))
    assert same(artifacts.count_file_page_signatures(files), artifacts.count_page_signatures(cells))
    assert same(artifacts.sample_file_signatures(files, 1024), artifacts.sample_signatures(cells, 1024))
    assert same(lines.tail_file_lines(files, 5, 512), lines.tail_lines(cells, 5, 512))


def test_what_is_read_of_a_file_is_bounded(spark, tmp_path):
    files = listed(spark, tmp_path, {"big": bytes(5 * CHUNK), "small": b"abc"})
    for read, most in ((ranges.first_bytes(files, 4096), 4096), (ranges.last_bytes(files, 70_000), 70_000)):
        assert {r.n for r in read.select(F.length("content").alias("n")).collect()} == {most, 3}
    plan = files.select("case_id", "os_path", F.lit(0).alias("seq"), F.lit(0).alias("start"), F.col("size").alias("length"))
    heads = ranges.read_ranges(plan, every=4096, take=4).agg(F.sum(F.length("bytes"))).first()[0]
    assert heads == 5 * CHUNK // 4096 * 4
    with pytest.raises(ValueError):
        ranges.first_bytes(files, 1 << 40)


def test_many_small_pieces_share_partitions(spark, data):
    folder, content = data
    df = ranges.read_ranges(planned(spark, folder, [("a", "d.bin", 0, 600_000), ("b", "short.bin", 0, 9)]), 1000)
    assert df.rdd.getNumPartitions() <= ranges.TASKS
    rows = df.where("seq = 0").collect()
    assert max(len(r.bytes) for r in rows) == 1000
    assert b"".join(bytes(r.bytes) for r in sorted(rows, key=lambda r: r.chunk_offset)) == content[:600_000]


def test_joined_partitions_keep_pieces_and_stay_small():
    parts = ranges.stretches([("c", "p", 0, 0, 10_000)], 10)
    some = ranges.joined(parts, 64, 10)
    assert len(some) == 63 and [p for s in some for p in s.pieces] == [p for s in parts for p in s.pieces]
    large = ranges.stretches([("c", "p", 0, 0, 400 * CHUNK)], 32 * CHUNK)
    assert [len(s.pieces) for s in ranges.joined(large, 2, 32 * CHUNK)] == [2] * 6 + [1]


def test_the_driver_sees_no_pieces(spark, tmp_path, monkeypatch):
    """A partition of many small files is a few places of the plan, however many files there are."""
    monkeypatch.setattr(ranges, "shared_dir", lambda spark, purpose: str(tmp_path / "plan"))
    at = F.concat(F.lit(f"{tmp_path}/"), F.col("id"))
    plan = spark.range(20_000).select(F.lit("c").alias("case_id"), at.alias("os_path"), F.lit(0).alias("seq"), F.lit(0).alias("start"), F.lit(5).alias("length"))
    ranges.read_ranges(plan)
    parts = ranges.RangeReader({"path": str(tmp_path / "plan")}).partitions()
    assert 1 <= len(parts) <= 4 and len(pickle.dumps(parts)) < 4000


def test_a_plan_of_several_files_is_read_whole(spark, tmp_path):
    r = random.Random(9)
    contents = {f"f{i}": r.randbytes(r.choice([0, 1, 30, 400])) for i in range(60)}
    files = listed(spark, tmp_path, contents)
    plan = files.select("case_id", "os_path", F.lit(7).alias("seq"), F.lit(0).alias("start"), F.col("size").alias("length"))
    plan = plan.union(files.limit(3).select("case_id", "os_path", F.lit(8), F.lit(0), F.lit(None).cast("bigint")))
    wanted = {name: body for name, body in contents.items() if body}
    try:
        for coalesce, piece in (("true", 100), ("false", 100), ("false", 7), ("false", 64 * CHUNK)):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            rows = ranges.read_ranges(plan, piece).collect()
            got = {name: b"".join(bytes(x.bytes) for x in sorted(rows, key=lambda x: x.chunk_offset) if x.os_path.endswith(f"/{name}")) for name in wanted}
            assert got == wanted and {(x.seq, x.error) for x in rows} == {(7, None)} and max(len(x.bytes) for x in rows) <= piece
            assert ranges.read_ranges(plan.limit(0), piece).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_places_cover_each_stretch_once():
    files = [("a", 1, 40), ("b", 3, 210), ("c", 1, 50), ("d", 1, 30), ("e", 2, 110)]
    each = sorted((name, i) for name, n, _ in files for i in range(n))
    for most, piece in ((100, 100), (3, 100), (1, 100), (3, 64 * CHUNK)):
        parts = ranges.places(files, most, piece)
        assert sorted((name, i) for p in parts for name, first, end in p.pieces for i in range(first, end)) == each
        assert piece == 64 * CHUNK or len(parts) <= most
    assert [("a", 0, 1), ("c", 0, 1)] in [p.pieces for p in ranges.places(files, 100, 100)]
    assert ranges.places([], 64, 10) == []
