import random
import struct

import pytest
from pyspark.sql import functions as F

from casework.operators import artifacts, usn
from casework.sources.files import CHUNK
from casework.sources.ranges import read_ranges


def record(name="example.txt", usn_no=42, major=2, size=None):
    raw = name.encode("utf-16le")
    head = 60 if major == 2 else 76
    length = size or -(-(head + len(raw)) // 8) * 8
    refs = struct.pack("<QQ", 0x0102030405060708, 0x1112131415161718) if major == 2 else bytes(range(16, 0, -1)) * 2
    body = struct.pack("<IHH", length, major, 0) + refs + struct.pack("<QQIIIIHH", usn_no, 132537600000000000, 0x80000100, 0, 0, 0x10, len(raw), head) + raw
    return body.ljust(length, b"\0")


def ranges_df(spark, path, spans, base=0):
    rows = [("c", str(path), i, s, n, base) for i, (s, n) in enumerate(spans)]
    return spark.createDataFrame(rows, "case_id string, os_path string, seq bigint, start bigint, length bigint, base bigint")


def parsed(spark, path, spans, base=0, piece=256 * CHUNK):
    records, problems = usn.split_usn(ranges_df(spark, path, spans, base), piece)
    rows = usn.usn_rows(usn.decode_usn(records)).orderBy("record_offset").collect()
    return rows, sorted((p.record_offset, p.problem, p.amount) for p in problems.collect())


def test_record_fields(spark, tmp_path):
    path = tmp_path / "j.bin"
    path.write_bytes(record() + record(major=3) + bytes(128))
    rows, problems = parsed(spark, path, [(0, path.stat().st_size)])
    assert problems == []
    two, three = rows
    assert (two.file_name, int(two.usn), two.timestamp, two.reason_flags) == ("example.txt", 42, "2020-12-30T00:00:00.000000000Z", ["FILE_CREATE", "CLOSE"])
    assert two.file_reference_number == "0x0102030405060708" and two.file_attribute_flags == ["DIRECTORY"] and two.source_flags is None
    assert three.file_reference_number == "0x0102030405060708090A0B0C0D0E0F10"


def test_gaps_and_bad_records(spark, tmp_path):
    path = tmp_path / "j.bin"
    bad = struct.pack("<IHH", 16, 9, 1) + bytes(8)
    data = bytes(4096) + record() + bad + struct.pack("<IHH", 5, 0, 0) + record("b") + b"\x60\0\0\0cut!"
    path.write_bytes(data)
    rows, problems = parsed(spark, path, [(4096, len(data) - 4096)], base=1000)
    assert [r.record_offset for r in rows] == [5096, 5096 + len(record()) + 24]
    assert [p[1:] for p in problems] == [("invalid_length", 5), ("trailing", 8)]
    decoded = usn.decode_usn(usn.split_usn(ranges_df(spark, path, [(4096, len(data) - 4096)]))[0])
    assert [r.error for r in decoded.where("error is not null").collect()] == ["unsupported record version 9.1"]


def test_short_zero_tail_is_silent_only_at_the_end(spark, tmp_path):
    path = tmp_path / "j.bin"
    one = record()
    path.write_bytes(one + bytes(4) + bytes(4096) + one + bytes(4))
    n = len(one)
    _, problems = parsed(spark, path, [(0, n + 4), (n + 4100, n + 4)])
    assert problems == [(n, "trailing", 4)]


def journal(seed, size):
    rng, out = random.Random(seed), bytearray()
    while len(out) < size:
        kind = rng.random()
        if kind < 0.9:
            out += record("n" * rng.randint(1, 200), rng.randint(0, 10**9), rng.choice((2, 3)))
        elif kind < 0.97:
            out += bytes(rng.choice((8, 64, 4096)))
        else:
            out += struct.pack("<IHH", rng.choice((3, 7)), 0, 0)
        if rng.random() < 0.0005:
            out += record("big", size=200_000)
    return bytes(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_equal_one_walk(spark, tmp_path, seed):
    path = tmp_path / "j.bin"
    path.write_bytes(journal(seed, 5 * CHUNK + 12345))
    spans = [(0, path.stat().st_size)]
    assert parsed(spark, path, spans, piece=CHUNK) == parsed(spark, path, spans)


def test_wrong_guess_falls_back_to_one_walk(spark, tmp_path):
    path = tmp_path / "j.bin"
    # a record spanning several segments is full of records a guess would take for the chain
    huge = record("outer", size=3 * CHUNK)
    inner = record("inner") * (2 * CHUNK // len(record("inner")))
    path.write_bytes(record() + huge[:4096] + inner.ljust(3 * CHUNK - 4096, b"\0") + record("last"))
    spans = [(0, path.stat().st_size)]
    rows, problems = parsed(spark, path, spans, piece=CHUNK)
    assert [r.file_name for r in rows] == ["example.txt", "outer", "last"] and problems == []


def walks(spark, path, piece=CHUNK):
    """(records, how often each segment was walked) of one stream."""
    parts, segments = usn.walk_ranges(ranges_df(spark, path, [(0, path.stat().st_size)]), piece)
    return parts.where("kind = 'record'").count(), [r.walks for r in segments.orderBy("begin").collect()]


def test_each_byte_is_walked_once_and_a_segment_again_per_wrong_guess(spark, tmp_path):
    path = tmp_path / "j.bin"
    path.write_bytes(record("n" * 40) * (6 * CHUNK // len(record("n" * 40))))
    n, walked = walks(spark, path)
    assert walked == [1] * 6 and n == path.stat().st_size // len(record("n" * 40))
    # records inside a record, ending anywhere but on its end: two segments are entered at wrong places, the rest is right
    decoy, filler = record("inner"), record("f" * 30)
    outer = record("outer", size=65_528)
    trap = outer[:256] + (decoy * (65_000 // len(decoy)))[: 65_528 - 256 - 8] + bytes(8)
    out = bytearray()
    for k in range(6):
        while len(out) < (k + 1) * CHUNK - 30_000:
            out += filler
        if k in (1, 3):
            out += trap
    path.write_bytes(bytes(out))
    n, walked = walks(spark, path)
    whole = list(usn.split_range(path.open("rb"), 0, len(out)))
    assert n == sum(p[0] == "record" for p in whole)
    assert sum(walked) <= len(walked) + 2 and walked[0] == 1


def test_segments_inside_one_large_record_are_passed_over(spark, tmp_path):
    path = tmp_path / "j.bin"
    inner = record("inner")
    huge = record("outer", size=5 * CHUNK + 8)
    body = huge[:4096] + (inner * (5 * CHUNK // len(inner)))[: 5 * CHUNK + 8 - 4096]
    path.write_bytes(record() + body + record("last") * 10)
    n, walked = walks(spark, path)
    assert n == 12 and walked == [1, 1, 1, 1, 1, 2]


def test_one_short_stream_leaves_others_whole(spark, tmp_path):
    good, short = tmp_path / "good.bin", tmp_path / "short.bin"
    good.write_bytes(journal(3, 2 * CHUNK))
    short.write_bytes(record() * 3)
    rows = [("a", str(good), 0, 0, good.stat().st_size, 0), ("b", str(short), 0, 0, 3 * CHUNK, 0), ("c", str(tmp_path / "none"), 0, 0, 50, 0)]
    df = spark.createDataFrame(rows, "case_id string, os_path string, seq bigint, start bigint, length bigint, base bigint")
    records, problems = usn.split_usn(df, CHUNK)
    alone, _ = usn.split_usn(df.where("case_id = 'a'"))
    assert records.where("case_id = 'a'").count() == alone.count() > 0
    bad = {(r.case_id, r.problem.split(":")[0]) for r in problems.where("case_id <> 'a'").collect()}
    assert bad == {("b", "unreadable"), ("c", "unreadable")}


def test_byte_ranges(spark, tmp_path):
    path = tmp_path / "d.bin"
    data = bytes(random.Random(1).randbytes(3 * CHUNK))
    path.write_bytes(data)
    out = read_ranges(ranges_df(spark, path, [(10, 2 * CHUNK), (3 * CHUNK - 5, 5)]), piece=CHUNK).collect()
    for seq, (start, n) in enumerate([(10, 2 * CHUNK), (3 * CHUNK - 5, 5)]):
        parts = sorted((r.chunk_offset, bytes(r.bytes)) for r in out if r.seq == seq)
        assert b"".join(p for _, p in parts) == data[start:start + n]


def test_sidecar_window(spark, tmp_path):
    """A sidecar's window and runs limit what is read; rows carry its volume."""
    path = tmp_path / "$J.bin"
    one = record()
    path.write_bytes(bytes(4096) + one)
    doc = '{"volume":"C","usn_journal_data":{"first_usn":"4096","next_usn":"%d"},"data_runs":[{"logical_offset":0,"length":4096,"sparse":true},{"logical_offset":4096,"length":%d,"sparse":false}]}'
    body = (doc % (4096 + len(one), len(one))).encode()
    files = spark.createDataFrame(
        [("c", "$metadata/collectors/C/windows_usn_journal/manifest.json", bytearray(b'{"volume":"other"}')), ("c", "C/$Extend/$UsnJrnl/$J.bin.metadata.json", bytearray(body))],
        "case_id string, archive_path string, content binary",
    )
    streams = spark.createDataFrame([("c", str(path), "C/$Extend/$UsnJrnl/$J.bin", 4096 + len(one))], "case_id string, os_path string, archive_path string, size bigint")
    rows, problems = usn.parse_usn(files, streams)
    (row,) = rows.collect()
    assert (row.record_offset, row.volume, len(row.reason_flags)) == (4096, "C", 2) and problems.count() == 0


def info2(entries, size, count=0, signature=5):
    out = struct.pack("<IIIII", signature, count, 0, size, 0)
    for name, wide, index, ticks, length in entries:
        e = name.encode().ljust(260, b"\0") + struct.pack("<IIQI", index, 2, ticks, length)
        out += e + (wide.encode("utf-16le").ljust(520, b"\0") if size == 800 else b"")
    return bytearray(out)


def test_info2(spark):
    entry, empty = ("C:\\A~1", "C:\\Ä", 1, 132537600000000000, 9), ("", "", 0, 0, 0)
    files = [
        ("c", "wide", info2([entry, empty, entry], 800, 2)), ("c", "narrow", info2([entry], 280)), ("c", "bad", info2([], 280, signature=4)),
        ("c", "size", info2([], 300)), ("c", "short", bytearray(b"x")),
    ]
    df = spark.createDataFrame(files, "case_id string, os_path string, content binary")
    ok, errors = artifacts.split_errors(artifacts.decode_info2(df))
    got = sorted((r.os_path, r.offset, r.original_filename, r.short_filename) for r in ok.collect())
    assert got == [("narrow", 20, "C:\\A~1", None), ("wide", 20, "C:\\Ä", "C:\\A~1")]
    assert sorted((r.os_path, r.error) for r in errors.collect()) == [
        ("bad", "unsupported format signature: 4"), ("short", "file too small"), ("size", "unsupported file entry size: 300"),
    ]


def test_rp_log_and_signatures(spark):
    log = struct.pack("<IIQ", 1, 2, 3) + "point".encode("utf-16le") + b"\0\0" + struct.pack("<Q", 132537600000000000)
    pages = b"INDX".ljust(4096, b"\0") + b"none".ljust(4096, b"\0") + b"IND"
    df = spark.createDataFrame([("c", "a", bytearray(log))], "case_id string, os_path string, content binary")
    r = artifacts.parse_rp_log(df).first()
    assert (r.description, r.restore_point_event_type, int(r.sequence_number), r.creation_time[:10]) == ("point", 1, 3, "2020-12-30")
    df = spark.createDataFrame([("c", "a", bytearray(pages))], "case_id string, os_path string, content binary")
    assert tuple(artifacts.count_page_signatures(df).first())[2:] == (2, 1)
    s = artifacts.sample_signatures(df.withColumn("content", F.lit(bytearray(b"FILE" + bytes(12) + b"BAAD" + bytes(12) + b"RSTR"))), 16).first()
    assert (s.sampled, s.first_signature, s.file_count, s.baad_count, s.mft_ok, s.log_ok) == (2, "FILE", 1, 1, True, False)
