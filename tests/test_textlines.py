"""Lines of cut files against the reader of whole files."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from casework.operators import lines
from casework.sources import textlines


def contents():
    r = random.Random(4)
    alphabet = ["a", "b c", "é", "日本", "😀", "\r", " ", "x" * 50, "ऊ"]
    prose = lambda n, end: "".join("".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) + end for _ in range(n))
    long_line = "é" * 9000 + "\n" + "short\n" + "😀" * 4000
    out = {
        "utf8": prose(900, "\n").encode(), "crlf": prose(900, "\r\n").encode(), "unended": (prose(300, "\n") + "last\r").encode(), "bom": b"\xef\xbb\xbf" + prose(400, "\n").encode(),
        "lossy": prose(300, "\n").encode() + b"\xff\xfe bad \xc3\n" + prose(300, "\n").encode(), "lossy_bom": b"\xef\xbb\xbf" + prose(300, "\n").encode() + b"\xe6\x97\n",
        "wide": ("plain ascii line\r\n" * 20 + prose(500, "\n")).encode("utf-16-le"), "wide_bom": b"\xff\xfe" + prose(500, "\r\n").encode("utf-16-le"), "wide_odd": b"\xff\xfe" + "a\nĊਊ\n".encode("utf-16-le") * 900 + b"x",
        "wide_half": b"\xff\xfe" + ("x\n".encode("utf-16-le") + b"\x00\xd8" + "\n".encode("utf-16-le")) * 700, "empty": b"", "one_end": b"\n", "mark_only": b"\xff\xfe", "mark8_only": b"\xef\xbb\xbf", "long": long_line.encode(),
        "cut_at_end": prose(300, "\n").encode() + "é".encode()[:1], "no_end": b"y" * 10_000, "ends_only": b"\n" * 5000, "continuation": b"\x80" * 3000,
    }
    for k in range(12):  # characters and line ends at every place around a border
        out[f"border{k}"] = b"z" * (2048 - 6 + k % 6) + ["é\r\n", "日\r\n", "😀\r\n"][k % 3].encode() * 900
    return out


def written(spark, folder, data):
    rows = []
    for name, content in data.items():
        (folder / name).write_bytes(content)
        rows.append(("c", name, str(folder / name), len(content)))
    return spark.createDataFrame(rows, "case_id string, os_path string, path string, size bigint")


@pytest.mark.parametrize("piece", [2048, 2050, 4096, 1 << 20])
def test_lines_of_cut_files_equal_those_of_whole_ones(spark, tmp_path, piece):
    data = contents()
    files = written(spark, tmp_path, data)
    got, problems = textlines.scan_text(files, piece)
    whole = spark.createDataFrame([("c", n, bytearray(b)) for n, b in data.items()], "case_id string, os_path string, content binary")
    columns = ["os_path", "line_no", "line", "encoding", "decode_lossy"]
    want = {tuple(r) for r in lines.read_lines(whole).select(*columns).collect()}
    found = [tuple(r) for r in got.select(*columns).collect()]
    assert set(found) == want and len(found) == len(want) and problems.count() == 0


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    data = {"big": b"".join(b"line %d\n" % i for i in range(60_000))}
    got, _ = textlines.scan_text(written(spark, tmp_path, data), 16_384)
    per_task = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 4 and sum(r["count"] for r in per_task) == 60_000 == got.agg(F.max("line_no")).first()[0]


def test_an_encoding_may_be_given(spark, tmp_path):
    files = written(spark, tmp_path, {"f": b"a\x00b\n\xff\n" * 2000})
    got, _ = textlines.scan_text(files, 2048, "utf-8-lossy")
    assert {(r.line, r.line_no % 2) for r in got.collect()} == {("a\0b", 1), ("�", 0)}


def test_unreadable_and_short_files_stay_alone(spark, tmp_path):
    files = written(spark, tmp_path, {"good": b"x\ny\n"}).union(
        spark.createDataFrame([("c", "gone", str(tmp_path / "gone"), 10), ("c", "short", str(tmp_path / "good"), 10_000)], "case_id string, os_path string, path string, size bigint")
    )
    got, problems = textlines.scan_text(files, 2048)
    assert sorted((r.os_path, r.line) for r in got.collect()) == [("good", "x"), ("good", "y")]
    assert {r.os_path for r in problems.collect()} == {"gone", "short"}
    assert [(r.os_path, r.source_sha256) for r in textlines.hash_files(files).collect()] == [("good", hashlib.sha256(b"x\ny\n").hexdigest())]


@pytest.mark.parametrize("piece", [0, 100, 4097])
def test_odd_or_tiny_pieces_are_refused(spark, piece):
    with pytest.raises(ValueError):
        textlines.scan_text(spark.createDataFrame([], "case_id string, os_path string, path string, size bigint"), piece)
