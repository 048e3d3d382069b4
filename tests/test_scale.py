"""What must not grow with the input: copies of batches in Python, openings of packages, lists of files on the driver."""

import sqlite3
import tracemalloc

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from bindings.ranges import file_writer
from casework.sources import files, sqlite


def peak(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def batch(contents) -> pa.RecordBatch:
    n = len(contents)
    return pa.record_batch({"case_id": pa.array(["c"] * n), "os_path": pa.array([f"d{i}" for i in range(n)]), "content": pa.array(contents, pa.binary())})


def test_one_database_at_a_time_leaves_a_batch():
    connection = sqlite3.connect(":memory:")
    connection.execute("CREATE TABLE Activity (AppId TEXT, LastModifiedTime)")
    connection.execute("INSERT INTO Activity VALUES ('a', 1)")
    connection.commit()
    many = batch([connection.serialize() + bytes(200_000), b"not a database, just text"] * 100)
    read = sqlite._reader("Activity", sqlite.TIMELINE_TABLES["Activity"])
    found = []
    assert peak(lambda: found.extend(read([many]))) < many.nbytes / 4
    rows = pa.Table.from_batches(found).to_pylist()
    assert [(r["AppId"], r["LastModifiedTime"], r["error"] is None) for r in rows] == [("a", "1", True), (None, None, False)] * 100


def test_files_are_written_without_a_copy_of_the_batch(tmp_path):
    many = batch([b"", *[bytes([i]) * 100_000 for i in range(200)]])
    found = []
    assert peak(lambda: found.extend(file_writer(pafs.LocalFileSystem(), str(tmp_path))([many]))) < many.nbytes / 4
    assert found[0].column("size").to_pylist() == [0, *[100_000] * 200]
    assert (tmp_path / "d7.bin").read_bytes() == bytes([6]) * 100_000


def test_small_members_of_a_package_are_read_together_and_large_ones_apart(spark):
    members = spark.range(3 * 128).select(
        F.concat(F.lit("p"), F.col("id") % 3).alias("package"), F.call_function("div", "id", F.lit(3)).alias("member_no"), F.when(F.col("id") % 3 == 2, 5 << 20).otherwise(10).cast("bigint").alias("size")
    )
    of = members.select("*", files.together().alias("group")).groupBy("package").agg(F.countDistinct("group").alias("n"))
    assert {r.package: r.n for r in of.collect()} == {"p0": 2, "p1": 2, "p2": 128}
    dealt = files.spread(members, "package", files.together()).select("package", F.spark_partition_id().alias("task")).distinct()
    assert dealt.where("package <> 'p2'").count() <= 4


def test_trees_are_listed_by_tasks(spark, tmp_path):
    names = ["a/C/x.txt", "a/.hid/y.txt", "a/_u/z.txt", "a/p=1/_k=2/part-1", "b/sp ace/%41#.bin", "b/_x", "b/.history", "top"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    shown = {names[0], names[3], names[4], "top"}
    for root in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/"):
        tree = files.read_tree(spark, root)
        rows = tree.collect()
        assert {r.os_path for r in rows} == {f"{tmp_path}/{n}" for n in shown}
        assert all(r.os_path.endswith(bytes(r.content).decode()) and r.size == len(r.content) for r in rows)
        assert {(r.case_id, r.archive_path, r.volume) for r in rows} == {("a", "C/x.txt", "C"), ("a", "p=1/_k=2/part-1", None), ("b", "sp ace/%41#.bin", None), ("top", "top", None)}
    assert "binaryFile" not in tree._jdf.queryExecution().toString()
    for glob, n in (("part-*", 1), ("*.{txt,bin}", 2), ("[t-v]op", 1), ("?", 0)):
        assert files.read_tree(spark, str(tmp_path), glob, with_content=False).count() == n
    (tmp_path / "empty").mkdir()
    assert files.read_tree(spark, str(tmp_path / "empty")).count() == 0
