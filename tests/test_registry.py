"""Nested values of registry keys in bounded parts."""

import pytest
from pyspark.sql import functions as F

from casework.operators import registry as reg

KEYS = "case_id string, source_path string, key_id bigint, hive_name string, key_path string, sub_keys_list_offset_relative_raw bigint, key_values_list_offset_relative_raw bigint"
VALUES = "case_id string, source_path string, key_id bigint, value_no bigint, value_name string, data_type string, data binary, data_size_raw bigint, decoded string"


def tables(spark, hot=400):
    keys, values = [], []
    for case in ("a", "b"):
        for hive in ("C/x/SYSTEM", "C/x/SOFTWARE"):
            for key in range(4):
                keys.append((case, hive, key, hive.rsplit("/", 1)[-1], f"ROOT\\k{key}", 1, 1))
                n = hot if (case, hive, key) == ("a", "C/x/SYSTEM", 1) else key
                values += [(case, hive, key, i * 1000, f"{case}{hive}{i}", "RegBinary", bytearray(bytes([i % 256]) * (10 + i % 90)), 10 + i % 90, "null") for i in range(n)]
    return spark.createDataFrame(keys, KEYS), spark.createDataFrame(values, VALUES).repartition(7)


@pytest.mark.parametrize("part_bytes, width", [(1 << 20, None), (2000, 25), (1, 1000)])
def test_values_of_a_key_come_in_order_in_bounded_parts(spark, part_bytes, width):
    keys, values = tables(spark)
    rows = reg.key_records(keys, values, part_bytes, width).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: r.part_no):
        k = (r.case_id, r.source_path, r.key_id)
        at = seen.setdefault(k, [])
        assert r.part_no == len(at)
        at.append([(v.value_no, v.value_name, v.value_data_hex) for v in r["values"] or []])
        size = sum(v.value_data_length + reg.VALUE_BYTES for v in r["values"] or [])
        assert size < part_bytes + 99 + reg.VALUE_BYTES
        assert r.value_count == (400 if k == ("a", "C/x/SYSTEM", 1) else k[2])
        assert r.n_parts == sum(x.case_id == k[0] and x.source_path == k[1] and x.key_id == k[2] for x in rows)
    want = {}
    for v in values.collect():
        want.setdefault((v.case_id, v.source_path, v.key_id), []).append((v.value_no, v.value_name, bytes(v.data).hex()))
    assert len(seen) == 16 and {k: sum(p, []) for k, p in seen.items() if k in want} == {k: sorted(p) for k, p in want.items()}


def test_equal_key_numbers_of_two_hives_stay_apart(spark):
    keys, values = tables(spark, 2)
    names = {(r.case_id, r.source_path, v.value_name[:1], v.value_name[1:11]) for r in reg.key_records(keys, values).collect() for v in r["values"] or []}
    assert all(case == c and path[:10] == p for case, path, c, p in names) and len(names) == 4


def test_keys_without_values_and_no_tables(spark):
    keys, values = tables(spark, 0)
    assert reg.key_records(keys, values.limit(0)).where("value_count = 0 AND n_parts = 1 AND part_no = 0").count() == 16
    assert reg.key_records(keys.limit(0), values).count() == 0
    assert reg.key_records(keys.drop("case_id", "source_path").withColumn("source_path", F.lit("C/x/SAM")), values.drop("case_id", "source_path")).count() > 0


def test_foreign_lines_keep_their_case_and_lost_ones_are_counted(spark):
    from casework.operators import runs

    lines = spark.createDataFrame(
        [("a", "p1", "/x/a/One.jsonl", "1"), ("b", "p1", "/x/b/One.jsonl", "2"), ("b", "p1", "/x/b/One.jsonl", "3"), ("a", "p1", "/x/a/Nothing.jsonl", "4")],
        "case_id string, package string, result_file string, record string",
    )
    plans = spark.createDataFrame([("a", "One", "f::One"), ("c", "Nothing", "f::Nothing")], "case_id string, output_name string, plan_id string")
    assert [(r.case_id, r.package, r.plan_id, r.record) for r in runs.union_results(lines, plans).collect()] == [("a", "p1", "f::One", "1")]
    lost = {(r.case_id, r.result_file, r.lines) for r in runs.unplanned_results(lines, plans).collect()}
    assert lost == {("b", "/x/b/One.jsonl", 2), ("a", "/x/a/Nothing.jsonl", 1)}
    # without cases in the plans, the file alone binds
    assert runs.union_results(lines, plans.drop("case_id")).count() == 4
