"""Registered queries against DuckDB at the smallest scale; CASEWORK_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from bindings.registry import ORACLES, QUERIES
from bindings.views import TABLES

SF = "/root/testdata/sf0.001"
QUICK = ("tim_1_filetime", "det_1_detection", "det_6_work_units", "win_2_pending_time", "win_3_range_coalesce", "join_1_chromium_visits", "inv_11_hash_verification", "stm_2_plan_state", "inv_13_expected_vs_found", "src_1_packages", "src_2_tree", "stm_4_landing_zone", "run_4_damaged_members")
ALL = os.environ.get("CASEWORK_ALL") == "1"


def plain(row, names):
    out = []
    for name in names:
        v = row[name]
        v = None if v != v else v
        out.append(f"{float(v):.9g}" if v is not None and not isinstance(v, (str, bool)) else str(v))
    return tuple(out)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(QUERIES) if ALL else QUICK)
def test_query(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    expected = con.execute(entry.oracle_sql()[name]).df()
    assert names == sorted(expected.columns)
    left = sorted(plain(r.asDict(), names) for r in got.collect())
    right = sorted(plain(r, names) for r in expected.astype(object).where(expected.notna(), None).to_dict("records"))
    assert left == right


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
