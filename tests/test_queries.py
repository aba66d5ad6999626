"""Registered queries against their SQL twins on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import table

FOLDER = "/root/testdata/sf0.001"
# One of each shape; tools/compare.py runs them all.
NAMES = [
    "win09_ts_zscore", "win11_rank", "win17_neutralise", "win18_row_curve", "agg02_resample_all", "agg03_full_bars",
    "job02_build_features", "job04_backtest_metrics", "src02_write_bars", "src10_flatten_report", "val05_validate_params",
    "joi01_calls_with_transcript", "joi10_active_segment_at", "joi11_tax_for_transactions", "joi15_upsert",
    "joi17_search_documents", "agg10_report_by_period", "agg11_coa_rollup", "agg15_training_metrics", "str01_chunk_text",
    "str02_fit_budget", "job06_expand_frontier", "job07_triage", "src14_compile_report", "top03_page_with_more",
    "stm06_rate_limit_violations",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_twin(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    mine = table(df.columns, df.collect())
    got = duck.execute(entry.oracle_sql()[name])
    theirs = table([c[0] for c in got.description], got.fetchall())
    assert mine == theirs


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["timestamp", "pnl", "cum_pnl"]
