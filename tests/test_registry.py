"""Registered queries against their SQL counterparts at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SHOWN = ["flagship_stays", "validate_table", "known_before", "time_bin_label", "pair_code_result",
         "timeline_rules_check", "numeric_stats_trimmed", "percentile_grid", "temporal_split",
         "bootstrap_code_counts", "build_timeline", "label_timeline", "training_windows",
         "mc_event_probability", "sex_plausibility_summary", "auprc", "time_noise", "sample_ages",
         "epoch_resample", "lab_distribution", "single_patient_timeline", "simulation_order", "top_n",
         "correlation_matrix", "lab_cooccurrence_pairs", "draw_samples", "rank_nonnumeric_tokens"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SHOWN)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
