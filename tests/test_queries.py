"""Every registered query beside its SQL, and plan checks."""

import pytest

import oracle
from vigilframe import catalog

catalog.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    diff = oracle.compare(got, con.execute(catalog.SQL[name]).df())
    assert diff is None, diff


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_the_columns_they_need(spark):
    p = plan(spark, "a02_value_counts_by_group")
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in p


def test_filters_reach_the_scan(spark):
    assert "EqualTo(user_id,7)" in plan(spark, "p21_entity_time_slice")


@pytest.mark.parametrize("name", ["w02_count_windows", "j01_asof_phase", "j14_interval_labels_bucketed", "a29_record_suspiciousness", "j15_graph_rbf_binary"])
def test_no_nested_loops(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.fixture
def many_buckets(monkeypatch):
    """Treat the test tables as large, so every order-dependent operator takes its bucketed path."""
    from vigilframe.operators import ordering

    monkeypatch.setattr(ordering, "BUCKET_TARGET_BYTES", 5_000)


ORDERED = [
    "a13_group_thresholds_raw", "a26_metrics_by_group", "a29_record_suspiciousness", "a42_entity_diagnostics",
    "a44_direction_check", "a50_score_diagnostics", "a54_window_size_sensitivity", "f06_forward_filled_time",
    "j01_asof_phase", "j17_replay_loop", "p05_monotone_fraction", "p18_global_row_index", "st05_warmup_batch",
    "w02_count_windows", "w04_adaptive_windows", "w12_interleave", "w13_stratified_split", "w14_chronological_split",
    "w14_chronological_split_per_group", "w16_quota_sample", "w17_groups_stratified", "w18_balance_resample", "window_report",
]


@pytest.mark.parametrize("name", ORDERED)
def test_bucketed_path_equals_sql(spark, con, many_buckets, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    diff = oracle.compare(got, con.execute(catalog.SQL[name]).df())
    assert diff is None, diff


@pytest.mark.parametrize("name", ["p18_global_row_index", "w14_chronological_split", "w02_count_windows", "w12_interleave"])
def test_large_inputs_rank_inside_buckets(spark, many_buckets, name):
    ranks = [line for line in plan(spark, name).splitlines() if "Window [row_number()" in line]
    assert ranks and all("__bucket" in line for line in ranks)
