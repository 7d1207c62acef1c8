import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from flowtide.catalog import queries as catalog
from flowtide.catalog.views import SQL_VIEWS

SF = "/root/testdata/sf0.001"
TABLES = ["events", "lineitem", "embeddings"]
# the inventory keys that have no SQL twin
ROWS_ONLY = {"synthesize_minority", "balance_dataset", "train_binary", "train_multiclass", "evaluate_model",
             "zero_shot_eval", "domain_adapt", "realtime_table_live", "score_cascade_models", "feature_attribution"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_its_oracle():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == ROWS_ONLY
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


def test_oracles_parse(con):
    for key, sql in catalog.ORACLES.items():
        con.execute(f"EXPLAIN {sql}")
    assert len(SQL_VIEWS) > 20


@pytest.mark.parametrize("key", ["tier2_windows", "label_by_interval", "label_by_interval_sorted", "stratified_split", "latency_summary",
                                 "class_loss_check", "stream_tier2_windows", "knn_join"])
def test_against_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF)
    rel = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scans_prune_and_push_down(spark):
    from flowtide.catalog import views as V
    from flowtide.operators.features import drop_incomplete, scan_columns

    plan = scan_columns(V.flows(spark, SF), ["flow_id", "flow_duration"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<flow_id:bigint,flow_duration:double>" in plan
    kept = drop_incomplete(V.flows(spark, SF).select("flow_id", "flow_duration"), ["flow_duration"])
    assert kept.count() > 0
    plan = V.flows(spark, SF).where("flow_id < 5").select("flow_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(flow_id), LessThan(flow_id,5)]" in plan
