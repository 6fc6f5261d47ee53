import re

import pytest
from check_sql import compare, connect
from conftest import SMALL

import __spark_entry__ as entry_points
from sitelode.operators.jobs import pending_jobs
from sitelode.plans.registry import all_queries, all_sql
from sitelode.plans.views import AS_OF_JOBS, Fixture
from sitelode.session import materialize

NO_SQL = {"ml_logistic", "ml_unsupervised"}
MODELS = NO_SQL
NAMES = sorted(all_queries())


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


def test_only_models_lack_sql():
    assert set(NAMES) - set(all_sql()) == NO_SQL
    assert set(entry_points.queries()) >= set(NAMES) and set(entry_points.oracle_sql()) >= set(all_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, database, name):
    assert compare(spark, database, SMALL, name) is None


@pytest.mark.parametrize("name", sorted(set(NAMES) - MODELS))
def test_plan_stays_in_the_jvm_and_needs_no_all_pairs_join(spark, name):
    plan = all_queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"PythonUDF|InPandas|ArrowEval|CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", ["change_detect", "request_metrics", "stream_request_metrics", "job_duration", "retry_plan", "export_json"])
def test_results_do_not_depend_on_the_session_zone(spark, database, name):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert compare(spark, database, SMALL, name) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def formatted(frame):
    execution = frame._jdf.queryExecution()
    return frame.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(execution, "formatted")


def test_filters_and_columns_reach_the_scan(spark):
    table = materialize(Fixture(spark, SMALL).crawl_jobs)
    plan = formatted(pending_jobs(table, AS_OF_JOBS).select("job_id", "priority"))
    assert "EqualTo(status,pending)" in plan and "TakeOrderedAndProject" in plan
    assert "url" not in re.search(r"ReadSchema: (.*)", plan)[1]
    ranked = formatted(all_queries()["page_cap"](spark, SMALL))
    assert re.search(r"WindowGroupLimit.*Partial", ranked, re.S)  # limited before the shuffle
