"""Every registered query outside llm against its SQL on the smallest tables, and the plans' promises."""

import datetime as dt
import math
import os

import pytest

import __spark_entry__
from tessera.operators import figures, reads
from tessera.queries import ORACLE_SQL as SQL
from tessera.queries import QUERIES, corpus, frames
from tessera.schemas import Direction, Metric

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return float(v) if isinstance(v, float) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert df.inputFiles(), "what a query returns comes from files"
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def test_the_others_run(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, SF).count() > 0, name


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(reads.latest_success(frames.records(spark, SF)).select("id"))
    assert "WindowGroupLimit" in plan and "o_totalprice" not in plan.split("FileScan")[1].split("ReadSchema")[1]
    assert "PushedFilters: [" in plan_of(corpus.QUERIES["r14_metadata_filter"](spark, SF)) and "EqualTo(lang,en)" in plan_of(corpus.QUERIES["r14_metadata_filter"](spark, SF))


def test_rankings_take_the_first_without_a_full_sort(spark):
    rows_ = figures.metric_rows(reads.current(frames.docs(spark, SF), frames.records(spark, SF)), Metric.TOTAL_REVENUE)
    assert "TakeOrderedAndProject" in plan_of(figures.ranking(rows_, Direction.HIGHEST, 5))


def test_llm_is_imported_by_no_other_module():
    from pathlib import Path

    root = Path(__spark_entry__.HERE) / "tessera"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "llm" in p.read_text()]
