"""Every registered query against its SQL twin, and what the plans look like."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from mailsieve.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, connection, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["k1_keyword", "t2_clean_body", "t4_visible_reply", "t5_html_to_text", "f1_parse_date", "m1_upsert"])
def test_native_plans_have_no_python(spark, name):
    assert "Python" not in plan(catalog.QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["k1_keyword", "o2_list_limit", "v3_knn"])
def test_top_k_needs_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES[name](spark, FOLDER))


def test_no_query_uses_a_cross_join(spark):
    for name in ("a1_status", "k2_hybrid_fallback", "v7_knn_join", "m5_epoch", "j3_hits_emails"):
        text = plan(catalog.QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_scans_read_only_what_they_need(spark):
    text = plan(catalog.QUERIES["c7_sender"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in text


def test_ingest_has_no_shuffle(spark):
    assert "Exchange" not in plan(catalog.QUERIES["s2_ingest"](spark, FOLDER))
