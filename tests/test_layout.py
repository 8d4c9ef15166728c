"""What stored mail spares: partitions by month and row groups by uid."""

from datetime import datetime

import pytest

from mailsieve.operators import listing
from mailsieve.schema import EMAILS_SCHEMA
from mailsieve.sources import tables


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "emails")
    dates = [None, datetime(2023, 12, 31, 23, 59, 59), datetime(2024, 1, 1), datetime(2024, 1, 31), datetime(2024, 2, 1), datetime(2025, 3, 5)]
    rows = [(str(n), 1, "s", "a@b.c", dates[n % 6], "", f"body {n}", "") for n in range(60)]
    tables.write_emails_by_month(spark.createDataFrame(rows, EMAILS_SCHEMA), path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def months(df):
    return {f.split("month=")[1].split("/")[0] for f in df.inputFiles()}


def test_dates_open_only_their_months(spark, stored):
    df = tables.read_emails_by_month(spark, stored, "2024-01-01", "2024-01-31")
    assert sorted(r.uid for r in df.collect()) == sorted(str(n) for n in range(60) if n % 6 in (2, 3))
    text = plan(df)
    assert "PartitionFilters: [isnotnull(month" in text and "GreaterThanOrEqual(date" in text
    scanned = df._jdf.queryExecution().executedPlan().collectLeaves().head().selectedPartitions().partitionCount()
    assert scanned == 1
    assert tables.read_emails_by_month(spark, stored).count() == 60
    assert tables.read_emails_by_month(spark, stored, before="2024-01-01").count() == 20
    assert tables.read_emails_by_month(spark, stored, after="2024-01-01T00:00:01").count() == 30


def test_lookup_pushes_the_uid(spark, stored):
    df = listing.get_email(tables.read_emails_by_month(spark, stored), "7")
    assert df.first().body == "body 7" and "EqualTo(uid,7)" in plan(df)
