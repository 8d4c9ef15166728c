from datetime import datetime

from pyspark.sql import functions as F

from mailsieve.functions import dates, headers, quality


def test_mail_dates(apply):
    values = {
        "Sat, 13 Jul 2025 14:32:00 +0530": datetime(2025, 7, 13, 9, 2),
        "13 Jul 2025 14:32:00 -0700 (PDT)": datetime(2025, 7, 13, 21, 32),
        "Mon, 1 Jan 24 00:00 EST": datetime(2024, 1, 1, 5, 0),
        "1 Feb 99 01:02:03 GMT": datetime(1999, 2, 1, 1, 2, 3),
        "Thursday, 06-Nov-94 08:49:37 GMT": datetime(1994, 11, 6, 8, 49, 37),
        "5 March 2024 7:08": datetime(2024, 3, 5, 7, 8),
        "Jul 13, 2025 14:32": datetime(2025, 7, 13, 14, 32),
        "July 4 2024": datetime(2024, 7, 4),
        "2025-07-13": datetime(2025, 7, 13),
        "2025-07-13T15:30:00Z": datetime(2025, 7, 13, 15, 30),
        "2025-07-13 15:30:00+02:00": datetime(2025, 7, 13, 13, 30),
        "31 Feb 2024 00:00:00 +0000": None,
        "no date": None,
        "": None,
        None: None,
    }
    assert apply(dates.parse_mail_date, list(values)) == list(values.values())


def test_iso_dates(apply):
    first = datetime(1, 1, 1)
    values = {
        "2025-07-13T15:30:00": datetime(2025, 7, 13, 15, 30),
        "2025-07-13 15:30:00": datetime(2025, 7, 13, 15, 30),
        "2025-07-13T15:30:00+05:30": datetime(2025, 7, 13, 15, 30),
        "2025-07-13T15:30:00.25Z": datetime(2025, 7, 13, 15, 30, 0, 250000),
        "20250713": datetime(2025, 7, 13),
        "20250713T1530": datetime(2025, 7, 13, 15, 30),
        "2025-07-13 and more": datetime(2025, 7, 13),
        "2025-7-3": datetime(2025, 7, 3),
        "2025-13-40": first,
        "2025": first,
        "Sat, 13 Jul 2025": first,
        "invalid-date": first,
        None: None,
    }
    assert apply(dates.parse_iso_date, list(values)) == list(values.values())


def test_epoch(apply):
    values = ["INBOX (UIDVALIDITY 123456)", "INBOX ()", "UIDVALIDITY x", None]
    assert apply(headers.parse_epoch, values) == [123456, None, None, None]


def test_reject_reason(spark):
    long = "this body is long enough to be kept"
    cases = [
        ("", "", "empty"),
        ("s", "x" * 19, "short body"),
        ("s", "x" * 20, None),
        ("s", " " * 30 + "x" * 19, "short body"),
        ("", "x" * 20, None),
        ("Urgent: please", long + " reply", "URGENT.*REPLY"),
        ("urgent", long + "\nreply", None),
        ("s", long + " click here now", "CLICK HERE NOW"),
        ("s", long + " make money fast", "MAKE MONEY FAST"),
        ("s", long + " free money", "FREE MONEY"),
        ("s", long + " exact now", "ACT NOW"),
        (None, None, "empty"),
    ]
    df = spark.createDataFrame(cases, "s string, b string, r string")
    rows = df.select("r", quality.reject_reason(F.col("s"), F.col("b")).alias("got")).collect()
    assert [r["got"] for r in rows] == [c[2] for c in cases]


def test_addresses(apply):
    values = ["a.b+c@d-e.org", "a@b.c", "a@b", "@b.cd", "a b@c.de", "a@b.cd ", None]
    assert apply(quality.is_address, values) == [True, False, False, False, False, False, False]
