"""Row filters of the searches."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.display import preview
from mailsieve.functions.patterns import or_empty


def day_start(day: str) -> Column:
    return F.lit(day).cast("timestamp_ntz")


def date_after(emails: DataFrame, day: str) -> DataFrame:
    """From the start of ``day`` on."""
    return emails.where(F.col("date") >= day_start(day))


def date_before(emails: DataFrame, day: str) -> DataFrame:
    """Up to the start of ``day``; the rest of that day is out."""
    return emails.where(F.col("date") <= day_start(day))


def sender_contains(emails: DataFrame, part: str) -> DataFrame:
    return emails.where(F.contains(F.lower(or_empty(F.col("sender"))), F.lit(part.lower())))


def regex_on_preview(emails: DataFrame, pattern: str) -> DataFrame:
    """Pattern search in the shortened body."""
    return emails.where(preview(F.col("body")).rlike(pattern))


def regex_on_body(emails: DataFrame, pattern: str) -> DataFrame:
    return emails.where(or_empty(F.col("body")).rlike(pattern))


def keywords(query: str) -> list[str]:
    return query.lower().split()


def keyword_match(words: list[str]) -> Column:
    """Each word in the subject or in the body; ``%`` and ``_`` are wildcards."""
    match = F.lit(True)
    for word in words:
        pattern = "%" + re.sub(r"\\", r"\\\\", word) + "%"
        match = match & (
            F.lower(or_empty(F.col("subject"))).like(pattern) | F.lower(or_empty(F.col("body"))).like(pattern)
        )
    return match


def uid_in(emails: DataFrame, uids: DataFrame) -> DataFrame:
    """Messages whose uid is in the given column of uids, however often."""
    return emails.join(uids.select("uid").distinct(), "uid", "left_semi")
