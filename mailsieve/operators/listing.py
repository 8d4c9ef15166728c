"""Listing, lookup and views for readers."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions import display


def newest(emails: DataFrame, limit: int | None = None) -> DataFrame:
    """uid, subject, sender and date, newest first; ties by uid."""
    rows = emails.select("uid", "subject", "sender", "date").orderBy(
        F.col("date").desc_nulls_last(), "uid"
    )
    return rows if limit is None else rows.limit(limit)


def list_columns(emails: DataFrame) -> DataFrame:
    """Every message in the display form of the list."""
    return emails.select(
        "uid",
        display.cut(F.col("subject"), 50).alias("subject"),
        display.cut(F.col("sender"), 30).alias("sender"),
        display.day(F.col("date")).alias("date"),
    )


def list_view(emails: DataFrame, limit: int = 50) -> DataFrame:
    """The first rows of the list in display form, with the size of the whole."""
    total = emails.agg(F.count(F.lit(1)).alias("n")).scalar()
    return list_columns(newest(emails, limit)).withColumn("total", total)


def get_email(emails: DataFrame, uid: str) -> DataFrame:
    """The message with this uid, or no row."""
    return emails.where(F.col("uid") == uid)


def rendered(emails: DataFrame) -> DataFrame:
    """Every message as one block of text."""
    return emails.select("uid", display.render(*map(F.col, ("uid", "subject", "sender", "date", "body"))).alias("text"))


def result_view(hits: DataFrame, limit: int = 10, full_body: bool = False) -> DataFrame:
    """Numbered search results. Cut to ``limit`` first, so the rank is over few rows."""
    by_score = (F.col("similarity_score").desc(), F.col("uid"))
    top = hits.orderBy(*by_score).limit(limit)
    return top.select(
        F.row_number().over(Window.orderBy(*by_score)).alias("rank"),
        "uid",
        "subject",
        "sender",
        display.day(F.col("date")).alias("date"),
        F.round("similarity_score", 3).alias("similarity"),
        F.col("full_body" if full_body else "body_preview").alias("text"),
    )
