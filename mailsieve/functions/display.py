"""Columns as they are shown to a reader."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.patterns import or_empty


def cut(c: Column, n: int) -> Column:
    """At most ``n`` characters, with an ellipsis if something was cut."""
    c = or_empty(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def preview(body: Column, n: int = 200) -> Column:
    return cut(body, n)


def day(date: Column) -> Column:
    """Ten-character date, ``N/A`` if there is none."""
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("N/A"))


def render(uid: Column, subject: Column, sender: Column, date: Column, body: Column) -> Column:
    """One message as a block of text.

    The layout and the defaults for missing values are fixed values.
    """
    return F.concat(
        F.lit("\nSubject: "), F.coalesce(subject, F.lit("No Subject")),
        F.lit("\nFrom: "), F.coalesce(sender, F.lit("Unknown Sender")),
        F.lit("\nDate: "), F.coalesce(date.cast("string"), F.lit("Unknown Date")),
        F.lit("\nUID: "), F.coalesce(uid, F.lit("Unknown UID")),
        F.lit("\n\n"), cut(body, 1000),
        F.lit("\n    "),
    )
