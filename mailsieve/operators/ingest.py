"""Raw messages -> cleaned, validated mail."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mailsieve.functions import headers, mime, quality, text
from mailsieve.functions.dates import parse_mail_date
from mailsieve.operators.parse import parse_messages
from mailsieve.operators.stage import built, settle

UNREADABLE = "unreadable"


def _texts() -> dict[str, Column]:
    return {
        "_unreadable": mime.unreadable(F.col("parts")),
        "_plain": mime.plain_text(F.col("parts")),
        "_html": mime.html_text(F.col("parts")),
    }


def _decoded() -> list[Column]:
    return _chosen(mime.decode_words)


def _chosen(read=lambda value: value) -> list[Column]:
    unreadable = F.col("_unreadable")
    subject = text.clean_subject(read(headers.header(F.col("headers"), "Subject")))
    return [
        F.when(unreadable, "").otherwise(subject).alias("subject"),
        F.when(unreadable, "").otherwise(text.clean_body(F.col("_chosen"))).alias("body"),
    ]


def _reason() -> Column:
    return F.when(F.col("_unreadable"), UNREADABLE).otherwise(
        quality.reject_reason(F.col("subject"), F.col("body"))
    )


def _record() -> list[Column]:
    date_header = headers.header(F.col("headers"), "Date")
    return [
        F.col("subject"),
        headers.header(F.col("headers"), "From").alias("sender"),
        parse_mail_date(date_header).alias("date"),
        date_header.alias("date_header"),
        F.col("body"),
        text.search_text(F.col("subject"), F.col("body")).alias("search_content"),
        F.col("reject_reason"),
    ]


def _choice() -> Column:
    return mime.choose_body(F.col("_plain"), F.col("_html"))


def ingest(raw: DataFrame, decode_encoded_words: bool = False) -> DataFrame:
    """Parse, clean and check every message; nothing is dropped here.

    ``reject_reason`` is null for the messages to keep; a column ``seq`` is passed
    by. No shuffle: each message is read and decided on in place. Encoded words of
    subjects stay as they are, unless they are to be decoded.
    """
    order = [c for c in raw.columns if c == "seq"]
    chosen = (
        parse_messages(raw)
        .withColumns(built(raw, _texts))
        .withColumn("_chosen", built(raw, _choice))
        .select("uid", "uidvalidity", *order, "headers", "_unreadable", *built(raw, _decoded if decode_encoded_words else _chosen))
    )
    decided = chosen.withColumn("reject_reason", built(raw, _reason))
    return settle(decided.drop("_unreadable")).select("uid", "uidvalidity", *built(raw, _record), *order)


def accepted(ingested: DataFrame) -> DataFrame:
    """The valid messages, in the layout of the emails table (and ``seq``, if it is there)."""
    return ingested.where(F.col("reject_reason").isNull()).drop("reject_reason")


def observed(ingested: DataFrame, observation: Observation) -> DataFrame:
    """The same rows; once they are written, ``observation`` holds the counts of
    ``ingest_counts``, without a second pass."""
    valid = F.col("reject_reason").isNull()
    return ingested.observe(
        observation, F.count(F.lit(1)).alias("found"), F.count_if(valid).alias("processed"),
        F.count_if(~valid).alias("skipped"),
    )


def ingest_counts(ingested: DataFrame) -> DataFrame:
    """Found, processed and skipped messages as one row."""
    valid = F.col("reject_reason").isNull()
    return ingested.agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(valid).alias("processed"),
        F.count_if(~valid).alias("skipped"),
    )


def reject_counts(ingested: DataFrame) -> DataFrame:
    """Number of messages per reason; valid ones count as ``accepted``."""
    reason = F.coalesce(F.col("reject_reason"), F.lit("accepted"))
    return ingested.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("messages"))
