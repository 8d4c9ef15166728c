"""Status of the mail table and its vector index."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.operators.store import LAST_FETCH_KEY, kv_get


def status(emails: DataFrame, vectors: DataFrame, kv: DataFrame) -> DataFrame:
    """One row: sizes, date range, last fetch and the derived flags."""
    n_vectors = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        emails.agg(
            F.count(F.lit(1)).alias("emails"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
        .withColumn("vectors", n_vectors)
        .withColumn("last_fetch", kv_get(kv, LAST_FETCH_KEY).scalar())
        .withColumn("in_sync", F.col("emails") == F.col("vectors"))
        .withColumn("offline_available", (F.col("emails") > 0) & (F.col("vectors") > 0))
    )


def status_rows(emails: DataFrame, vectors: DataFrame, kv: DataFrame) -> DataFrame:
    """The report as component, status and details.

    The texts are fixed values.
    """
    one = status(emails, vectors, kv)
    line = lambda component, state, details: F.struct(
        F.lit(component).alias("component"), state.alias("status"), details.alias("details")
    )
    date_range = F.concat(
        F.lit("Range: "), F.col("first_date").cast("string"), F.lit(" to "), F.col("last_date").cast("string")
    )
    in_sync = F.col("in_sync")
    lines = F.array(
        line(
            "Database",
            F.concat(F.col("emails").cast("string"), F.lit(" emails")),
            F.coalesce(date_range, F.lit("No emails")),
        ),
        line(
            "Vector Index",
            F.concat(F.col("vectors").cast("string"), F.lit(" embeddings")),
            F.lit("Stored by uid"),
        ),
        line("Last Sync", F.col("last_fetch"), F.lit("Run a sync to update")),
        line(
            "Index Status",
            F.when(in_sync, "Up to date").otherwise("Out of sync"),
            F.when(in_sync, "All emails are indexed").otherwise("Run a sync to rebuild index"),
        ),
    )
    return one.select(F.inline(lines))


def index_drift(emails: DataFrame, vectors: DataFrame) -> DataFrame:
    """Uids that are only in one of the two tables."""
    mail = emails.select("uid", F.lit(True).alias("has_mail"))
    index = vectors.select("uid", F.lit(True).alias("has_vector"))
    state = F.when(F.col("has_vector").isNull(), "missing vector").when(
        F.col("has_mail").isNull(), "orphan vector"
    )
    return (
        mail.join(index, "uid", "full_outer")
        .select("uid", state.alias("state"))
        .where(F.col("state").isNotNull())
    )
