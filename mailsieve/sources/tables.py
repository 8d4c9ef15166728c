"""Stored tables: raw mail, emails, key/value entries and vectors."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.operators.filters import date_after, date_before, day_start
from mailsieve.schema import EMAILS_SCHEMA, KV_SCHEMA, RAW_SCHEMA, VECTORS_SCHEMA


def read_table(spark: SparkSession, path: str, schema: T.StructType, first_run: bool = False) -> DataFrame:
    """A parquet table. Only on a first run one that was never written is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if not first_run or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_raw(
    spark: SparkSession, path: str, fmt: str = "parquet", uidvalidity: int | None = None, first_run: bool = False
) -> DataFrame:
    """Raw messages: a parquet table, or a folder of ``.eml`` files.

    For files the uid is the file name without its ending, and the epoch is
    given by the caller. Partitions of the scan take the place of batches.
    """
    if fmt == "parquet":
        return read_table(spark, path, RAW_SCHEMA, first_run)
    if fmt != "eml":
        raise ValueError(f"unknown raw mail format: {fmt}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]*)\.eml$", 1).alias("uid"),
        F.lit(uidvalidity).cast("bigint").alias("uidvalidity"),
        F.col("content").alias("raw"),
        F.unix_micros("modificationTime").alias("seq"),
    )


def read_emails(spark: SparkSession, path: str, first_run: bool = False) -> DataFrame:
    return read_table(spark, path, EMAILS_SCHEMA, first_run)


def read_kv(spark: SparkSession, path: str, first_run: bool = False) -> DataFrame:
    return read_table(spark, path, KV_SCHEMA, first_run)


def read_vectors(spark: SparkSession, path: str, first_run: bool = False) -> DataFrame:
    return read_table(spark, path, VECTORS_SCHEMA, first_run)


def write_emails(emails: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Written where the rows are, with Bloom filters on the uid.

    A lookup skips the row groups that cannot hold its uid, and no shuffle or
    sort of the bodies is needed for that.
    """
    emails.write.mode(mode).option("parquet.bloom.filter.enabled#uid", "true").parquet(path)


def write_emails_by_month(emails: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Emails in one folder per month of their date, sorted by uid inside each file.

    A search by date opens the folders of its months only, and a lookup the row groups
    whose range and Bloom filter of uids admit it. Mail without a date has a folder
    of its own. Big months are split among files, small ones share a task.
    """
    laid = emails.withColumn("month", F.date_format("date", "yyyy-MM")).hint("rebalance", "month")
    laid.sortWithinPartitions("month", "uid").write.mode(mode).option(
        "parquet.bloom.filter.enabled#uid", "true"
    ).partitionBy("month").parquet(path)


def read_emails_by_month(
    spark: SparkSession, path: str, after: str | None = None, before: str | None = None
) -> DataFrame:
    """The emails of a table laid out by month; with bounds, those on or after and before
    or at them, which are ISO dates or times."""
    stored = read_table(spark, path, T.StructType([*EMAILS_SCHEMA.fields, T.StructField("month", T.StringType())]))
    if after is not None:
        stored = date_after(stored.where(F.col("month") >= _month(after)), after)
    if before is not None:
        stored = date_before(stored.where(F.col("month") <= _month(before)), before)
    return stored.drop("month")


def _month(bound: str) -> Column:
    return F.date_format(day_start(bound), "yyyy-MM")


def write_kv(kv: DataFrame, path: str, mode: str = "errorifexists") -> None:
    kv.coalesce(1).write.mode(mode).parquet(path)


def write_vectors(vectors: DataFrame, path: str, mode: str = "append") -> None:
    vectors.select("uid", "embedding").write.mode(mode).parquet(path)
