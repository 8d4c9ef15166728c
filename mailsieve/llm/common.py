"""What the operators share: reading a table, staged tables, ASCII lower case."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.session import shared_folder, work_folder

BATCH_BYTES = 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Cuts the lineage with files every executor can read, so that nothing is
    computed twice and a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = work_folder(spark, f"llm-{spark.sparkContext.applicationId}-{purpose}")
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def small_batches(df: DataFrame) -> DataFrame:
    """The same table; texts reach Python in batches of at most ``BATCH_BYTES``.

    The setting is lowered for the session, never raised: what a task holds of long
    texts, and of what is made from them, is a multiple of it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    in_bytes = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if in_bytes(conf.get(key)) > BATCH_BYTES:
        conf.set(key, BATCH_BYTES)
    return df


def unstage(staged: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    _delete(staged.sparkSession, staged.staged_path)


def _delete(spark: SparkSession, glob: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.globStatus(path) or []:
        files.delete(status.getPath(), True)


def clear(spark: SparkSession) -> None:
    """Remove the staged tables of this application, once its results are written."""
    _delete(spark, f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}-*")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null stays null.

    Texts of one byte per character take the vectorised path, where lower-casing
    touches no other letter.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
