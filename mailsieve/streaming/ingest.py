"""Incremental sync with Structured Streaming.

Each micro-batch is cleaned and added to a change table below one folder per
batch. A repeated batch overwrites its own folder, so a restart changes
nothing. Writing costs what the batch holds; the current mail is the newest
change per uid within the newest epoch, resolved when it is read.
"""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mailsieve.operators.ingest import accepted, ingest
from mailsieve.operators.store import latest
from mailsieve.operators.vectors import Embedder
from mailsieve.plans.sync import sync_changes
from mailsieve.schema import LOAD_SCHEMA
from mailsieve.sources.tables import read_table

CHANGES_SCHEMA = T.StructType([*LOAD_SCHEMA.fields, T.StructField("batch_id", T.LongType())])


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int = 1000
) -> DataFrame:
    """Stream of a growing parquet folder (or of one file).

    The braces make the path a pattern, which may also name a single file.
    """
    folder, name = path.rstrip("/").rsplit("/", 1)
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(f"{folder}/{{{name}}}")
    )


def stream_sync(raw: DataFrame, folder: str) -> StreamingQuery:
    """Clean what has arrived and add it to the change table in ``folder``."""

    def add(batch: DataFrame, batch_id: int) -> None:
        changes = accepted(ingest(batch))
        changes.write.mode("overwrite").parquet(f"{folder}/changes/batch_id={batch_id}")

    return (
        raw.writeStream.foreachBatch(add)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, f"{folder}/changes", CHANGES_SCHEMA)


def current_emails(spark: SparkSession, folder: str) -> DataFrame:
    """Newest change of each uid, of the epoch that came last.

    A mailbox may be given a lower epoch than it had, or one that it had before; the
    newest batch decides, and mail from before the last other epoch doesn't count.
    """
    changes = read_changes(spark, folder)
    last = changes.where(F.col("uidvalidity").isNotNull()).agg(
        F.max(F.struct("batch_id", "uidvalidity"))["uidvalidity"].alias("epoch")
    )
    other = changes.where(F.col("uidvalidity") != last.scalar()).agg(
        F.coalesce(F.max("batch_id"), F.lit(-1)).alias("batch_id")
    )
    valid = changes.where((F.col("uidvalidity") == last.scalar()) & (F.col("batch_id") >= other.scalar()))
    return latest(valid, "uid", ["batch_id", "seq"]).drop("batch_id", "seq")


def stream_state(
    raw: DataFrame, folder: str, now: str, embedder: Embedder | None = None, name: str = "mail"
) -> StreamingQuery:
    """Keep a versioned state of mail, vectors and entries from a stream.

    Each micro-batch is one commit that carries its number. A batch that ended before
    its commit leaves nothing to see; one that is repeated after it is passed over.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        sync_changes(batch.sparkSession, batch, f"{folder}/state", now, embedder, (name, batch_id))

    return (
        raw.writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def _observed(batches):
    """The epochs each batch of rows holds, once per mailbox."""
    for batch in batches:
        yield batch.dropna(subset=["uidvalidity"]).drop_duplicates()


def _turn(key: tuple, rows, state):
    """A new turn begins where the newest epoch of a batch isn't the one of the turn before."""
    newest = max((int(frame["uidvalidity"].max()) for frame in rows if len(frame)), default=None)
    epoch, turn = state.get if state.exists else (None, 0)
    if newest is not None and newest != epoch:
        state.update((newest, turn + 1))
        yield pd.DataFrame({"mailbox": [key[0]], "uidvalidity": [newest], "turn": [turn + 1]})


def epoch_turns(raw: DataFrame) -> DataFrame:
    """(mailbox, uidvalidity, turn) whenever a mailbox gets another epoch than it had.

    The epoch of every mailbox and the number of its turn are kept in the state store.
    What reaches it is one row per mailbox and epoch of each batch of rows.
    """
    observed = raw.select("mailbox", "uidvalidity").mapInPandas(_observed, "mailbox string, uidvalidity bigint")
    return observed.groupBy("mailbox").applyInPandasWithState(
        _turn, "mailbox string, uidvalidity bigint, turn bigint", "epoch bigint, turn bigint", "update", "NoTimeout"
    )


def stream_turns(raw: DataFrame, folder: str) -> StreamingQuery:
    """Clean the mail of several mailboxes (column ``mailbox``) and log it with their epochs.

    Mail and turns of a micro-batch are written together, below the folder of the batch.
    """
    mail = accepted(ingest(raw.withColumn("uid", F.to_json(F.struct("mailbox", "uid")))))
    own = F.from_json("uid", "mailbox string, uid string")
    cleaned = mail.withColumn("own", own).withColumns({"mailbox": F.col("own.mailbox"), "uid": F.col("own.uid")}).drop("own")
    rows = cleaned.withColumn("kind", F.lit("mail"))
    both = rows.unionByName(epoch_turns(raw).withColumn("kind", F.lit("turn")), allowMissingColumns=True)

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/log/batch_id={batch_id}")

    return (
        both.writeStream.foreachBatch(add)
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def turn_emails(spark: SparkSession, folder: str) -> DataFrame:
    """The current mail of each mailbox: the newest change per uid since its last turn.

    Turns are a few rows a mailbox, in files of their own. No batch before the oldest
    last turn is read, and mail of other epochs is nowhere looked at.
    """
    schema = T.StructType(
        [*LOAD_SCHEMA.fields, *(T.StructField(n, T.StringType()) for n in ("mailbox", "kind")),
         *(T.StructField(n, T.LongType()) for n in ("turn", "batch_id"))]
    )
    log = read_table(spark, f"{folder}/log", schema)
    last = log.where("kind = 'turn'").groupBy("mailbox").agg(
        F.max(F.struct("turn", "batch_id", "uidvalidity")).alias("last")
    ).select("mailbox", F.col("last.uidvalidity").alias("uidvalidity"), F.col("last.batch_id").alias("since"))
    oldest = last.agg(F.min("since")).scalar()
    mail = log.where((F.col("kind") == "mail") & (F.col("batch_id") >= oldest)).drop("kind", "turn")
    valid = mail.join(last, ["mailbox", "uidvalidity"]).where("batch_id >= since").drop("since")
    order = F.struct("batch_id", "seq")
    newest = valid.groupBy("mailbox", "uid").agg(F.max(order).alias("newest"))
    kept = valid.withColumn("newest", order).join(newest, ["mailbox", "uid", "newest"], "left_semi")
    return kept.drop("newest", "batch_id", "seq")


def first_seen(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First row of each key in a stream.

    With an event time the remembered keys expire after ``delay``; without one
    all keys are remembered.
    """
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
