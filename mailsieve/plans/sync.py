"""Mailbox sync: raw messages in, new state out."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mailsieve.operators.ingest import accepted, ingest, observed
from mailsieve.operators.store import EPOCH_KEY, LAST_FETCH_KEY, epoch_changed, kv_set, latest, upsert
from mailsieve.operators.vectors import Embedder, embed_new, hashing_embedder
from mailsieve.schema import LOAD_SCHEMA
from mailsieve.session import remove, work_folder
from mailsieve.sources import versions
from mailsieve.sources.tables import (
    read_emails,
    read_kv,
    read_table,
    read_vectors,
    write_emails,
    write_kv,
    write_vectors,
)


@dataclass(frozen=True)
class State:
    emails: DataFrame
    vectors: DataFrame
    kv: DataFrame


def apply(raw: DataFrame, valid: DataFrame, state: State, now: str, embedder: Embedder) -> State:
    """New state from raw mail and the accepted part of it; all lazy.

    Of a load only the newest epoch counts, and of several messages with one uid
    the one of the largest ``seq``; that one is stored and embedded. A changed epoch
    drops the old mail and vectors. Without a valid message the fetch time stays as
    it was.
    """
    epoch = epoch_changed(state.kv, raw)
    stale = epoch.select("changed").scalar()
    loaded = epoch.select("current").scalar()
    newest = latest(valid.where(loaded.isNull() | (F.col("uidvalidity") == loaded)), "uid", ["seq"]).drop("seq")
    emails = upsert(state.emails.where(~stale), newest, "uid", [])
    kept = state.vectors.where(~stale).select("uid", "embedding")
    vectors = kept.unionByName(embed_new(newest, kept, embedder))

    current = epoch.select(F.coalesce("current", "previous").cast("string").alias("value"))
    kv = kv_set(state.kv, EPOCH_KEY, current.scalar())
    stamp = kv_set(kv, LAST_FETCH_KEY, now)
    any_valid = newest.exists()
    kv = stamp.where(any_valid).unionByName(kv.where(~any_valid)).where(F.col("value").isNotNull())
    return State(emails, vectors, kv)


def sync(raw: DataFrame, state: State, now: str, embedder: Embedder | None = None) -> State:
    """Sync as one lazy plan."""
    return apply(_ordered(raw), accepted(ingest(raw)), state, now, embedder or hashing_embedder())


def _ordered(raw: DataFrame) -> DataFrame:
    if "seq" not in raw.columns:
        raise ValueError("raw mail needs a column seq that orders the messages of a load")
    return raw


def read_state(spark: SparkSession, folder: str, first_run: bool = False) -> State:
    """The stored state; on a first run it is empty if nothing is stored."""
    return State(
        read_emails(spark, f"{folder}/emails", first_run),
        read_vectors(spark, f"{folder}/vectors", first_run),
        read_kv(spark, f"{folder}/kv", first_run),
    )


def run_sync(
    spark: SparkSession, raw: DataFrame, state: State, folder: str, now: str, embedder: Embedder | None = None
) -> State:
    """Sync from ``state`` to a new state, written below a new folder.

    Ingest runs once: its result is staged in the shared folder and read by
    all three writes. No path is overwritten while it is read, and a run that
    failed leaves the old state as it was.
    """
    staged = work_folder(spark, "sync")
    accepted(ingest(_ordered(raw))).write.parquet(staged)
    valid = read_table(spark, staged, LOAD_SCHEMA)
    new = apply(raw, valid, state, now, embedder or hashing_embedder())
    write_emails(new.emails, f"{folder}/emails")
    write_vectors(new.vectors, f"{folder}/vectors")
    write_kv(new.kv, f"{folder}/kv")
    remove(spark, staged)
    return read_state(spark, folder)


def read_versioned(spark: SparkSession, folder: str, version: int | None = None) -> State:
    """The state of a versioned folder; the newest version by default."""
    manifest = versions.read_manifest(spark, folder, version)
    return State(
        versions.read_table(spark, manifest, "emails"),
        versions.read_table(spark, manifest, "vectors"),
        versions.entries(spark, manifest),
    )


def sync_changes(
    spark: SparkSession, raw: DataFrame, folder: str, now: str, embedder: Embedder | None = None,
    batch: tuple[str, int] | None = None, counts: Observation | None = None,
) -> versions.Manifest:
    """Sync a versioned folder: the same state as ``run_sync``, but only changes are written.

    ``batch`` names a stream and the number of its batch. A batch that was committed
    is not applied again, and mail, vectors and entries of one become visible at once.
    ``counts`` is given the messages that were found, processed and skipped.
    """
    parent = versions.read_manifest(spark, folder)
    if batch is not None and parent.batches.get(batch[0], -1) >= batch[1]:
        return parent
    staged, ingested = work_folder(spark, "sync"), ingest(_ordered(raw))
    accepted(ingested if counts is None else observed(ingested, counts)).write.parquet(staged)
    valid = read_table(spark, staged, LOAD_SCHEMA)
    loaded = raw.agg(F.max("uidvalidity")).first()[0]
    known = parent.entries.get(EPOCH_KEY, "")
    stored = int(known) if known.removeprefix("-").isdigit() else None
    reset = tuple(versions.SCHEMAS) if None not in (loaded, stored) and loaded != stored else ()
    current = valid if loaded is None else valid.where(F.col("uidvalidity") == loaded)
    newest = latest(current, "uid", ["seq"]).drop("seq")

    # Only buckets that the load touches are asked for vectors.
    kept = versions.read_table(spark, versions.Manifest(), "vectors")
    if not reset:
        bucket = versions.bucket_of(F.col("uid"), parent.buckets)
        touched = [r[0] for r in current.select(bucket).distinct().collect()]
        kept = versions.read_table(spark, parent, "vectors", touched)
    added = embed_new(newest, kept, embedder or hashing_embedder())
    entries = dict(parent.entries)
    epoch = loaded if loaded is not None else stored
    entries.pop(EPOCH_KEY, None)
    if epoch is not None:
        entries[EPOCH_KEY] = str(epoch)
    if not current.isEmpty():
        entries[LAST_FETCH_KEY] = now
    done = versions.commit(spark, folder, parent, {"emails": newest, "vectors": added}, entries, reset, batch)
    remove(spark, staged)
    return done


def rebuild_vectors(spark: SparkSession, folder: str, embedder: Embedder | None = None) -> versions.Manifest:
    """Clear the stored vectors and embed the stored mail anew, as two versions."""
    cleared = versions.cleared(spark, folder, ["vectors"])
    emails = versions.read_table(spark, cleared, "emails")
    none = versions.read_table(spark, cleared, "vectors")
    added = embed_new(emails, none, embedder or hashing_embedder())
    return versions.commit(spark, folder, cleared, {"vectors": added}, cleared.entries)
