"""Keyed state: upserts, key/value entries, mailbox epochs."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPOCH_KEY = "uidvalidity"
LAST_FETCH_KEY = "last_fetch"


def latest(log: DataFrame, key: str, seq: Sequence[str]) -> DataFrame:
    """Newest row of each key.

    A maximum over structs is combined before the shuffle, so a key that holds
    a large part of all rows reaches its reducer as one row per map task. All
    columns take part in the comparison: equal ``seq`` values still give one
    fixed answer.
    """
    order = [*seq, *(c for c in log.columns if c != key and c not in seq)]
    newest = log.groupBy(key).agg(F.max(F.struct(*order)).alias("_row"))
    return newest.select(*(F.col(key) if c == key else F.col(f"_row.{c}") for c in log.columns))


def upsert(base: DataFrame, changes: DataFrame, key: str, seq: Sequence[str]) -> DataFrame:
    """Replace whole rows of ``base`` by the newest change of the same key.

    The base is only anti-joined on the changed keys and never regrouped, so a
    small batch of changes is broadcast (if Spark measures it as small) and the
    base is not shuffled. ``seq`` columns order the changes and are not stored.
    """
    newest = latest(changes, key, seq).select(*base.columns)
    changed = changes.select(key).distinct()
    return base.join(changed, key, "left_anti").select(*base.columns).unionByName(newest)


def cleared(table: DataFrame) -> DataFrame:
    """The same table without rows."""
    return table.where(F.lit(False))


def kv_set(kv: DataFrame, key: str, value) -> DataFrame:
    """Set one entry; ``value`` is a string or a string column expression."""
    entry = kv.sparkSession.range(1).select(
        F.lit(key).alias("key"), (value if not isinstance(value, str) else F.lit(value)).alias("value")
    )
    return kv.where(F.col("key") != key).unionByName(entry)


def kv_get(kv: DataFrame, key: str, default: str | None = "Never") -> DataFrame:
    """Always one row: the value, or the default if the key is absent."""
    return kv.agg(
        F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(default)).alias("value")
    )


def last_epoch(kv: DataFrame) -> DataFrame:
    """Stored epoch as one row; null if absent or unreadable."""
    return kv_get(kv, EPOCH_KEY, None).select(F.col("value").try_cast("bigint").alias("epoch"))


def epoch_changed(kv: DataFrame, current: DataFrame) -> DataFrame:
    """Compare the stored epoch with the newest one in ``current.uidvalidity``.

    A first run and an unknown current epoch are no change.
    """
    return current.agg(F.max("uidvalidity").alias("current")).select(
        last_epoch(kv).scalar().alias("previous"), "current"
    ).select(
        "previous",
        "current",
        F.coalesce(F.col("previous") != F.col("current"), F.lit(False)).alias("changed"),
    )


def current_epoch(table: DataFrame) -> DataFrame:
    """Rows of the newest epoch only; older ones are invalid."""
    newest = table.agg(F.max("uidvalidity").alias("newest"))
    return table.where(F.col("uidvalidity") == newest.scalar())
