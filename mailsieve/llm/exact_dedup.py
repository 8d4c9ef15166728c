"""Operator 1, exact dedup: rows of equal text, found by a 128-bit content hash.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Rows are grouped by content hash *and* text, so bytes are compared inside every
hash group, and a group of copies is one row per task before anything is
shuffled. Rows then look their group up by hash alone. Only where two texts
share a hash do their rows look it up by hash and text.

Defined results: of equal texts the row with the largest id stays; rows that
repeat an id and its text are kept or dropped together; rows without an id are
never kept, unless no row of their group has one. An empty table gives an empty
result. Other columns of the input are not read, whatever their names.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import ascii_lower, stage


def content_hash(text: Column) -> Column:
    """128 bits as binary."""
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(
        F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("body")
    ).withColumn("hash", hash_of(F.col("body")))
    texts = rows.groupBy("hash", "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    by_hash = texts.groupBy("hash").agg(
        F.count("*").alias("n_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    )
    shared = stage(by_hash.filter("n_texts > 1 or group_size > 1"), "exact-groups")
    members = rows.withColumn("text_sha256", F.sha2("body", 256))
    clean = shared.filter("n_texts = 1").drop("n_texts")
    clashing = shared.filter("n_texts > 1").select("hash")
    if clashing.isEmpty():
        found = members.drop("body").join(clean, "hash", "left")
    else:
        apart = texts.join(clashing, "hash", "left_semi")
        groups = clean.withColumn("own", F.lit(None).cast("string")).unionByName(
            apart.withColumnRenamed("body", "own")
        )
        found = members.join(groups, "hash", "left").filter("own is null or own = body")
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(F.coalesce("keep_id", "id")).alias("kept"),
        "text_sha256",
    )
