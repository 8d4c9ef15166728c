"""Keyword search over an index of character trigrams.

A message is posted under every three characters in a row of its lower-cased subject
or body. A keyword, or each literal piece of one with wildcards, can only be in a
message that has all of its trigrams; the rarest of them name the candidates, and
only candidates are read and matched. Rows are the same as without the index.

The postings are lists of uids, some of a trigram in each row, laid out by a hash of the
trigram and sorted by it, the mail by a hash of the uid and sorted by that, so both are
read in a few folders and row groups.
"""

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.functions.patterns import or_empty
from mailsieve.operators import filters
from mailsieve.sources.versions import bucket_of

GRAM = 3
BUCKETS = 64
#: Postings that are intersected, rarest first; more would hardly leave out more.
RAREST = 6
#: Candidates whose uids are pushed into the scan; more are joined.
PUSHED = 1000
#: Postings a task holds before it writes them, at least, unless its batch ends.
HELD = 2_000_000
#: Characters of a text that are read at once.
PIECE = 1 << 20


@dataclass(frozen=True)
class PostingIndex:
    """Stored below one folder: mail, postings (gram, uid) and sizes (gram, messages)."""

    path: str
    buckets: int = BUCKETS

    def mail(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/mail")

    def postings(self, spark: SparkSession) -> DataFrame:
        lists = spark.read.parquet(f"{self.path}/postings")
        return lists.select("gram", F.explode("uids").alias("uid"), "part")

    def sizes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/sizes")


def _packed(text: str) -> np.ndarray:
    """Every three characters in a row as one number, each once, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(codes) < GRAM:
        return codes[:0]
    return np.unique(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:])


def _own(texts: Iterable[bytes]) -> np.ndarray:
    """The trigrams of a message; long texts are read piece by piece."""
    found = [_packed("")]
    for text in (t.decode("utf-8", "replace") for t in texts):
        found += [_packed(text[i : i + PIECE + GRAM - 1]) for i in range(0, len(text), PIECE)]
    return np.unique(np.concatenate(found))


def _inverted(uids: pa.Array, owners: list[int], own: list[np.ndarray]) -> pa.RecordBatch:
    """One row a trigram, with the uids of its messages."""
    keys = np.concatenate(own)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], np.repeat(owners, [len(k) for k in own])[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    grams = keys[starts]
    low = np.uint64((1 << 21) - 1)
    text = np.stack([grams >> np.uint64(42), grams >> np.uint64(21) & low, grams & low], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    named = pa.array([text[i : i + GRAM] for i in range(0, len(text), GRAM)], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), uids.take(pa.array(owner)))
    return pa.RecordBatch.from_arrays([named, lists], ["gram", "uids"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages (uid, subject, body), lower-cased, to trigrams with the uids of some messages."""
    for batch in batches:
        subjects, bodies = (batch.column(c).cast(pa.binary()) for c in ("subject", "body"))
        owners, own, held = [], [], 0
        for at in range(batch.num_rows):
            keys = _own((subjects[at].as_py(), bodies[at].as_py()))
            if len(keys):
                owners.append(at)
                own.append(keys)
                held += len(keys)
            if held >= HELD or (held and at == batch.num_rows - 1):
                yield _inverted(batch.column("uid"), owners, own)
                owners, own, held = [], [], 0


def literal_grams(words: list[str]) -> set[str]:
    """The trigrams that a match of all words must have."""
    pieces = [piece for word in words for piece in re.split("[%_]", word)]
    return {piece[i : i + GRAM] for piece in pieces for i in range(len(piece) - GRAM + 1)}


def build_index(mail: DataFrame, path: str, buckets: int = BUCKETS) -> PostingIndex:
    """Store mail, its postings and their sizes below ``path``.

    A message is listed once under each trigram. A task lists many messages in one row,
    so what is shuffled and sorted are lists; a trigram that most messages have is split
    among files.
    """
    spark, index = mail.sparkSession, PostingIndex(path, buckets)
    laid = mail.withColumn("bucket", bucket_of(F.col("uid"), buckets)).hint("rebalance", "bucket")
    laid.sortWithinPartitions("bucket", "uid").write.partitionBy("bucket").option(
        "parquet.bloom.filter.enabled#uid", "true"
    ).parquet(f"{path}/mail")
    lowered = index.mail(spark).select("uid", *(F.lower(or_empty(F.col(c))).alias(c) for c in ("subject", "body")))
    lists = lowered.mapInArrow(_postings, f"gram string, uids array<{mail.schema['uid'].dataType.simpleString()}>")
    lists = lists.withColumn("part", bucket_of(F.col("gram"), buckets)).hint("rebalance", "part")
    lists.sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/postings")
    counted = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum(F.size("uids")).alias("messages"))
    counted.sortWithinPartitions("gram").write.parquet(f"{path}/sizes")
    return index


def rarest(spark: SparkSession, index: PostingIndex, needed: set[str]) -> list[tuple[str, int]]:
    """Of the needed trigrams, the rarest and their sizes; as few as the query is long."""
    found = dict(index.sizes(spark).where(F.col("gram").isin(sorted(needed))).collect())
    return sorted(((g, found.get(g, 0)) for g in needed), key=lambda pair: (pair[1], pair[0]))[:RAREST]


def candidates(spark: SparkSession, index: PostingIndex, words: list[str]) -> DataFrame | None:
    """The uids that may match all words; null if the words are too short to tell."""
    needed = literal_grams(words)
    if not needed:
        return None
    chosen = [gram for gram, _ in rarest(spark, index, needed)]
    postings = index.postings(spark)
    parts = [r[0] for r in spark.createDataFrame([(g,) for g in chosen], "g string").select(bucket_of(F.col("g"), index.buckets)).distinct().collect()]
    held = postings.where(F.col("part").isin(parts) & F.col("gram").isin(chosen))
    # A uid is posted once under a trigram, so counting is enough.
    return held.groupBy("uid").agg(F.count("*").alias("n")).where(F.col("n") == len(chosen)).select("uid")


def narrowed(spark: SparkSession, index: PostingIndex, words: list[str]) -> DataFrame:
    """The stored mail, without messages that can't match all words.

    Few candidates are pushed into the scan by uid and bucket; more are joined.
    """
    mail, found = index.mail(spark), candidates(spark, index, words)
    if found is None:
        return mail.drop("bucket")
    few = found.withColumn("bucket", bucket_of(F.col("uid"), index.buckets)).limit(PUSHED + 1).collect()
    if len(few) > PUSHED:
        return mail.drop("bucket").join(found, "uid", "left_semi")
    buckets, uids = sorted({r.bucket for r in few}), sorted(r.uid for r in few)
    return mail.where(F.col("bucket").isin(buckets) & F.col("uid").isin(uids)).drop("bucket")


def keyword_rows(spark: SparkSession, index: PostingIndex, query: str) -> DataFrame:
    """All messages that match all words, as ``filters.keyword_match`` finds them."""
    words = filters.keywords(query)
    return narrowed(spark, index, words).where(filters.keyword_match(words))
