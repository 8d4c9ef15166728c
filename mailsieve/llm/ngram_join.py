"""Operator 7, n-gram Jaccard join by filters under several global token orders.

A text's tokens are its distinct shingles of five words (lower-cased A-Z; words
are separated by ASCII white space; with fewer words the whole sequence is one
shingle). Texts link when their sets have a Jaccard similarity of 0.75 or more.
If two sets of similarity t are sorted by any order common to all sets, the first
n - ceil(t n) + 1 tokens of each have a token in common. All orders used here are
by the number of sets that hold a token, rarest first; they differ in how equally
frequent tokens are ranked. A pair is verified only if it shares prefix tokens
under each of them.

The first common token of a pair also says, by its place, how many common ones
there can be at most; pairs for which these are too few are not made.

1. One scan hashes the texts. Texts of equal sets are one class, of which only
   the smallest id goes on.
2. Frequencies, at first of the tokens in one half of the hash space and by 32
   bits inside a bucket: too high a number where hashes meet, never too low. A
   text with more tokens of its own than a quarter of its set has a prefix that
   nothing shares, and links with nothing. These are most texts of any corpus;
   only the others are read again, for exact frequencies among themselves.
3. Links only need to be found as far as they join components. A token's texts
   are first compared with the smallest of them, in two rounds: each text with
   the one that it shares most tokens with, then with all. What is left are pairs
   of different components; for each token, texts outside its commonest component
   are compared with all others. So a group of near copies costs a few pairs per
   text, and no link that could join two components goes untested.

Defined results: null and empty texts have no token and link with nothing; rows
without an id count their tokens but have no component and no links; rows that
share an id are one node; an empty table gives an empty result; other columns
are not read.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import small_batches, stage, unstage
from mailsieve.llm.components import components
from mailsieve.llm.shingles import shingle_sets

#: Links at PART * intersection >= SHARE * union.
SHARE, PART = 75, 100
#: Seeds of the orders; they rank tokens of equal frequency.
ORDERS = (1, 2, 3)
#: Tokens of a frequency bucket, about; buckets are counted in one task each.
BUCKET = 500_000
#: Tokens of a batch of texts, at least, before it is written.
BATCH = 1_000_000


def spare(n):
    """Tokens a set of n may have that a linked set lacks: n - ceil(0.75 n)."""
    return n * (PART - SHARE) // PART


def _hashed(bits: int):
    """Texts to batches: ids, sizes and digests in one row, and one row per
    bucket with 32 bits of each token in one half of the hash space."""

    def batch_rows(ids, sets):
        name = uuid.uuid4().hex
        sizes = np.array([len(s) for s in sets], np.int64)
        for number, (id_, s) in enumerate(zip(ids, sets)):
            yield name, -1, number, id_, len(s), xxhash.xxh3_128_digest(s.tobytes()), None, None
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        half = tokens < np.uint64(1 << 63)
        tokens, owner = tokens[half] << np.uint64(1), owner[half]
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        bucket = (tokens >> np.uint64(64 - bits)).astype(np.int64)
        small = ((tokens << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
        for low, high in zip(edges[:-1], edges[1:]):
            yield name, int(bucket[low]), -1, None, 0, None, small[low:high].tobytes(), owner[low:high].tobytes()

    columns = ["batch", "bucket", "number", "id", "n", "digest", "tokens", "owners"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, sets, held = [], [], 0
        for batch in batches:
            for id_, s in zip(batch["id"], shingle_sets(batch["text"])):
                ids.append(id_)
                sets.append(s)
                held += len(s)
                if held >= BATCH or len(sets) >= 50_000:
                    yield frame(batch_rows(ids, sets))
                    ids, sets, held = [], [], 0
        if sets:
            yield frame(batch_rows(ids, sets))

    def frame(rows):
        return pd.DataFrame(rows, columns=columns).astype({"id": "object"})

    return run


def _own_tokens(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For one bucket: per batch, which of its texts have tokens that no other text
    has, and how many."""
    parts = [np.frombuffer(t, np.uint32) for t in rows["tokens"]]
    tokens = np.concatenate(parts)
    order = np.argsort(tokens)
    tokens = tokens[order]
    differs = tokens[1:] != tokens[:-1]
    alone = np.empty(len(tokens), bool)
    alone[order] = np.concatenate(([True], differs)) & np.concatenate((differs, [True]))
    found, at = [], 0
    for name, part, owners in zip(rows["batch"], parts, rows["owners"]):
        owner, count = np.unique(np.frombuffer(owners, np.uint32)[alone[at : at + len(part)]], return_counts=True)
        at += len(part)
        if len(owner):
            found.append((name, owner.tobytes(), count.astype(np.uint32).tobytes()))
    return pd.DataFrame(found, columns=["batch", "owners", "own"])


def _survivors(key: tuple, counts: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """For one batch: the ids of the texts that may link."""
    own = np.zeros(len(texts), np.int32)
    for owners, part in zip(counts["owners"], counts["own"]):
        own[np.frombuffer(owners, np.uint32)] += np.frombuffer(part, np.uint32).astype(np.int32)
    mine = own[texts["number"].to_numpy(np.int64)]
    keep = (mine <= spare(texts["n"].to_numpy(np.int64))) & (texts["n"] > 0) & texts["id"].notna()
    return texts.loc[keep, ["id"]]


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [s.view(np.int64) for s in shingle_sets(batch["text"])]
        yield pd.DataFrame({"id": batch["id"], "tokens": sets})


def set_sizes_and_survivors(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, digest) of every row, and the ids of rows that may link with a text
    of another set or are one of several of equal sets."""
    id_type = docs.schema["id"].dataType.simpleString()
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(bytes_ / 12 / BUCKET).bit_length())
    # Ids travel as text: pandas has no whole numbers beside nulls.
    schema = "batch string, bucket bigint, number bigint, id string, n bigint, digest binary, tokens binary, owners binary"
    given = docs.select(F.col("id").cast("string").alias("id"), F.col("text").cast("binary").alias("text"))
    hashed = stage(given.mapInPandas(_hashed(bits), schema), "sets")
    texts = stage(hashed.filter("bucket = -1").select("batch", "number", "id", "n", "digest"), "set-sizes")
    buckets = hashed.filter("bucket >= 0").select("batch", "bucket", "tokens", "owners")
    own = buckets.groupBy("bucket").applyInPandas(_own_tokens, "batch string, owners binary, own binary")
    alive = own.groupBy("batch").cogroup(texts.select("batch", "number", "id", "n").groupBy("batch"))
    survivors = stage(alive.applyInPandas(_survivors, "id string"), "survivors")
    unstage(hashed)
    id_ = F.col("id").cast(id_type).alias("id")
    return texts.select(id_, "n", "digest"), survivors.select(id_)


def frequent_tokens(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Per text of ``ids``: id, n and the (frequency, token) of each token that
    another of these texts has too."""
    chosen = docs.join(ids.distinct(), "id", "left_semi").select("id", F.col("text").cast("binary").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    sets = stage(chosen.mapInPandas(_sets, f"id {id_type}, tokens array<bigint>"), "tokens")
    rows = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = stage(rows.groupBy("token").count().filter("count > 1"), "frequencies")
    met = rows.join(counts, "token").groupBy("id", "n").agg(
        F.sort_array(F.collect_list(F.struct("count", "token"))).alias("shared")
    )
    return stage(met, "frequent")


def prefix(order: int) -> Column:
    """Of the tokens a text shares, those in its prefix under an order.

    Tokens of its own come before all shared ones.
    """
    ranked = F.col("shared")
    if order != ORDERS[0]:
        ranked = F.sort_array(
            F.transform("shared", lambda s: F.struct(s["count"], F.xxhash64(F.lit(order), s["token"]), s["token"]))
        )
    room = F.floor(F.col("n") * (PART - SHARE) / PART) + 1 - (F.col("n") - F.size("shared"))
    return F.slice(ranked, 1, F.greatest(room, F.lit(0)).cast("int"))["token"]


def near(n: Column, m: Column) -> Column:
    """Whether sizes allow a link."""
    return F.least(n, m) * PART >= F.greatest(n, m) * SHARE


def enough_left(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m tokens may link if their first common token stands
    at the places i and j (from 0): it and the shorter rest have to be enough.

    A pair that links passes at its first common token, whatever it does at others.
    """
    return (PART + SHARE) * (F.least(n - i, m - j)) >= SHARE * (n + m)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under every order, and link."""
    filters = texts.select("id", *(prefix(o).alias(f"p{o}") for o in ORDERS[1:]))
    left = filters.select(F.col("id").alias("a"), *(F.col(f"p{o}").alias(f"a{o}") for o in ORDERS[1:]))
    right = filters.select(F.col("id").alias("b"), *(F.col(f"p{o}").alias(f"b{o}") for o in ORDERS[1:]))
    candidates = pairs.join(left, "a").join(right, "b")
    for o in ORDERS[1:]:
        candidates = candidates.filter(F.arrays_overlap(f"a{o}", f"b{o}"))
    candidates = candidates.select("a", "b")
    sets = texts.select("id", "n", F.col("shared.token").alias("tokens"))
    met = candidates.join(sets.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("tokens").alias("s")), "a")
    met = met.join(sets.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    return met.filter(PART * common >= SHARE * (F.col("n") + F.col("m") - common)).select("a", "b")


def joining_links(texts: DataFrame) -> DataFrame:
    """Links (a, b) that join every two texts that a path of links joins."""
    rows = texts.select("id", "n", F.posexplode(prefix(ORDERS[0])).alias("place", "token"), F.size("shared").alias("k"))
    rows = stage(rows.select("id", "n", (F.col("n") - F.col("k") + F.col("place")).alias("place"), "token"), "prefixes")
    pivots = stage(
        rows.groupBy("token").agg(F.min_by(F.struct("id", "n", "place"), "id").alias("pivot"), F.count("*").alias("size"))
        .filter("size > 1").select("token", *(F.col(f"pivot.{x}").alias(y) for x, y in (("id", "a"), ("n", "m"), ("place", "at")))),
        "pivots",
    )
    fits = near(F.col("n"), F.col("m")) & enough_left(F.col("n"), F.col("place"), F.col("m"), F.col("at"))
    stars = rows.join(pivots, "token").filter((F.col("a") < F.col("id")) & fits)
    stars = stage(stars.groupBy("a", F.col("id").alias("b")).count(), "stars")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")
    links = stage(verified(best, texts), "links")
    label = stage(components(links), "labels")

    apart = _labelled(_labelled(stars.select("a", "b"), label, "a"), label, "b").filter("label_a <> label_b")
    more = stage(verified(apart.select("a", "b"), texts), "links")
    if not more.isEmpty():
        links = links.union(more)
        label = stage(components(links), "labels")

    # The rest: texts outside a token's commonest component, against all its texts.
    held = stage(_labelled(rows.withColumnRenamed("id", "a"), label, "a"), "held")
    by_label = held.groupBy("token", "label_a").count()
    mixed = by_label.groupBy("token").agg(
        F.max_by("label_a", F.struct("count", "label_a")).alias("most"), F.count("*").alias("labels")
    )
    mixed = stage(mixed.filter("labels > 1").drop("labels"), "mixed")
    all_ = held.join(mixed, "token").select("token", "a", "n", "place", "label_a", "most")
    few = all_.filter("label_a <> most").select(
        "token", F.col("a").alias("b"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("label_a").alias("label_b")
    )
    rest = all_.drop("most").join(few, "token").filter(F.col("label_a") != F.col("label_b")).filter(fits)
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = rest.join(stars.select("a", "b"), ["a", "b"], "left_anti")
    return links.union(stage(verified(rest, texts), "links"))


def _labelled(rows: DataFrame, label: DataFrame, column: str) -> DataFrame:
    """With the component of a column's id, which is the id itself if it has no link."""
    of = label.select(F.col("id").alias(column), F.col("component").alias(f"label_{column}"))
    joined = rows.join(of, column, "left")
    return joined.withColumn(f"label_{column}", F.coalesce(f"label_{column}", column))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes, survivors = set_sizes_and_survivors(rows)
    classes = sizes.filter("n > 0 and id is not null").groupBy("digest").agg(
        F.min("id").alias("first"), F.max("id").alias("last")
    )
    classes = stage(classes.filter("first < last").drop("last"), "classes")
    copies = sizes.join(classes, "digest").filter("id > first")
    heads = survivors.join(copies.select("id"), "id", "left_anti")
    texts = frequent_tokens(rows, heads)
    links = joining_links(texts)
    # Copies hang on their class; a node of two rows may belong to two classes.
    label = stage(components(links), "labels")
    named = sizes.join(classes, "digest", "left").withColumn("head", F.coalesce("first", "id"))
    alone = (F.col("n") == 0) | F.col("id").isNull()
    named = _labelled(named.withColumn("head", F.when(alone, F.col("id")).otherwise(F.col("head"))), label, "head")
    return named.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("label_head").alias("component_id")
    )
