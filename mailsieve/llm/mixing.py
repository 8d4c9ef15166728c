"""Operator 5, mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. A source takes all of its
documents ``base`` times and, once more, those whose hash lies below the
source's threshold. To find the threshold, sizes are summed by source and hash
bucket (a few thousand rows per source); the bucket in which the budget runs out
is refined by its next bits, until it holds a single hash. Nothing is sorted,
and the last hash goes in when that brings the source nearer to its target.

Targets: sources by code point, null last, weigh ``weights`` in turn and share
``total`` times all sizes. A target stops at ``max_repeats`` times its source's
size, and the excess is shared by weight among the others until none is above.

Defined results: null and empty texts have size 0 and are taken with 0 words;
rows that share an id share their hash and are taken together; an empty table
gives an empty result; other columns are passed by. ``apply_mix`` adds its
columns, ``mixed`` returns each row as often as it is taken.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsieve.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
HASH_BITS = 60
BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def id_hash(id_: Column) -> Column:
    """The first 60 bits of the md5 of the id as text; a null id counts as empty."""
    digest = F.md5(F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(
    totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.0, max_repeats: int = 3
) -> DataFrame:
    """Target per source from (source, source_size): one row per source.

    With sources by their ratio of cap to weight, those that reach their cap come
    first. A source is capped if an equal share per weight of what the earlier
    caps leave would exceed its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rising = Window.orderBy("ratio", "place")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("volume") - F.col("caps_before")) / F.col("weight_onward")
    capped = totals.select(
        "source", "source_size", (F.row_number().over(order) - 1).alias("place"),
        (F.lit(total) * F.sum("source_size").over(everything)).alias("volume"),
    ).withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats).withColumn(
        "ratio", F.col("cap") / F.col("weight")
    ).withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn(
        "weight_onward", F.sum("weight").over(onward)
    ).withColumn("capped", F.col("ratio") <= level)
    free = F.when(~F.col("capped"), F.col("weight"))
    left = F.col("volume") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    share = left * F.col("weight") / F.sum(free).over(everything)
    return capped.select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(share).cast("double").alias("target")
    )


def mix_plan(rows: DataFrame, max_repeats: int = 3, **shares) -> DataFrame:
    """Per source: source_size, target, base and hash limit, from (source, size, hash)."""
    totals = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    base = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))
    targets = source_targets(totals, max_repeats=max_repeats, **shares).withColumn(
        "base", F.when(F.col("source_size") > 0, base).otherwise(0).cast("bigint")
    ).withColumn(
        "budget",
        F.when(F.col("base") < max_repeats, F.col("target") - F.col("base") * F.col("source_size")).otherwise(0.0),
    )
    # The range still open, as a hash prefix; what lies below it is taken.
    state = stage(targets.select(
        "*", F.lit(0).cast("bigint").alias("prefix"), F.lit(False).alias("settled"),
        F.lit(None).cast("bigint").alias("limit"),
    ), "mix-state")
    for used in range(BITS, HASH_BITS + 1, BITS):
        state = stage(_refine(rows, state, used), "mix-state")
        if state.filter(~F.col("settled")).isEmpty():
            break
    return state.select("source", "source_size", "target", "base", "limit")


def _refine(rows: DataFrame, state: DataFrame, used: int) -> DataFrame:
    """Look ``BITS`` further bits into the open bucket of every source."""
    shift = HASH_BITS - used
    open_ = state.filter(~F.col("settled")).select(F.col("source").alias("of"), "prefix", "budget")
    inside = rows.join(
        open_,
        F.col("source").eqNullSafe(F.col("of"))
        & (F.shiftright("hash", shift + BITS) == F.col("prefix")),
    )
    buckets = inside.groupBy("of", F.shiftright("hash", shift).alias("bucket")).agg(
        F.sum("size").alias("held"), F.min("hash").alias("low"), F.max("hash").alias("high"),
        F.first("budget").alias("budget"),
    )
    reached = F.sum("held").over(Window.partitionBy("of").orderBy("bucket"))
    over = buckets.withColumn("reached", reached).filter(F.col("reached") > F.col("budget"))
    edge = over.groupBy("of").agg(F.min(F.struct("bucket", "reached", "held", "low", "high")).alias("edge"))
    joined = state.join(edge, F.col("source").eqNullSafe(F.col("of")), "left")
    rest = F.col("budget") - (F.col("edge.reached") - F.col("edge.held"))
    single = F.col("edge.low") == F.col("edge.high")
    last = F.col("edge.low") + F.when(F.col("edge.held") < 2 * rest, 1).otherwise(0)
    # No bucket exceeds the budget: the open range ends at or below it, and all of it is taken.
    whole = F.shiftleft(F.col("prefix") + 1, shift + BITS)
    limit = F.when(F.col("edge").isNull(), whole).when(single, last)
    return joined.select(
        "source", "source_size", "target", "base",
        F.when(F.col("settled") | F.col("edge").isNull(), F.col("budget")).otherwise(rest).alias("budget"),
        F.when(F.col("settled") | F.col("edge").isNull(), F.col("prefix")).otherwise(F.col("edge.bucket")).alias("prefix"),
        (F.col("settled") | F.col("edge").isNull() | single).alias("settled"),
        F.when(F.col("settled"), F.col("limit")).otherwise(limit).alias("limit"),
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """Per row of ``docs``: id, size, source_size, target, taken."""
    rows = stage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("hash"),
    ), "mix-rows")
    plan = mix_plan(rows, **shares).withColumnRenamed("source", "of")
    times = F.col("base") + F.when(F.col("hash") < F.col("limit"), 1).otherwise(0)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """The mixed rows with their columns: each row as often as its source takes it.

    The texts are not shuffled: rows meet the plan, which has a row per source.
    Rows without words follow their source's threshold like any other.
    """
    named = docs.select(
        F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), id_hash(F.col(id_col)).alias("hash")
    )
    rows = stage(named.select("source", word_count(F.col("row")[text_col]).alias("size"), "hash"), "mix-rows")
    plan = mix_plan(rows, **shares).withColumnRenamed("source", "of")
    times = (F.col("base") + F.when(F.col("hash") < F.col("limit"), 1).otherwise(0)).cast("int")
    met = named.join(plan, F.col("source").eqNullSafe(F.col("of"))).select("row", times.alias("times"))
    return met.filter("times > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
