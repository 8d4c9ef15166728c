"""Operator 4, embedding near-dedup by sorted projection passes.

Each pass gives every vector a hash, the concatenated signs of its products with
random directions, and orders the vectors of a label by it. Neighbours of at most
``WINDOW`` ranks are compared, block by block, and passes use other directions.
A pair counts in the first pass whose window holds it, so no list of pairs is
needed to unite the passes: a block sends, for each vector with links, how many
it found and the smallest id among those it is joined to.

Windows alone miss pairs, so an exact check follows over those that no window
held. The blocks of the first order have a centre and a radius; pairs of blocks
whose angles rule out a link are left out, the others compared as matrices. This
is what remains quadratic where vectors of a label don't cluster.

Vectors link if their labels are equal and not null, their widths equal, and
their cosine in double precision is at least ``COSINE``. Vectors that are null,
zero or hold null or non-finite numbers link with nothing. Defined results: every
row is a vector of its own, so repeated rows link with each other; rows without
an id have no links; an empty table gives an empty result; other columns are not
read.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsieve.llm.common import stage
from mailsieve.llm.components import components

COSINE = 0.93
PASSES = 3
WINDOW = 64
#: Vectors of a block; at least the window.
BLOCK = 1024
BITS = 62
SEED = 4
#: Rounding of angles and of sums, far above what doubles lose and far below any real difference.
SLACK = 1e-6


def directions(width: int, number: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, number, width])).standard_normal((width, BITS))


def codes(vectors: np.ndarray, number: int) -> np.ndarray:
    """Signs of the products with the pass's directions, first direction highest."""
    signs = (vectors @ directions(vectors.shape[1], number)) > 0
    return signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def unit(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, np.float64) for v in vectors])
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _hash(batches):
    for batch in batches:
        frame = batch.assign(**{f"code{p}": np.zeros(len(batch), np.int64) for p in range(PASSES)})
        for _, rows in batch.groupby("width").groups.items():
            vectors = unit(batch.loc[rows, "vector"])
            for p in range(PASSES):
                frame.loc[rows, f"code{p}"] = codes(vectors, p)
        yield frame.drop(columns="vector")


def ranked(rows: DataFrame, p: int) -> DataFrame:
    """(key, rank): the place of each row in the order of a pass.

    Rows are sorted by range, numbered inside their partition and shifted by the
    sizes of the partitions before it, of which there is one row each.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["kind", f"code{p}", "key"]
    placed = rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = stage(placed.select("key", F.monotonically_increasing_id().alias("place")), "places")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).count()
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("shift"))
    inside = F.col("place") - F.shiftleft(part, 33)
    return placed.join(F.broadcast(shifts), part == F.col("part")).select("key", (F.col("shift") + inside).alias(f"rank{p}"))


def links_of(rows: pd.DataFrame, allowed, cosine: float) -> pd.DataFrame:
    """For the vectors of some rows that have a link among them: how many, and the
    smallest id that links inside these rows join them to.

    ``allowed`` gets row numbers and returns which of their pairs count.
    """
    n = len(rows)
    ids = rows["id"].to_numpy()
    degree, low = np.zeros(n, np.int64), ids.copy()
    for _, at in rows.groupby("kind").indices.items():
        matrix = unit(rows["vector"].to_numpy()[at])
        hit = (matrix @ matrix.T >= cosine) & allowed(at)
        hit |= hit.T
        degree[at] += hit.sum(1)
        # Spread the smallest id along links until nothing changes.
        own = low[at]
        while True:
            best = np.minimum(own, np.where(hit, own[None, :], own[:, None]).min(1))
            if (best == own).all():
                break
            own = best
        low[at] = own
    found = degree > 0
    return pd.DataFrame({"key": rows["key"][found], "id": ids[found], "n": degree[found], "low": low[found]})


def _ranks(rows: pd.DataFrame) -> np.ndarray:
    return rows[[f"rank{p}" for p in range(PASSES)]].to_numpy()


def _close(ranks: np.ndarray, at: np.ndarray, p: int, window: int) -> np.ndarray:
    own = ranks[at, p]
    return np.abs(own[:, None] - own[None, :]) <= window


def _window_links(p: int, cosine: float, window: int, block: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ranks, head = _ranks(rows), (rows[f"rank{p}"] // block == key[0]).to_numpy()

        def allowed(at):
            mine = head[at]
            pairs = _close(ranks, at, p, window) & (mine[:, None] | mine[None, :]) & ~np.eye(len(at), dtype=bool)
            for q in range(p):
                pairs &= ~_close(ranks, at, q, window)
            return pairs

        return links_of(rows, allowed, cosine)

    return run


def _other_links(cosine: float, window: int):
    """Pairs across two blocks, or inside one, that no window held."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ranks, block = _ranks(rows), rows["block"].to_numpy()

        def allowed(at):
            pairs = ~np.eye(len(at), dtype=bool)
            if key[0] != key[1]:
                pairs &= block[at][:, None] != block[at][None, :]
            for p in range(PASSES):
                pairs &= ~_close(ranks, at, p, window)
            return pairs

        return links_of(rows, allowed, cosine)

    return run


def _summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    vectors = unit(rows["vector"])
    centre = vectors.mean(0)
    length = np.linalg.norm(centre)
    centre = centre / length if length > 0 else vectors[0]
    radius = float(np.arccos(np.clip(vectors @ centre, -1, 1)).max())
    return pd.DataFrame({"block": [key[0]], "kind": [key[1]], "centre": [centre.tolist()], "radius": [radius]})


def open_blocks(rows: DataFrame, cosine: float) -> DataFrame:
    """Pairs of blocks (i, j) that may hold a link, of which i <= j."""
    about = rows.groupBy("block", "kind").applyInPandas(
        _summary, "block bigint, kind string, centre array<double>, radius double"
    )
    about = stage(about, "blocks")
    left = about.select(F.col("block").alias("i"), "kind", F.col("centre").alias("c"), F.col("radius").alias("r"))
    right = about.select(F.col("block").alias("j"), "kind", F.col("centre").alias("d"), F.col("radius").alias("s"))
    product = F.aggregate(F.zip_with("c", "d", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product)))
    met = left.join(right, "kind").filter("i <= j")
    return met.filter(angle - F.col("r") - F.col("s") <= math.acos(cosine) + SLACK).select("i", "j").distinct()


def embedding_dedup(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """Per row: id, n_links, component_id, kept. ``window`` is at most ``block``."""
    given = stage(embeddings.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"),
    ), "vectors")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = given.filter("id is not null and label is not null and vector is not null").filter(
        finite & F.exists("vector", lambda x: x != 0)
    )
    rows = valid.select(
        "key", "id", "vector", F.size("vector").alias("width"),
        F.concat_ws(":", F.size("vector"), "label").alias("kind"),
    )
    code = ", ".join(f"code{p} bigint" for p in range(PASSES))
    hashed = stage(rows.mapInPandas(_hash, f"key bigint, id bigint, width int, kind string, {code}"), "codes")
    placed = rows.drop("width")
    for p in range(PASSES):
        placed = placed.join(ranked(hashed, p), "key")
    placed = stage(placed.withColumn("block", F.floor(F.col("rank0") / block)), "ranked")

    schema = "key bigint, id bigint, n bigint, low bigint"
    found = None
    for p in range(PASSES):
        own = F.floor(F.col(f"rank{p}") / block)
        reaches_back = F.col(f"rank{p}") % block < window
        groups = F.when(reaches_back, F.array(own, own - 1)).otherwise(F.array(own))
        near = placed.withColumn("group", F.explode(groups))
        links = near.groupBy("group").applyInPandas(_window_links(p, cosine, window, block), schema)
        found = links if found is None else found.union(links)
    pairs = stage(open_blocks(placed, cosine), "block-pairs")
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rest = placed.join(sides, "block").groupBy("i", "j").applyInPandas(_other_links(cosine, window), schema)
    found = stage(found.union(rest), "links")

    degrees = found.groupBy("key").agg(F.sum("n").alias("n"))
    label = stage(components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))), "labels")
    joined = given.select("key", "id").join(degrees, "key", "left").join(label, "id", "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
