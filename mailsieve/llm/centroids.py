"""Operator 13, centroid clustering by Shallot search.

Vectors become integers, so distances and means are exact and the result depends
on no order of rows or sums. Every round is one pass over the vectors without a
shuffle. A vector carries between rounds which centroid is nearest and second
nearest, an upper bound of its distance to the first and a lower bound of its
distance to all others; both bounds follow the centroids by how far these moved.
Where the bounds, or half the gap to the next centroid, show that the nearest
centroid is still the only nearest one, nothing is computed. Otherwise both
remembered centroids are measured, the closer one is where the scan starts, and
its neighbours are visited by growing gap: none beyond the distance to the start
plus the second-best distance so far can be among the two best, so that ball
shrinks while the scan runs. Centroids inside it are compared as integers.

The driver holds ``k`` centroids; sums and counts per cluster are combined in the
tasks. A round's rows are written before the next one reads them, so a lost
executor costs only its running tasks.

Defined results: a vector takes part if it has exactly ``width`` components, none
null or non-finite, and none that is ``LIMIT`` or more in size once scaled (its
distances might not fit a long). Repeated rows are vectors of their own. Rows
without an id take part, but are the last to become a start. With fewer vectors
than ``k`` there are fewer centroids; an empty table gives an empty result. Other
columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import stage, unstage

WIDTH = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
LIMIT = 1 << 27
#: Rounding of roots and their sums, far above what doubles lose. It only makes more centroids be compared.
SLACK = 1e-9
_STATE = "id bigint, point array<int>, near int, second int, upper double, lower double"


def points(vectors: DataFrame, id_col: str, vector_col: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(id, point) of the vectors that take part."""
    vector = F.col(vector_col).cast("array<double>")
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scale * x) < LIMIT))
    whole = F.transform("vector", lambda x: F.floor(scale * x).cast("int"))
    kept = vectors.select(F.col(id_col).alias("id"), vector.alias("vector")).filter((F.size("vector") == width) & fits)
    return kept.select("id", whole.alias("point"))


def start_order(id_: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256)


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    apart = rows - centres
    return np.einsum("ij,ij->i", apart, apart)


class Centres:
    """Centroids of one round, the gaps between them and each one's neighbours by gap."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None):
        self.at = centres
        k = len(centres)
        gap = np.sqrt(np.stack([squared(centres, c[None, :]) for c in centres]).astype(np.float64))
        np.fill_diagonal(gap, -1.0)  # every centroid is the first of its own neighbours
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.gap = gap
        nearest = np.where(np.eye(k, dtype=bool), np.inf, gap).min(1)
        self.half = nearest / 2 * (1 - SLACK)
        self.move = np.zeros(k)
        if before is not None:
            self.move = np.sqrt(squared(centres, before).astype(np.float64)) * (1 + SLACK)
        #: The farthest that any other centroid moved.
        self.others = np.array([max((m for j, m in enumerate(self.move) if j != i), default=0.0) for i in range(k)])


def search(rows: np.ndarray, near: np.ndarray, second: np.ndarray, centres: Centres):
    """Nearest and second-nearest centroids of ``rows`` and their squared distances.

    Of equal distances the smaller number is nearest.
    """
    first_d, second_d = squared(rows, centres.at[near]), squared(rows, centres.at[second])
    swap = (second_d < first_d) | ((second_d == first_d) & (second < near))
    start, other = np.where(swap, second, near), np.where(swap, near, second)
    best, best_d = start.copy(), np.minimum(first_d, second_d)
    next_, next_d = other.copy(), np.maximum(first_d, second_d)
    reach = np.sqrt(best_d.astype(np.float64))
    alive = np.arange(len(rows))
    for step in range(1, len(centres.at)):
        candidate = centres.order[start[alive], step]
        ball = (reach[alive] + np.sqrt(next_d[alive].astype(np.float64))) * (1 + SLACK) + SLACK
        inside = centres.gap[start[alive], candidate] <= ball
        alive, candidate = alive[inside], candidate[inside]
        if not len(alive):
            break
        fresh = candidate != other[alive]
        at, c = alive[fresh], candidate[fresh]
        d = squared(rows[at], centres.at[c])
        wins = (d < best_d[at]) | ((d == best_d[at]) & (c < best[at]))
        places = ~wins & (d < next_d[at])
        won, placed = at[wins], at[places]
        next_[won], next_d[won] = best[won], best_d[won]
        best[won], best_d[won] = c[wins], d[wins]
        next_[placed], next_d[placed] = c[places], d[places]
    return best, best_d, next_, next_d


def follow(rows: np.ndarray, near, second, upper, lower, centres: Centres):
    """The state of ``rows`` under moved centroids, and which of them were searched."""
    if len(centres.at) == 1:
        return near, second, upper, lower, np.zeros(len(rows), bool)
    upper, lower = upper + centres.move[near], lower - centres.others[near]
    certain = np.maximum(lower, centres.half[near])
    open_ = np.flatnonzero(~(upper < certain))
    # The exact distance often settles what the bound left open.
    exact = np.sqrt(squared(rows[open_], centres.at[near[open_]]).astype(np.float64)) * (1 + SLACK)
    upper[open_] = exact
    open_ = open_[~(exact < certain[open_])]
    best, best_d, next_, next_d = search(rows[open_], near[open_], second[open_], centres)
    near, second = near.copy(), second.copy()
    near[open_], second[open_] = best, next_
    upper[open_] = np.sqrt(best_d.astype(np.float64)) * (1 + SLACK)
    lower[open_] = np.sqrt(next_d.astype(np.float64)) * (1 - SLACK)
    searched = np.zeros(len(rows), bool)
    searched[open_] = True
    return near, second, upper, lower, searched


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("point").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(np.int64)


def _pass(centres: np.ndarray, before: np.ndarray | None, last: bool):
    def run(batches):
        known = Centres(centres, before)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch)
            state = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("near", "second", "upper", "lower")]
            near, second, upper, lower, _ = follow(rows, *state, known)
            if last:
                found = [pa.array(near, pa.int32()), pa.array(squared(rows, centres[near]), pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *found], ["id", "cluster", "distance"])
            else:
                found = [pa.array(near, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("point"), *found], _names(_STATE)
                )

    return run


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _means(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Exact floors of the means; a cluster without vectors keeps its centroid."""
    sums = [F.sum(F.col("point")[i].cast("bigint")) for i in range(centres.shape[1])]
    found = state.groupBy("near").agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))
    after = centres.copy()
    for row in found.collect():  # at most one row a centroid
        after[row.near] = [total // row.n for total in row.sums]
    return after


def centroid_sha256(centre) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centre).encode()).hexdigest()


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH,
    k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """Per vector that takes part: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    unknown = [F.lit(0).alias("near"), F.lit(1).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")]
    state = stage(points(vectors, id_col, vector_col, width, scale).select("id", "point", *unknown), "points")
    starts = state.orderBy(start_order(F.col("id"), seed).asc_nulls_last(), "point").select("point").limit(k).collect()
    centres = np.array([r.point for r in starts], np.int64).reshape(len(starts), width)
    before = None
    for _ in range(rounds if len(starts) else 0):
        moved = stage(state.mapInArrow(_pass(centres, before, False), _STATE), "clusters")
        unstage(state)
        state, before, centres = moved, centres, _means(moved, centres)
    final = "id bigint, cluster int, distance bigint"
    if not len(starts):
        placed = state.select("id", F.col("near").alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    else:
        placed = stage(state.mapInArrow(_pass(centres, before, True), final), "assigned")
        unstage(state)
    sums = {r.cluster: r.total for r in placed.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    about = [(c, total, sum(sums.values()), centroid_sha256(centres[c])) for c, total in sorted(sums.items())]
    totals = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row a centroid at most, whatever the number of vectors.
    return placed.join(F.broadcast(totals), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
