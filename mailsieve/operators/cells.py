"""Nearest neighbours for a table of queries.

Few queries are sent to every task and the vectors are scanned once, without
a shuffle. For many queries the vectors are divided into cells around centres.
A query visits either the cells that may hold one of its neighbours by the
triangle inequality (exact), or its nearest few (approximate). Cells that are
large, or that many queries visit, are split into blocks of bounded size, so
no task ever sees a whole hot cell. A block yields k rows per query.
"""

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.operators.vectors import matrix
from mailsieve.session import work_folder

MAX_CELLS = 4096
BLOCK_VECTORS = 4096
# Queries compared with so many vectors at once.
SCAN_QUERIES = 256
# Rows of a block, from either side, that one task joins; each side is sent once per block of the other.
JOIN_ROWS = 16384
# Cells are joined in so many groups; a query is sent once to each group that it visits.
CELL_GROUPS = 16
# Queries sent to every task are at most this large.
MAX_SENT_BYTES = 32 << 20
# A batch of a search in several passes; every task holds one.
BATCH_BYTES = 8 << 20
# Passes over the vectors that are better than a division into cells.
MAX_SCANS = 64
# Rounding slack of a squared distance from a matrix product, by the squared lengths it is a
# difference of; and of a distance, by the lengths.
_SLACK = 1e-11
_ROOT_SLACK = 1e-5

_HIT_SCHEMA = "query_id string, uid string, distance double"
_ARROW_HITS = pa.schema([("query_id", pa.string()), ("uid", pa.string()), ("distance", pa.float64())])


@dataclass(frozen=True)
class Cells:
    """Centres of the cells; few enough to be sent with a task."""

    centres: np.ndarray

    def __len__(self) -> int:
        return len(self.centres)


@dataclass(frozen=True)
class CellSummary:
    """Size of each cell, and how far its vectors are from the centre."""

    size: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    closest: np.ndarray


def _check_cell_number(n: int) -> None:
    if not 0 < n <= MAX_CELLS:
        raise ValueError(f"the number of cells must be in 1..{MAX_CELLS}")


def sampled_cells(vectors: DataFrame, n: int) -> Cells:
    """Centres are n vectors in the order of a hash of their uid."""
    _check_cell_number(n)
    rows = vectors.orderBy(F.md5(F.col("uid").cast("binary")), "uid").limit(n).select("embedding").collect()
    return Cells(np.array([r["embedding"] for r in rows], dtype=np.float64))


def kmeans_cells(vectors: DataFrame, n: int, seed: int = 7) -> Cells:
    """Centres by k-means over all vectors."""
    _check_cell_number(n)
    training = vectors.where(F.col("embedding").isNotNull()).select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=n, seed=seed, maxIter=10).fit(training)
    return Cells(np.array(model.clusterCenters(), dtype=np.float64))


def _squared_gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gaps = (points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :]
    gaps -= 2 * points @ centres.T
    return np.maximum(gaps, 0, out=gaps)


def assign(vectors: DataFrame, cells: Cells) -> DataFrame:
    """Add the cell of each vector and its distance to the centre.

    Written to a table, this is the index: it is built once per set of vectors.
    """
    centres = cells.centres

    @F.arrow_udf("struct<cell:int,gap:double>")
    def nearest(batch: pa.Array) -> pa.Array:
        points = matrix(batch)
        gaps = _squared_gaps(points, centres) if len(points) else np.zeros((0, len(centres)))
        cell = gaps.argmin(axis=1)
        exact = np.sqrt(((points - centres[cell]) ** 2).sum(axis=1)) if len(points) else np.zeros(0)
        return pa.StructArray.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(exact)], names=["cell", "gap"]
        )

    return (
        vectors.where(F.col("embedding").isNotNull())
        .select("uid", "embedding", nearest("embedding").alias("_at"))
        .select("uid", "embedding", "_at.cell", "_at.gap")
    )


def without_surplus_copies(index: DataFrame, k: int) -> DataFrame:
    """Drop the copies of a vector that can be in no result.

    Copies tie in distance and ties go by uid, so of equal vectors only the k
    lowest uids can be among the k nearest of any query. The limit is applied
    before the shuffle too, so a vector that a third of all messages share
    leaves k rows per task.
    """
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("uid"))
    return index.withColumn("_copy", rank).where(F.col("_copy") <= k).drop("_copy")


def build_index(vectors: DataFrame, cells: Cells, k: int) -> DataFrame:
    """The index for searches of up to k neighbours, as a table in the shared folder.

    It is read several times by a search; written once, none of the reads goes
    back to the vectors, also not when an executor is lost.
    """
    spark = vectors.sparkSession
    path = work_folder(spark, "index")
    pruned = assign(without_surplus_copies(vectors.select("uid", "embedding"), k), cells)
    pruned.withColumn("built_for", F.lit(k)).write.parquet(path)
    return spark.read.parquet(path)


def summarize(index: DataFrame, cells: Cells, k: int) -> CellSummary:
    """Per-cell figures; at most k rows of each cell reach the driver."""
    n = len(cells)
    size, nearest, farthest = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
    closest = np.full((n, k), np.inf)
    totals = index.groupBy("cell").agg(
        F.count(F.lit(1)).alias("size"), F.min("gap").alias("near"), F.max("gap").alias("far")
    )
    for row in totals.collect():
        size[row["cell"]], nearest[row["cell"]], farthest[row["cell"]] = row["size"], row["near"], row["far"]
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("gap"))
    for row in index.select("cell", "gap", rank.alias("rank")).where(F.col("rank") <= k).collect():
        closest[row["cell"], row["rank"] - 1] = row["gap"]
    return CellSummary(size, nearest, farthest, closest)


def _visited(points: np.ndarray, cells: Cells, summary: CellSummary, k: int, nprobe: int | None) -> np.ndarray:
    """Boolean matrix: which query visits which cell."""
    gaps = np.sqrt(_squared_gaps(points, cells.centres))
    lengths = np.linalg.norm(points, axis=1) + np.linalg.norm(cells.centres, axis=1).max(initial=0)
    if nprobe is not None:
        order = np.argsort(gaps, axis=1, kind="stable")[:, :nprobe]
        visited = np.zeros(gaps.shape, dtype=bool)
        np.put_along_axis(visited, order, True, axis=1)
        return visited & (summary.size > 0)
    visited = np.zeros(gaps.shape, dtype=bool)
    for i, gap in enumerate(gaps):
        # k vectors are certainly within this radius of the query.
        reach = (gap[:, None] + summary.closest).ravel()
        radius = np.partition(reach, k - 1)[k - 1] + _ROOT_SLACK * lengths[i]
        visited[i] = (gap - summary.farthest <= radius) & (summary.nearest - gap <= radius)
    return visited & (summary.size > 0)


def _with_visits(queries: DataFrame, cells: Cells, summary: CellSummary, k: int, nprobe: int | None) -> DataFrame:
    """Queries and the list of the cells that each visits."""

    @F.arrow_udf("array<int>")
    def visits(batch: pa.Array) -> pa.Array:
        if not len(batch):
            return pa.array([], type=pa.list_(pa.int32()))
        visited = _visited(matrix(batch), cells, summary, k, nprobe)
        return pa.array([np.flatnonzero(row).astype(np.int32) for row in visited], type=pa.list_(pa.int32()))

    return queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding", visits("embedding").alias("cells"))


def route(queries: DataFrame, cells: Cells, summary: CellSummary, k: int, nprobe: int | None) -> DataFrame:
    """One row per query and visited cell."""
    visiting = _with_visits(queries, cells, summary, k, nprobe)
    return visiting.select("query_id", "embedding", F.explode("cells").alias("cell"))


def _nearest_in_block(
    queries: np.ndarray, vectors: np.ndarray, uid_rank: np.ndarray, k: int, limit: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, vector row and distance of the k nearest, ties by uid.

    Vectors that are farther than ``limit``, within which k others of a query are known
    to be, are left out.

    A matrix product picks the candidates with some slack; the distances that
    decide are then taken from the differences, so that copies tie exactly.
    """
    rough = _squared_gaps(queries, vectors)
    bound = np.full(len(queries), np.inf) if limit is None else limit
    open_ = ~np.isfinite(bound)
    if len(vectors) > k and open_.any():
        bound = bound.copy()
        bound[open_] = np.partition(rough[open_], k - 1, axis=1)[:, k - 1]
    scale = (queries**2).sum(1) + (vectors**2).sum(1).max(initial=0)
    rough_hits = rough <= (bound + _SLACK * scale)[:, None]
    q, v = np.nonzero(rough_hits)
    distance = np.empty(len(q))
    step = 1 << 16
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        distance[part] = ((queries[q[part]] - vectors[v[part]]) ** 2).sum(axis=1)
    return _first_k(q, v, distance, uid_rank[v], k)


def _first_k(q, v, distance, uid_rank, k):
    order = np.lexsort((uid_rank, distance, q))
    q, v, distance = q[order], v[order], distance[order]
    starts = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - starts < k
    return q[keep], v[keep], distance[keep]


def _limits(q: np.ndarray, distance: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of n queries with sorted hits, the distance of the k-th; infinite where there are fewer."""
    limit = np.full(n, np.inf)
    last = np.arange(len(q)) - np.searchsorted(q, q, side="left") == k - 1
    limit[q[last]] = distance[last]
    return limit


def _ranks(uids: np.ndarray) -> np.ndarray:
    return np.unique(uids, return_inverse=True)[1].ravel()


def _scan_with(query_ids: list[str], queries: np.ndarray, k: int):
    """Scan of one partition that keeps k rows per query."""
    ids = np.array(query_ids, dtype=object)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.zeros(0, np.int64)
        uid = np.zeros(0, object)
        distance = np.zeros(0)
        limit = np.full(len(queries), np.inf)
        for batch in batches:
            points = matrix(batch.column("embedding"))
            uids = np.array(batch.column("uid").to_pylist(), dtype=object)
            for at in range(0, len(points), BLOCK_VECTORS):
                block, names = points[at : at + BLOCK_VECTORS], uids[at : at + BLOCK_VECTORS]
                rank = _ranks(names)
                found = [(q, uid, distance)]
                for start in range(0, len(queries), SCAN_QUERIES):
                    part = slice(start, start + SCAN_QUERIES)
                    bq, bv, bd = _nearest_in_block(queries[part], block, rank, k, limit[part])
                    found.append((bq + start, names[bv], bd))
                q, uid, distance = (np.concatenate(column) for column in zip(*found))
                q, row, distance = _first_k(q, np.arange(len(q)), distance, _ranks(uid), k)
                uid, limit = uid[row], _limits(q, distance, len(queries), k)
        if len(q):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q], pa.string()), pa.array(uid, pa.string()), pa.array(distance)],
                schema=_ARROW_HITS,
            )

    return scan


def _block_hits(k: int):
    def hits(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _ARROW_HITS.empty_table()
        uids = np.array(vectors.column("uid").to_pylist(), dtype=object)
        ids = np.array(queries.column("query_id").to_pylist(), dtype=object)
        asking, points, rank = matrix(queries.column("embedding")), matrix(vectors.column("embedding")), _ranks(uids)
        visits = queries.column("cells").combine_chunks()
        visitor, visited = np.asarray(pa.compute.list_parent_indices(visits)), np.asarray(visits.flatten())
        cell = np.asarray(vectors.column("cell"))
        q, v, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit = np.full(len(asking), np.inf)
        for number in np.unique(cell):
            rows, who = np.flatnonzero(cell == number), visitor[visited == number]
            hits = [(q, v, distance)]
            for at in range(0, len(rows), BLOCK_VECTORS):
                for start in range(0, len(who), SCAN_QUERIES):
                    some, own = who[start : start + SCAN_QUERIES], rows[at : at + BLOCK_VECTORS]
                    bq, bv, bd = _nearest_in_block(asking[some], points[own], rank[own], k, limit[some])
                    hits.append((some[bq], own[bv], bd))
            if len(hits) > 1:
                q, v, distance = (np.concatenate(column) for column in zip(*hits))
                q, v, distance = _first_k(q, v, distance, rank[v], k)
                limit = _limits(q, distance, len(asking), k)
        return pa.Table.from_arrays(
            [pa.array(ids[q], pa.string()), pa.array(uids[v], pa.string()), pa.array(distance)],
            schema=_ARROW_HITS,
        )

    return hits


def _merge(partial: DataFrame, k: int) -> DataFrame:
    """k best of the partial results, ranked per query."""
    order = Window.partitionBy("query_id").orderBy("distance", "uid")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "uid", "distance", (1 - F.col("distance")).alias("similarity_score"))
    )


def _query_bytes(queries: DataFrame) -> int:
    size = F.size("embedding").cast("bigint") * 8 + F.length("query_id")
    return queries.agg(F.sum(size).alias("b")).first()["b"] or 0


def _scanned(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """k rows per query and task; the queries are collected, so they have to be few."""
    rows = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding").collect()
    points = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    scan = _scan_with([r["query_id"] for r in rows], points, k)
    return vectors.where(F.col("embedding").isNotNull()).select("uid", "embedding").mapInArrow(scan, _HIT_SCHEMA)


def broadcast_join(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact search for few queries: one pass over the vectors, no shuffle of them.

    The size of the queries is measured; more than ``MAX_SENT_BYTES`` is an error.
    """
    if _query_bytes(queries) > MAX_SENT_BYTES:
        raise ValueError("these queries are too large to be sent to every task; use the method 'scan'")
    return _merge(_scanned(queries, vectors, k), k)


def scan_join(queries: DataFrame, vectors: DataFrame, k: int, n: int) -> DataFrame:
    """Exact search in ``n`` batches of queries, each one pass over the vectors without a shuffle."""
    batch = F.pmod(F.xxhash64("query_id"), F.lit(n))
    scans = [_scanned(queries.where(batch == number) if n > 1 else queries, vectors, k) for number in range(n)]
    return _merge(functools.reduce(DataFrame.unionByName, scans), k)


def _per(number: str, values: np.ndarray) -> Column:
    """The value of a cell or group, by its number."""
    return F.element_at(F.from_json(F.lit(json.dumps(values.tolist())), "array<int>"), F.col(number) + 1)


def cell_join(
    queries: DataFrame,
    index: DataFrame,
    cells: Cells,
    k: int,
    nprobe: int | None = None,
    pruned: bool = False,
    block_vectors: int = JOIN_ROWS,
    block_queries: int = JOIN_ROWS,
) -> DataFrame:
    """Search by cells: exact, or approximate with ``nprobe`` cells per query.

    ``pruned`` says that the index was built without surplus copies, for this k or a
    larger one; the index knows for which. Figures per cell are collected when the
    plan is made.
    """
    if pruned:
        built_for = index.agg(F.min("built_for")).first()[0]
        if built_for is not None and built_for < k:
            raise ValueError(f"the index was built for {built_for} neighbours, not for {k}")
    else:
        index = without_surplus_copies(index, k)
    summary = summarize(index, cells, k)
    n = min(len(cells), CELL_GROUPS)
    visiting = _with_visits(queries, cells, summary, k, nprobe).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    routed = visiting.withColumn("cells", F.filter("cells", lambda c: c % n == F.col("part"))).where(F.size("cells") > 0)
    asked = np.zeros(n, np.int64)
    for row in routed.groupBy("part").count().collect():
        asked[row["part"]] = row["count"]
    held = np.bincount(np.arange(len(cells)) % n, weights=summary.size, minlength=n).astype(np.int64)
    vector_blocks = -(-held // block_vectors)
    query_blocks = -(-asked // block_queries)

    split = lambda key, blocks: F.pmod(F.xxhash64(key), _per("part", blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), _per("part", blocks) - 1))
    left = (
        index.withColumn("part", F.col("cell") % n)
        .where(_per("part", query_blocks) > 0)
        .select("uid", "embedding", "cell", "part", split("uid", vector_blocks).alias("v"))
        .withColumn("q", each(query_blocks))
    )
    right = routed.select(
        "query_id", "embedding", "cells", "part", split("query_id", query_blocks).alias("q")
    ).withColumn("v", each(vector_blocks))
    block = ("part", "v", "q")
    partial = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(_block_hits(k), _HIT_SCHEMA)
    return _merge(partial, k)


def knn_join(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    n_cells: int = 256,
    method: str = "scan",
) -> DataFrame:
    """Exact k nearest vectors of every query, for query tables of any size.

    ``scan`` sends the queries to every task, in as many batches of measured size as it
    takes; where that would be more than ``MAX_SCANS``, the vectors are divided into
    cells instead, as ``cells`` does at once. ``sent`` sends one batch or is an error.
    """
    if method == "sent":
        return broadcast_join(queries, vectors, k)
    if method not in ("scan", "cells"):
        raise ValueError(f"unknown method: {method}")
    if method == "scan":
        batches = max(1, -(-_query_bytes(queries) // min(BATCH_BYTES, MAX_SENT_BYTES)))
        # Hashing doesn't divide evenly; a batch holds about half of what may be sent.
        batches = batches if batches == 1 else 2 * batches
        if batches <= MAX_SCANS:
            return scan_join(queries, vectors, k, batches)
    if vectors.where(F.col("embedding").isNotNull()).isEmpty():
        return _merge(vectors.sparkSession.createDataFrame([], _HIT_SCHEMA), k)
    cells = kmeans_cells(vectors, n_cells)
    return cell_join(queries, build_index(vectors, cells, k), cells, k, pruned=True)


def lsh_knn(
    vectors: DataFrame, query, k: int = 10, bucket_length: float = 0.3, tables: int = 4, seed: int = 7
) -> DataFrame:
    """Approximate search for one query by random projections."""
    data = vectors.select("uid", array_to_vector("embedding").alias("features"))
    hashing = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    found = hashing.fit(data).approxNearestNeighbors(data, Vectors.dense(query), k, distCol="gap")
    distance = F.col("gap") * F.col("gap")
    return found.select("uid", distance.alias("distance"), (1 - distance).alias("similarity_score"))


def lsh_recall(queries: list[tuple[str, list[float]]], vectors: DataFrame, k: int = 10, **options) -> DataFrame:
    """Recall of ``lsh_knn`` against the exact search, over a few queries."""
    hits = [lsh_knn(vectors, v, k, **options).select(F.lit(i).alias("query_id"), "uid") for i, v in queries]
    found = functools.reduce(DataFrame.unionByName, hits).withColumn("hit", F.lit(1))
    spark = vectors.sparkSession
    asked = spark.createDataFrame(queries, "query_id string, embedding array<double>")
    exact = broadcast_join(asked, vectors, k).select("query_id", "uid")
    return exact.join(found, ["query_id", "uid"], "left").agg(
        F.lit(k).alias("k"), F.count(F.lit(1)).alias("expected"), (F.count("hit") / F.count(F.lit(1))).alias("recall")
    )


def recall_report(
    queries: DataFrame, vectors: DataFrame, cells: Cells, k: int, nprobe: int
) -> DataFrame:
    """Recall of the approximate search and the share of pairs it looked at."""
    index = build_index(vectors, cells, k)
    summary = summarize(index, cells, k)
    sizes = _per("cell", summary.size)
    pairs = route(queries, cells, summary, k, nprobe).agg(F.sum(sizes.cast("double")).alias("pairs"))
    exact = cell_join(queries, index, cells, k, pruned=True)
    approximate = cell_join(queries, index, cells, k, nprobe, pruned=True)
    hits = exact.select("query_id", "uid").join(
        approximate.select("query_id", "uid", F.lit(1).alias("hit")), ["query_id", "uid"], "left"
    )
    possible = F.lit(float(summary.size.sum())) * queries.agg(F.count(F.lit(1)).alias("n")).scalar()
    return hits.agg(
        F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found")
    ).select(
        F.lit(k).alias("k"),
        F.lit(nprobe).alias("nprobe"),
        (F.col("found") / F.col("expected")).alias("recall"),
        (pairs.scalar() / possible).alias("candidate_fraction"),
    )
