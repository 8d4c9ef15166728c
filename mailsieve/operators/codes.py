"""Approximate nearest neighbours by product-quantised codes.

A vector is cut into ``parts`` pieces, each replaced by the number of the nearest of
``levels`` centres of that piece: a few bytes a vector, which are scanned instead of
the vectors. The sum of the squared distances between the pieces of a query and the
centres, read from a table made once per query, ranks the codes; the best are ranked
again by their vectors. How many that are is measured when the codes are built, so
that true neighbours are among them, and kept with them.

Centres are fitted on at most ``SAMPLE`` vectors, chosen by a hash of their uid, and
the number to rank again on ``ASKED`` of these as queries against all codes. Every
vector is coded. Vectors that are null are left out.
"""

import functools
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.operators import cells
from mailsieve.operators.vectors import matrix

PARTS = 8
LEVELS = 64
SAMPLE = 20_000
ASKED = 64
#: The share of true neighbours that the best codes have to hold where it is measured.
HELD = 0.94
ROUNDS = 15
BLOCK = 4096
#: Distances of queries to codes that a task holds at once.
HELD_DISTANCES = 1 << 21
_CANDIDATES = "query_id string, uid string, rough double"


@dataclass(frozen=True)
class Codebook:
    """Centres of each piece: parts x levels x width of a piece."""

    centres: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[0] * self.centres.shape[2]

    def pieces(self, points: np.ndarray) -> np.ndarray:
        return points.reshape(len(points), self.centres.shape[0], -1)

    def encode(self, points: np.ndarray) -> np.ndarray:
        pieces = self.pieces(points)
        near = [_gaps(pieces[:, p], centres).argmin(1) for p, centres in enumerate(self.centres)]
        return np.stack(near, 1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of the pieces of each query to the centres: parts x queries x levels."""
        pieces = self.pieces(queries)
        return np.stack([_gaps(pieces[:, p], centres) for p, centres in enumerate(self.centres)])


def _gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((points[:, None, :] - centres[None, :, :]) ** 2).sum(2)


def _sampled(vectors: DataFrame, n: int) -> np.ndarray:
    rows = vectors.where(F.col("embedding").isNotNull()).select("uid", "embedding")
    place = F.md5(F.col("uid").cast("binary"))
    # Every task sends its first rows to the driver; those that can't be among the first are left out before.
    few = place < f"{min(2**32 - 1, 2**33 * n // max(1, rows.count())):08x}"
    few = few | F.col("uid").isNull()
    if rows.where(few).count() >= n:
        rows = rows.where(few)
    taken = rows.orderBy(place, "uid").limit(n).collect()
    return np.array([r["embedding"] for r in taken], dtype=np.float64).reshape(len(taken), -1)


def fit_codebook(vectors: DataFrame, parts: int = PARTS, levels: int = LEVELS) -> Codebook:
    """Centres of a bounded sample, by a few rounds of k-means for each piece."""
    points = _sampled(vectors, SAMPLE)
    if not len(points) or points.shape[1] % parts or levels > 256:
        raise ValueError(f"{parts} pieces of {levels} levels don't fit {points.shape}")
    fitted = []
    for piece in np.split(points, parts, axis=1):
        # The sample is in the order of a hash, so its first rows are a random choice.
        centres = piece[np.arange(levels) % len(piece)].copy()
        for _ in range(ROUNDS):
            near = _gaps(piece, centres).argmin(1)
            for level in np.unique(near):
                centres[level] = piece[near == level].mean(0)
        fitted.append(centres)
    return Codebook(np.stack(fitted))


@dataclass(frozen=True)
class CodeIndex:
    """Codes stored below a folder, their centres, and how many codes to rank again for ``k``."""

    path: str
    book: Codebook
    k: int
    rerank: int

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/codes")


def _coded(book: Codebook):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = [row.tobytes() for row in book.encode(matrix(batch.column("embedding")))]
                yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(code, pa.binary())], ["uid", "code"])

    return run


def build_codes(vectors: DataFrame, path: str, k: int, book: Codebook | None = None) -> CodeIndex:
    """Code and store every vector, and measure how many codes to rank again."""
    spark, book = vectors.sparkSession, book or fit_codebook(vectors)
    rows = vectors.where(F.col("embedding").isNotNull()).select("uid", "embedding")
    rows.mapInArrow(_coded(book), "uid string, code binary").write.parquet(f"{path}/codes")
    index = CodeIndex(path, book, k, _measured(rows, spark.read.parquet(f"{path}/codes"), book, k))
    about = json.dumps({"centres": book.centres.tolist(), "k": k, "rerank": index.rerank})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.text(f"{path}/about")
    return index


def read_codes(spark: SparkSession, path: str) -> CodeIndex:
    about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
    return CodeIndex(path, Codebook(np.array(about["centres"])), about["k"], about["rerank"])


def _measured(vectors: DataFrame, codes: DataFrame, book: Codebook, k: int) -> int:
    """The place among all codes within which ``HELD`` of the true neighbours of some queries are."""
    points = _sampled(vectors, ASKED)
    spark = vectors.sparkSession
    asked = spark.createDataFrame([(str(n), p.tolist()) for n, p in enumerate(points)], "query_id string, embedding array<double>")
    near = cells.broadcast_join(asked, vectors, k).select("query_id", "uid")
    # At most k neighbours of each of the few queries.
    own = near.join(codes, "uid").collect()
    tables = book.tables(points)
    rough = _rough(tables, np.frombuffer(b"".join(r.code for r in own), np.uint8).reshape(len(own), -1))
    bounds = np.array([rough[int(r.query_id), n] for n, r in enumerate(own)])
    asking = np.array([int(r.query_id) for r in own])

    def counted(batches):
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            for block in _blocks(batch):
                places = np.sort(_rough(tables, block), axis=1)
                for q in range(len(points)):
                    mine = asking == q
                    total[mine] += np.searchsorted(places[q], bounds[mine], side="right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(total)], ["at", "n"])

    found = codes.mapInArrow(counted, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    places = sorted(r.n for r in found)
    return int(places[min(len(places) - 1, math.ceil(HELD * len(places)) - 1)]) if places else k


def _blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return (codes[at : at + BLOCK] for at in range(0, len(codes), BLOCK))


def _rough(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Distances of queries to codes: one lookup a piece."""
    return functools.reduce(np.add, (table[:, codes[:, part]] for part, table in enumerate(tables)))


def _best_codes(ids: list[str], queries: np.ndarray, book: Codebook, rerank: int):
    """The best codes of a partition for each query.

    What is held is the partition's codes and uids, and the distances of as many queries
    as make ``HELD_DISTANCES``, whatever the number of codes to rank again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        uids = pa.chunked_array([batch.column("uid") for batch in held]).combine_chunks()
        codes = np.concatenate([block for batch in held for block in _blocks(batch)])
        held.clear()
        tables, n = book.tables(queries), min(rerank, len(codes))
        step = max(1, HELD_DISTANCES // len(codes))
        for at in range(0, len(ids), step):
            rough = _rough(tables[:, at : at + step], codes)
            for name, row in zip(ids[at : at + step], rough):
                best = np.argpartition(row, n - 1)[:n] if n < len(row) else np.arange(n)
                columns = [pa.array([name], pa.string()).take(pa.array(np.zeros(n, np.int32))), uids.take(pa.array(best)), pa.array(row[best])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "uid", "rough"])

    return run


@F.arrow_udf(T.DoubleType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(((matrix(a) - matrix(b)) ** 2).sum(axis=1) if len(a) else np.zeros(0))


def code_join(queries: DataFrame, vectors: DataFrame, index: CodeIndex, k: int, batch: int = 1024) -> DataFrame:
    """About the k nearest vectors of every query, with exact distances.

    Queries go in batches of about ``batch``, each one scan of the codes; only the vectors
    of the best codes are compared.
    """
    if k > index.k:
        raise ValueError(f"the codes were measured for {index.k} neighbours, not for {k}")
    given = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    n = max(1, -(-given.count() // batch))
    scans = []
    for number in range(n):
        rows = given.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == number).collect()
        if rows:
            points = np.array([r["embedding"] for r in rows], dtype=np.float64)
            run = _best_codes([r["query_id"] for r in rows], points, index.book, index.rerank)
            scans.append(index.codes(given.sparkSession).mapInArrow(run, _CANDIDATES))
    if not scans:
        return cells._merge(given.sparkSession.createDataFrame([], "query_id string, uid string, distance double"), k)
    order = Window.partitionBy("query_id").orderBy("rough", "uid")
    best = functools.reduce(DataFrame.unionByName, scans).withColumn("place", F.row_number().over(order))
    best = best.where(F.col("place") <= index.rerank).select("query_id", "uid")
    met = best.join(vectors.select("uid", "embedding"), "uid").join(
        given.withColumnRenamed("embedding", "asked"), "query_id"
    )
    return cells._merge(met.select("query_id", "uid", _distance("embedding", "asked").alias("distance")), k)


def work_share(index: CodeIndex, n_vectors: int) -> float:
    """All work of a query beside that of a comparison with every vector: the tables of its
    pieces, one lookup a piece and code, and the vectors that are ranked again."""
    parts, levels, _ = index.book.centres.shape
    width = index.book.width
    return (levels * width + n_vectors * parts + min(index.rerank, n_vectors) * width) / (n_vectors * width)


def recall_report(queries: DataFrame, vectors: DataFrame, index: CodeIndex, k: int) -> DataFrame:
    """Recall against the exact search, and the share of its work, as one row."""
    exact = cells.knn_join(queries, vectors, k).select("query_id", "uid")
    found = code_join(queries, vectors, index, k).select("query_id", "uid", F.lit(1).alias("hit"))
    share = work_share(index, vectors.where(F.col("embedding").isNotNull()).count())
    return exact.join(found, ["query_id", "uid"], "left").agg(
        F.lit(k).alias("k"), F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("expected"),
        (F.count("hit") / F.count(F.lit(1))).alias("recall"), F.lit(share).alias("work_share"),
    )
