"""Embedding of messages and exact nearest-neighbour search."""

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions.patterns import or_empty

VECTOR_TYPE = T.ArrayType(T.FloatType())
# Fixed value: number of messages a model embeds at once.
MODEL_BATCH = 64

#: ASCII bytes that are no letter and no digit become blanks.
SEPARATED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

Embedder = Callable[[Column], Column]


def matrix(vectors: pa.Array) -> np.ndarray:
    """Equal-width vectors of one Arrow batch as a float64 matrix; an error if widths differ."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    widths = pa.compute.unique(pa.compute.list_value_length(vectors))
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {sorted(w for w in widths.to_pylist() if w is not None)}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def words(text: Column) -> Column:
    """Lower-cased text whose tokens, runs of letters and numbers, ASCII separates."""
    lowered, others = F.lower(or_empty(text)), r"([\p{L}\p{N}]*+)[^\p{L}\p{N}]++"
    # A run and what follows it are taken at once; a blank at the end follows the last run.
    parted = F.regexp_replace(F.concat(lowered, F.lit(" ")), others, "$1 ")
    return F.when(F.octet_length(text) == F.char_length(text), lowered).otherwise(parted)


class Buckets(dict):
    """Hash bucket of each token; those of an Arrow batch are remembered."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        number = int.from_bytes(hashlib.md5(token, usedforsecurity=False).digest()[:4], "big") >> 4
        bucket = self[token] = number % self.dim
        return bucket


def hashing_embedder(dim: int = 256) -> Embedder:
    """Lexical embedding: token counts by hash bucket, unit length.

    Texts are lower-cased and parted in the JVM; Python hashes each token of an Arrow
    batch once and counts them all. No shuffle. It stands in for a pretrained model:
    scores have the same form, but only words count.
    """

    @F.arrow_udf(VECTOR_TYPE)
    def count(texts: pa.Array) -> pa.Array:
        buckets, counts = Buckets(dim), np.zeros((len(texts), dim))
        for row, text in zip(counts, texts.cast(pa.binary())):
            found = text.as_py().translate(SEPARATED).split()
            row[:] = np.bincount(np.fromiter(map(buckets.__getitem__, found), np.int64, len(found)), minlength=dim)
        norms = np.linalg.norm(counts, axis=1, keepdims=True)
        unit = (counts / np.where(norms == 0, 1, norms)).astype(np.float32)
        offsets = pa.array(np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))

    return lambda text: count(words(text))


def model_embedder(make_predict: Callable) -> Embedder:
    """Embedding by a model that is loaded once per Python worker.

    ``make_predict`` returns a function from an array of texts to a matrix; its
    rows are brought to unit length.
    """

    def make_unit_predict():
        predict = make_predict()

        def unit(texts: np.ndarray) -> np.ndarray:
            rows = np.asarray(predict(texts), dtype=np.float64)
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            return (rows / np.where(norms == 0, 1, norms)).astype(np.float32)

        return unit

    predict = predict_batch_udf(make_unit_predict, return_type=VECTOR_TYPE, batch_size=MODEL_BATCH)
    return lambda text: predict(or_empty(text))


def l2_normalize(c: Column) -> Column:
    """Unit-length float vector; a zero vector stays as it is."""
    squares = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    norm = F.sqrt(squares)
    return F.when(norm == 0, c).otherwise(
        F.transform(c, lambda x: (x.cast("double") / norm).cast("float"))
    )


def new_only(emails: DataFrame, vectors: DataFrame) -> DataFrame:
    """Messages without a vector."""
    return emails.join(vectors.select("uid"), "uid", "left_anti")


def embed_new(
    emails: DataFrame, vectors: DataFrame, embedder: Embedder, text: str = "body"
) -> DataFrame:
    """Vectors of the messages that have none yet, ready to be appended.

    A uid that occurs twice in one load gets one vector. A message whose text
    changed keeps its old vector.
    """
    todo = new_only(emails.select("uid", text), vectors).groupBy("uid").agg(F.max(text).alias(text))
    return todo.select("uid", embedder(F.col(text)).alias("embedding"))


def squared_distance(c: Column, query: Sequence[float]) -> Column:
    """Squared Euclidean distance of each vector to one query vector."""
    target = np.asarray(query, dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def distance(vectors: pa.Array) -> pa.Array:
        points = matrix(vectors)
        if len(points) and points.shape[1] != len(target):
            raise ValueError(f"vectors of width {points.shape[1]}, a query of width {len(target)}")
        return pa.array(((points - target) ** 2).sum(axis=1) if len(points) else np.zeros(0))

    return distance(c)


def knn(vectors: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """The k nearest vectors; each task keeps k rows before they are merged."""
    near = (
        vectors.where(F.col("embedding").isNotNull())
        .select("uid", squared_distance(F.col("embedding"), query).alias("distance"))
        .orderBy("distance", "uid")
        .limit(k)
    )
    return near.withColumn("similarity_score", 1 - F.col("distance"))


def scores(hits: DataFrame) -> DataFrame:
    """Similarity as defined (1 - distance) and as a cosine of unit vectors."""
    return hits.withColumn("similarity_score", 1 - F.col("distance")).withColumn(
        "cosine", 1 - F.col("distance") / 2
    )
