"""Search commands: by vector, by keyword, and one after the other."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsieve.functions.display import preview
from mailsieve.functions.patterns import or_empty
from mailsieve.operators import filters
from mailsieve.operators.cells import knn_join
from mailsieve.operators.keyword import keyword_search
from mailsieve.operators.vectors import Embedder, hashing_embedder, knn

RESULT_COLUMNS = ("uid", "subject", "sender", "date", "body_preview", "full_body", "similarity_score")


def embed_query(spark: SparkSession, text: str, embedder: Embedder | None = None) -> list[float]:
    """The vector of one query text, by the embedder of the index."""
    row = spark.range(1).select((embedder or hashing_embedder())(F.lit(text)).alias("embedding")).first()
    return [float(x) for x in row["embedding"]]


def embedded_queries(queries: DataFrame, embedder: Embedder | None = None, text: str = "text") -> DataFrame:
    """A table of query texts (query_id, text) as query_id and embedding."""
    return queries.select("query_id", (embedder or hashing_embedder())(F.col(text)).alias("embedding"))


def with_mail(hits: DataFrame, emails: DataFrame) -> DataFrame:
    """Hits with the columns of their message; a hit without one is dropped."""
    return hits.join(emails, "uid").select(
        *hits.columns,
        "subject",
        "sender",
        "date",
        preview(F.col("body")).alias("body_preview"),
        or_empty(F.col("body")).alias("full_body"),
    )


def _filtered(rows, body, date_after, date_before, sender, regex, regex_on):
    if date_after:
        rows = filters.date_after(rows, date_after)
    if date_before:
        rows = filters.date_before(rows, date_before)
    if sender:
        rows = filters.sender_contains(rows, sender)
    if regex:
        text = or_empty(F.col(body))
        rows = rows.where((preview(text) if regex_on == "preview" else text).rlike(regex))
    return rows


def search(
    emails: DataFrame,
    vectors: DataFrame,
    query: Sequence[float] | str,
    *,
    date_after: str | None = None,
    date_before: str | None = None,
    sender: str | None = None,
    regex: str | None = None,
    limit: int = 10,
    filter_mode: str = "post",
    regex_on: str = "preview",
    embedder: Embedder | None = None,
) -> DataFrame:
    """Nearest messages that pass the filters, best first.

    ``query`` is a text, which is embedded as the messages were, or its vector.
    ``post`` filters the nearest ``limit`` messages, so fewer may be left;
    ``pre`` takes the nearest of those that pass.
    """
    if isinstance(query, str):
        query = embed_query(emails.sparkSession, query, embedder)
    conditions = (date_after, date_before, sender, regex, regex_on)
    if filter_mode == "pre":
        passing = _filtered(emails, "body", *conditions).select("uid")
        hits = with_mail(knn(vectors.join(passing, "uid", "left_semi"), query, limit), emails)
    elif filter_mode == "post":
        hits = _filtered(with_mail(knn(vectors, query, limit), emails), "full_body", *conditions)
    else:
        raise ValueError(f"unknown filter mode: {filter_mode}")
    return (
        hits.select(*RESULT_COLUMNS).orderBy(F.col("similarity_score").desc(), "uid").limit(limit)
    )


def search_basic(emails, vectors, query, date_after=None, regex=None, limit: int = 10) -> DataFrame:
    """The short form with a date and a pattern only."""
    return search(emails, vectors, query, date_after=date_after, regex=regex, limit=limit)


def hybrid_search(
    emails: DataFrame,
    vectors: DataFrame,
    query: Sequence[float] | str,
    words: str | None = None,
    *,
    date_after: str | None = None,
    date_before: str | None = None,
    sender: str | None = None,
    regex: str | None = None,
    limit: int = 10,
    fallback_filters: bool = False,
    filter_mode: str = "post",
    regex_on: str = "preview",
    embedder: Embedder | None = None,
) -> DataFrame:
    """Vector search; keyword search if nothing is left after its filters.

    A query given as text also gives the keywords, unless ``words`` are named.
    Both are planned together and cut to ``limit`` rows each, and the better
    source present wins. The fallback ignores the sender and the later date
    bound, unless ``fallback_filters`` is set.
    """
    semantic = search(
        emails,
        vectors,
        query,
        date_after=date_after,
        date_before=date_before,
        sender=sender,
        regex=regex,
        limit=limit,
        filter_mode=filter_mode,
        regex_on=regex_on,
        embedder=embedder,
    )
    if words is None:
        if not isinstance(query, str):
            raise ValueError("a query given as a vector needs words for the keyword search")
        words = query
    fallback = emails
    if fallback_filters:
        fallback = _filtered(emails, "body", None, date_before, sender, None, "body")
    by_word = keyword_search(fallback, words, date_after=date_after, regex=regex, limit=limit)
    both = semantic.withColumn("source", F.lit("semantic")).unionByName(
        by_word.withColumn("source", F.lit("keyword"))
    )
    # At most 2 x limit rows.
    preferred = F.max("source").over(Window.partitionBy())
    return (
        both.withColumn("_preferred", preferred)
        .where(F.col("source") == F.col("_preferred"))
        .drop("_preferred")
        .orderBy(F.col("similarity_score").desc(), F.col("date").desc_nulls_last(), "uid")
    )


def search_many(
    emails: DataFrame, vectors: DataFrame, queries: DataFrame, *, date_after: str | None = None, k: int = 5
) -> DataFrame:
    """The interactive loop as a batch: the k nearest messages of each query.

    Queries are vectors; ``embedded_queries`` makes them of texts.
    """
    hits = with_mail(knn_join(queries, vectors, k), emails)
    return _filtered(hits, "full_body", date_after, None, None, None, "body")
