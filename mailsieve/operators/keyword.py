"""Keyword search with a relevance score."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.display import preview
from mailsieve.functions.patterns import or_empty
from mailsieve.operators import filters

# Weight of a keyword found in the subject and in the body.
SUBJECT_WEIGHT = 2.0
BODY_WEIGHT = 1.0


def relevance(words: list[str], subject: Column, body: Column) -> Column:
    """Weighted literal hits per keyword; a repeated keyword counts again."""
    subject, body = F.lower(or_empty(subject)), F.lower(or_empty(body))
    score = F.lit(0.0)
    for word in words:
        score = (
            score
            + F.when(F.contains(subject, F.lit(word)), SUBJECT_WEIGHT).otherwise(0.0)
            + F.when(F.contains(body, F.lit(word)), BODY_WEIGHT).otherwise(0.0)
        )
    return score / len(words) if words else score


def hit_columns(score: Column) -> list[Column]:
    return [
        F.col("uid"),
        F.col("subject"),
        F.col("sender"),
        F.col("date"),
        preview(F.col("body")).alias("body_preview"),
        or_empty(F.col("body")).alias("full_body"),
        score.alias("similarity_score"),
    ]


def keyword_search(
    emails: DataFrame,
    query: str,
    *,
    date_after: str | None = None,
    regex: str | None = None,
    limit: int = 10,
) -> DataFrame:
    """The newest ``limit`` matches, then the pattern, then by relevance."""
    words = filters.keywords(query)
    rows = emails.where(filters.keyword_match(words))
    if date_after:
        rows = filters.date_after(rows, date_after)
    rows = rows.orderBy(F.col("date").desc_nulls_last(), "uid").limit(limit)
    if regex:
        rows = filters.regex_on_body(rows, regex)
    hits = rows.select(*hit_columns(relevance(words, F.col("subject"), F.col("body"))))
    return hits.orderBy(F.col("similarity_score").desc(), F.col("date").desc_nulls_last(), "uid")
