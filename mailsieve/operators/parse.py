"""Raw messages -> header block and MIME parts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions import headers, mime
from mailsieve.operators.stage import built, settle


def _steps() -> list[dict[str, Column]]:
    """The columns to add, stage by stage."""
    return [
        {"text": mime.decode_lossy(F.col("raw"))},
        {"_block": headers.header_block(F.col("text"))},
        {
            "headers": headers.unfold(F.col("_block")),
            "_body": headers.message_body(F.col("text"), F.col("_block")),
        },
        {
            "_kind": headers.content_type(F.col("headers")),
            "_charset": headers.charset(F.col("headers")),
            "_coding": headers.transfer_encoding(F.col("headers")),
        },
        {"_tree": mime.needs_tree(*map(F.col, ("_kind", "_charset", "_coding", "_body")))},
        {"_leaves": F.when(F.col("_tree"), mime.leaves(F.col("raw")))},
        {"_rare": mime.rare_texts(F.col("_leaves"))},
        {
            "parts": F.when(F.col("_tree"), mime.tree_parts(F.col("_leaves"), F.col("_rare"))).otherwise(
                mime.flat_part(*map(F.col, ("raw", "_kind", "_charset", "_coding", "_body", "_tree")))
            )
        },
    ]


def parse_messages(raw: DataFrame) -> DataFrame:
    """Add ``headers`` (one line per header) and ``parts`` in place of the raw text.

    The stages are separate projections, so that what several later
    expressions need is computed once.
    """
    staged = raw
    for columns in built(raw, _steps):
        staged = staged.withColumns(columns)
    return settle(staged.drop("raw", "text", "_block", "_body", "_kind", "_charset", "_coding", "_tree", "_leaves", "_rare"))


def with_headers(raw: DataFrame) -> DataFrame:
    """Add only ``text`` and ``headers``; no part is looked at."""
    return (
        raw.withColumn("text", mime.decode_lossy(F.col("raw")))
        .withColumn("headers", headers.unfold(headers.header_block(F.col("text"))))
    )


def explode_parts(raw: DataFrame) -> DataFrame:
    """One row per leaf part, numbered in walk order."""
    return parse_messages(raw).select("uid", F.inline("parts"))
