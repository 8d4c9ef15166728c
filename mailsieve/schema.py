"""Explicit schemas of every stored table."""

from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("uidvalidity", T.LongType()),
        T.StructField("raw", T.BinaryType()),
        # Later messages of a load have larger numbers.
        T.StructField("seq", T.LongType()),
    ]
)

# `date` is the UTC wall time of the Date header; the header itself is kept beside it.
EMAILS_SCHEMA = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("uidvalidity", T.LongType()),
        T.StructField("subject", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("date_header", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("search_content", T.StringType()),
    ]
)

# Cleaned mail of one load, with its order.
LOAD_SCHEMA = T.StructType([*EMAILS_SCHEMA.fields, T.StructField("seq", T.LongType())])

KV_SCHEMA = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]
)

VECTORS_SCHEMA = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

PART_TYPE = T.StructType(
    [
        T.StructField("part_no", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("charset", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("utf8_text", T.StringType()),
    ]
)
PARTS_TYPE = T.ArrayType(PART_TYPE)
