"""Mail-shaped views of the tables at hand.

Each view is a projection of whole tables, row by row; texts are never cut.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mail_of(documents: DataFrame) -> DataFrame:
    """Documents as mail: one message per document, dates spread over a year."""
    seconds = (F.col("doc_id") * 7919 % 31536000).cast("int")
    return documents.select(
        F.col("doc_id").cast("string").alias("uid"),
        F.lit(1).cast("bigint").alias("uidvalidity"),
        F.substring_index("text", "\n", 1).alias("subject"),
        F.concat("source", F.lit("@"), "lang", F.lit(".example.com")).alias("sender"),
        F.timestamp_add("SECOND", seconds, F.lit("2024-01-01").cast("timestamp_ntz")).alias("date"),
        F.col("text").alias("body"),
    )


def mail_view(spark: SparkSession, folder: str) -> DataFrame:
    return mail_of(table(spark, folder, "documents"))


def _subject_prefix() -> Column:
    kind = F.col("uid").cast("bigint") % 3
    return F.when(kind == 0, "Re: ").when(kind == 1, "FWD:  ").otherwise("")


def _headers() -> Column:
    """Common headers, with the line break after the last one."""
    return F.concat(
        F.lit("From: "), "sender", F.lit("\nTo: me@example.org\nSubject: "), _subject_prefix(), "subject",
        F.lit("\nDate: "), F.date_format("date", "d MMM yyyy HH:mm:ss"), F.lit(" +0530\nMessage-ID: <"),
        "uid", F.lit("@example.org>\n"),
    )


def raw_of(mail: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mail as raw messages with a link, an address, a quote and a signature.

    ``keep`` names columns of the mail to pass by.
    """
    promotion = F.when(F.col("uid").cast("bigint") % 10 == 0, "Please act now\n").otherwise("")
    raw = F.concat(
        _headers(), F.lit("\n"), "body",
        F.lit("\n\n\n\nsee https://ex.org/"), "uid", F.lit(" or a.b@ex.org\nReply-To: x\n"), promotion,
        F.lit("On 1 Jan 2024, x wrote:\n> quoted\n-- \nsig "), "uid",
    )
    return mail.select("uid", "uidvalidity", *keep, raw.alias("raw"))


def raw_mail_view(spark: SparkSession, folder: str) -> DataFrame:
    return raw_of(mail_view(spark, folder))


def _multipart(kind: str, mark: Column, *parts: Column) -> Column:
    """Content header and body of a multipart."""
    opening, closing = F.concat(F.lit("--"), mark, F.lit("\n")), F.concat(F.lit("\n--"), mark, F.lit("--\n"))
    pieces = [F.lit(f"Content-Type: multipart/{kind}; boundary=\""), mark, F.lit("\"\n\n")]
    for number, part in enumerate(parts):
        pieces += [F.lit("\n") if number else F.lit(""), opening, part]
    return F.concat(*pieces, closing)


def _plain_part(text: Column) -> Column:
    return F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), text)


def _html_part(text: Column) -> Column:
    return F.concat(F.lit("Content-Type: text/html; charset=UTF-8\n\n"), text)


def _page() -> Column:
    return F.concat(F.lit("<html><body><h1>Note</h1><p>"), "body", F.lit("</p></body></html>"))


def _five_shapes(shape: Column) -> Column:
    """base64 text, alternative with a short plain part, mixed with two plain
    parts, HTML only, and quoted bytes that are Latin-1 instead of UTF-8."""
    mark = F.concat(F.lit("=_part_"), "uid")
    return (
        F.when(
            shape == 0,
            F.concat(
                F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"),
                F.base64(F.encode("body", "utf-8")),
            ),
        )
        .when(shape == 1, _multipart("alternative", mark, _plain_part(F.lit("see the page")), _html_part(_page())))
        .when(
            shape == 2,
            _multipart("mixed", mark, _plain_part(F.col("body")), _plain_part(F.concat(F.lit("second part of "), "uid"))),
        )
        .when(shape == 3, _html_part(_page()))
        .when(shape == 4, F.concat(F.lit("Content-Type: text/plain; charset=iso-8859-1\n\n"), "body"))
    )


def _as_raw(mail: DataFrame, shape: Column, content: Column) -> DataFrame:
    whole = F.concat(_headers(), content)
    encoded = F.when(shape == 4, F.encode(whole, "iso-8859-1")).otherwise(F.encode(whole, "utf-8"))
    return mail.select("uid", "uidvalidity", encoded.alias("raw"))


def raw_mime_view(spark: SparkSession, folder: str) -> DataFrame:
    """The same mail in five MIME shapes, by uid."""
    shape = F.col("uid").cast("bigint") % 5
    return _as_raw(mail_view(spark, folder), shape, _five_shapes(shape))


def _quoted_printable(text: Column) -> Column:
    """Every byte escaped, 24 of them a line."""
    escaped = F.regexp_replace(F.hex(F.encode(text, "utf-8")), "(..)", "=$1")
    return F.regexp_replace(escaped, "((?:=..){24})", "$1=\n")


def raw_nested_view(spark: SparkSession, folder: str) -> DataFrame:
    """The same mail in seven shapes: the five, quoted-printable text, and three
    multiparts inside each other with a quoted-printable part after them."""
    shape = F.col("uid").cast("bigint") % 7
    quoted = F.concat(
        F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n"),
        _quoted_printable(F.col("body")),
    )
    # The marks begin alike, as those of real programs do.
    marks = [F.concat(F.lit("=_" + "part_" * n), "uid") for n in (1, 2, 3)]
    innermost = _multipart("related", marks[2], _html_part(_page()), F.lit("Content-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA"))
    middle = _multipart("alternative", marks[1], _plain_part(F.lit("see the page")), innermost)
    content = F.coalesce(
        _five_shapes(shape), F.when(shape == 5, quoted).otherwise(_multipart("mixed", marks[0], middle, quoted))
    )
    return _as_raw(mail_view(spark, folder), shape, content)


def encoded_subject_view(spark: SparkSession, folder: str) -> DataFrame:
    """Raw mail whose subjects are encoded words, by uid: quoted UTF-8 in two words, base64
    of UTF-8 after a plain word, and base64 of Latin-1."""
    kind = F.col("uid").cast("bigint") % 3
    quoted = lambda c: F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "=$1")
    half = (F.char_length("subject") / 2).cast("int")
    first, second = F.substring("subject", F.lit(1), half), F.substring("subject", half + 1, F.char_length("subject"))
    coded = lambda name: F.translate(F.base64(F.encode("subject", name)), "\r\n", "")
    subject = (
        F.when(kind == 0, F.concat(F.lit("=?utf-8?q?"), quoted(first), F.lit("?=\n =?UTF-8?Q?"), quoted(second), F.lit("?=")))
        .when(kind == 1, F.concat(F.lit("plain =?utf-8?b?"), coded("utf-8"), F.lit("?=")))
        .otherwise(F.concat(F.lit("=?ISO-8859-1*en?B?"), coded("iso-8859-1"), F.lit("?=")))
    )
    raw = F.concat(F.lit("From: "), "sender", F.lit("\nSubject: "), subject, F.lit("\n\n"), "body")
    return mail_view(spark, folder).select("uid", "uidvalidity", raw.alias("raw"))


def thread_view(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies with the reply structures of real threads, by uid."""
    kind = F.col("uid").cast("bigint") % 6
    answer = F.concat(F.lit("Answer "), "uid", F.lit(" of the sender"))
    body = (
        F.when(kind == 0, F.concat("body", F.lit("\n\nOn Mon, Jan 1, 2024 at 9:00, x <x@ex.org>\nwrote:\n> "), answer))
        .when(kind == 1, F.concat(answer, F.lit("\n\nFrom: x\nSent: Monday\n\n"), "body"))
        .when(kind == 2, F.concat("body", F.lit("\n\n-- \n"), "sender", F.lit("\nphone 1")))
        .when(kind == 3, F.concat(F.lit("On Monday x wrote:\n> "), answer, F.lit("\n\n"), "body"))
        .when(kind == 4, F.concat("body", F.lit("\n> one\n\n> two\n"), answer, F.lit("\n\nSent from my small phone\n\n")))
        .otherwise(F.col("body"))
    )
    return mail_view(spark, folder).select("uid", body.alias("body"))


def vectors_view(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("uid"), "embedding"
    )
