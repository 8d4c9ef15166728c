"""Header block, single header values and the header records."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.dates import parse_mail_date

# Output field and header name, in record order.
HEADER_FIELDS = (
    ("sender", "From"),
    ("to", "To"),
    ("cc", "Cc"),
    ("bcc", "Bcc"),
    ("date", "Date"),
    ("message_id", "Message-ID"),
    ("in_reply_to", "In-Reply-To"),
    ("references", "References"),
)
HEADER_FIELDS_ALT = (
    ("subject", "Subject"),
    ("sender", "From"),
    ("recipient", "To"),
    ("message_id", "Message-ID"),
    ("thread_id", "Thread-Index"),
)

_FIELD_START = r"(?:[\x21-\x39\x3b-\x7e]*:|[ \t]|From )"


def header_block(text: Column) -> Column:
    """Everything before the first blank line or the first line that is no header.

    The blank line is searched as plain bytes; patterns see the headers only.
    """
    unix, dos = F.locate("\n\n", text), F.locate("\n\r\n", text)
    end = F.least(F.when(unix > 0, unix), F.when(dos > 0, dos), F.length(text))
    starts_blank = text.startswith("\n") | text.startswith("\r\n")
    block = F.when(starts_blank, "").otherwise(F.substring(text, F.lit(1), end))
    return F.regexp_replace(block, rf"(?md)^(?!{_FIELD_START})(?s:.*)", "")


def message_body(text: Column, block: Column) -> Column:
    """What follows the header block and the blank line that ends it."""
    rest = F.substring(text, F.length(block) + 1, F.length(text))
    return (
        F.when(rest.startswith("\n"), F.substring(rest, F.lit(2), F.length(rest)))
        .when(rest.startswith("\r\n"), F.substring(rest, F.lit(3), F.length(rest)))
        .otherwise(rest)
    )


def unfold(block: Column) -> Column:
    """One line per header."""
    return F.regexp_replace(block, r"\r?\n[ \t]+", " ")


def header(unfolded: Column, name: str) -> Column:
    """Value of the first header called ``name``, or an empty string."""
    return F.regexp_extract(unfolded, rf"(?imd)^{name}:[ \t]*([^\r\n]*)", 1)


def content_type(unfolded: Column) -> Column:
    """Lower-cased type/subtype; anything malformed counts as plain text."""
    value = F.lower(F.trim(F.regexp_extract(header(unfolded, "Content-Type"), r"^([^;]*)", 1)))
    return F.when(value.rlike(r"\A[^/]*/[^/]*\z"), value).otherwise("text/plain")


def charset(unfolded: Column) -> Column:
    value = header(unfolded, "Content-Type")
    return F.lower(F.regexp_extract(value, r"(?i);\s*charset\s*=\s*\"?([^\s\";]*)", 1))


def transfer_encoding(unfolded: Column) -> Column:
    return F.lower(F.trim(header(unfolded, "Content-Transfer-Encoding")))


def header_record(unfolded: Column, text: Column) -> Column:
    """The ten-field header record of a message."""
    fields = [header(unfolded, name).alias(field) for field, name in HEADER_FIELDS]
    return F.struct(
        *fields,
        content_type(unfolded).alias("content_type"),
        F.length(text).alias("size"),
    )


def header_record_alt(unfolded: Column) -> Column:
    """The short header record with the parsed date and the thread id."""
    fields = [header(unfolded, name).alias(field) for field, name in HEADER_FIELDS_ALT]
    return F.struct(*fields, parse_mail_date(header(unfolded, "Date")).alias("date"))


def parse_epoch(c: Column) -> Column:
    """Mailbox epoch in a status response, null if there is none."""
    return F.regexp_extract(c, r"UIDVALIDITY (\d+)", 1).try_cast("bigint")
