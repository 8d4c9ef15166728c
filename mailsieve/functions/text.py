"""Subject and body cleaning.

Patterns are written so that each starts only where a run starts; a scan over
one long run of word characters or dashes therefore stays linear.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.entities import unescape
from mailsieve.functions.patterns import SPACE, WORD, collapse, let, or_empty, replace_where, strip, up_to_last
from mailsieve.functions.reply import visible_reply

# The placeholders that replace links and addresses, and the
# header names whose quoted lines are dropped, in the order they are dropped.
URL_MARK = "[URL]"
ADDRESS_MARK = "[EMAIL]"
QUOTED_HEADERS = ("From:", "Sent:", "To:", "Subject:")


def clean_subject(c: Column) -> Column:
    """Decode entities, drop one reply/forward prefix, tidy white space."""
    c = unescape(or_empty(c))
    c = F.regexp_replace(c, rf"(?i)\A(?:re|fwd|fw):[{SPACE}]*", "")
    return strip(collapse(c))


def normalize_newlines(c: Column) -> Column:
    return replace_where(c, "\n\n\n", r"\n{3,}", "\n\n")


def normalize_spaces(c: Column) -> Column:
    # Single spaces are left alone instead of being replaced by themselves.
    def tidy(text: Column) -> Column:
        needed = F.contains(text, F.lit("  ")) | F.contains(text, F.lit("\t"))
        return F.when(needed, F.regexp_replace(text, r"\t[ \t]*| [ \t]+", " ")).otherwise(text)

    return let(c, tidy)


def strip_signature(c: Column) -> Column:
    """Cut everything from the first signature separator on."""
    return replace_where(c, "--", rf"--[{SPACE}]*\n(?s:.*)", "")


def strip_reply_attribution(c: Column) -> Column:
    """In each line, drop from the first "On " to the last " wrote:" behind it."""

    def drop(line: Column) -> Column:
        start = F.locate("On ", line)
        found = (start > 0) & F.contains(
            F.substring(line, start + 3, F.length(line)), F.lit(" wrote:")
        )
        rest = F.substring_index(line, " wrote:", -1)
        return F.when(found, F.concat(F.substring(line, F.lit(1), start - 1), rest)).otherwise(line)

    def by_line(text: Column) -> Column:
        lines = F.transform(F.split(text, "\n", -1), drop)
        return F.when(F.contains(text, F.lit(" wrote:")), F.array_join(lines, "\n")).otherwise(text)

    return let(c, by_line)


def strip_quoted_headers(c: Column) -> Column:
    """Drop quoted header fields up to and including their line break.

    The last line has no line break and is kept aside, so that each field
    searched for does have one.
    """

    def drop(ended: Column) -> Column:
        for name in QUOTED_HEADERS:
            ended = replace_where(ended, name, rf"{name}[^\n]*\n", "")
        return ended

    return up_to_last(c, "\n", drop)


def mask_urls(c: Column) -> Column:
    return replace_where(c, "://", rf"https?://[^{SPACE}]+", URL_MARK)


def mask_emails(c: Column) -> Column:
    # No address spans lines, so only lines with an @ are searched. \G lets a
    # match begin inside a run only where the previous one ended.
    run = rf"[{WORD}.-]"
    address = rf"(?:(?<!{run})|\G){run}++@{run}+\.[{WORD}]+"

    def by_line(text: Column) -> Column:
        lines = F.transform(
            F.split(text, "\n", -1), lambda line: replace_where(line, "@", address, ADDRESS_MARK)
        )
        return F.when(F.contains(text, F.lit("@")), F.array_join(lines, "\n")).otherwise(text)

    return let(c, by_line)


def clean_body(c: Column) -> Column:
    """The full body cleaner: visible reply, artefacts, masking."""
    c = visible_reply(or_empty(c))
    for step in (
        normalize_newlines,
        normalize_spaces,
        strip_signature,
        strip_reply_attribution,
        strip_quoted_headers,
        mask_urls,
        mask_emails,
    ):
        c = step(c)
    return strip(c)


def clean_simple(c: Column) -> Column:
    """The light cleaner: tags, white space, forwarded tail, quoted tail, links."""
    c = up_to_last(or_empty(c), ">", lambda t: F.regexp_replace(t, r"<[^>]+>", ""))
    c = collapse(c)
    c = F.regexp_replace(c, r"(?s)(?<!-)-+ ?Original Message ?-.*", "")

    def cut_quoted(line: Column) -> Column:
        # The tail starts at the first "On " that has a " wrote:" anywhere
        # behind it, and the first "On " has the most behind it.
        start = F.locate("On ", line)
        tail = F.substring(line, start + 3, F.length(line))
        return F.when(
            (start > 0) & F.contains(tail, F.lit(" wrote:")),
            F.substring(line, F.lit(1), start - 1),
        ).otherwise(line)

    return strip(mask_urls(let(c, cut_quoted)))


def search_text(subject: Column, body: Column) -> Column:
    """Subject and body as one text without the masking placeholders."""
    c = F.concat(or_empty(subject), F.lit("\n\n"), or_empty(body))
    c = F.replace(c, F.lit(URL_MARK), F.lit(""))
    c = F.replace(c, F.lit(ADDRESS_MARK), F.lit(""))
    return strip(replace_where(c, "\n\n", r"\n{2,}", "\n"))
