"""Content and address checks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.patterns import let, or_empty, strip

MIN_BODY_CHARS = 20

# Phrases that mark bulk mail, tested in this order on the
# upper-cased subject and body; the first one has to be within one line.
SPAM_PATTERNS = (
    "URGENT.*REPLY",
    "CLICK HERE NOW",
    "MAKE MONEY FAST",
    "FREE MONEY",
    "ACT NOW",
)
ADDRESS_PATTERN = r"(?d)^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def has_min_content(subject: Column, body: Column) -> Column:
    """Something is there, and the trimmed body is long enough."""
    some = (or_empty(subject) != "") | (or_empty(body) != "")
    return some & (F.length(strip(or_empty(body))) >= MIN_BODY_CHARS)


def spam_pattern(subject: Column, body: Column) -> Column:
    """First bulk-mail pattern found, or null."""

    def first_found(text: Column) -> Column:
        start, end = SPAM_PATTERNS[0].split(".*")

        def in_line(line: Column) -> Column:
            # Behind the first start of a line lies all that is behind any other.
            rest = F.substring(line, F.locate(start, line) + len(start), F.length(line))
            return F.contains(line, F.lit(start)) & F.contains(rest, F.lit(end))

        both = F.contains(text, F.lit(start)) & F.contains(text, F.lit(end))
        within_line = both & F.exists(F.split(text, "\n", -1), in_line)
        found = F.when(within_line, SPAM_PATTERNS[0])
        for phrase in SPAM_PATTERNS[1:]:
            found = found.when(F.contains(text, F.lit(phrase)), phrase)
        return found

    return let(F.upper(F.concat(or_empty(subject), F.lit(" "), or_empty(body))), first_found)


def reject_reason(subject: Column, body: Column) -> Column:
    """Why a message is not worth keeping; null for a valid one."""
    return (
        F.when((or_empty(subject) == "") & (or_empty(body) == ""), "empty")
        .when(~has_min_content(subject, body), "short body")
        .otherwise(spam_pattern(subject, body))
    )


def is_valid_content(subject: Column, body: Column) -> Column:
    return reject_reason(subject, body).isNull()


def is_address(c: Column) -> Column:
    return or_empty(c).rlike(ADDRESS_PATTERN)
