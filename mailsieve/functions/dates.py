"""Mail and ISO dates as time-zone free timestamps."""

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.patterns import let, strip

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Offsets of the zone names of RFC 2822, in hours.
ZONE_HOURS = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

_MAIL_DATE = (
    r"(?i)\A(?:[a-z]+\.?,?\s+)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*\.?,?[\s-]+(\d{4}|\d{2})"
    r",?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?\s*([+-]\d{2}:?\d{2}|[a-z]+)?\z"
)
_MONTH_FIRST = (
    r"(?i)\A(?:[a-z]+\.?,?\s+)?([a-z]{3})[a-z]*\.?\s+(\d{1,2})(?:,|\s)\s*(\d{4})"
    r"(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?\s*([+-]\d{2}:?\d{2}|[a-z]+)?\z"
)
_ISO = (
    r"\A(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?"
    r"\s*([+-]\d{2}:?\d{2}|Z)?\z"
)
# Dashes and colons may be left out.
_ANY_ISO = (
    r"\A(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2}):?(\d{2})(?::?(\d{2})(\.\d{1,6})?)?)?"
    r"(?:Z|[+-]\d{2}:?\d{2})?\z"
)


def _offset_minutes(zone: Column) -> Column:
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    signed = F.when(zone.startswith("-"), -minutes).when(zone.startswith("+"), minutes)
    named = F.try_element_at(F.from_json(F.lit(json.dumps(ZONE_HOURS)), "map<string,int>"), F.upper(zone))
    return F.coalesce(signed, named * 60, F.lit(0))


def _assemble(c: Column, pattern: str, day: int, month: int) -> Column:
    group = lambda i: F.regexp_extract(c, pattern, i)
    month_no = F.array_position(F.lit(list(MONTHS)), F.lower(group(month)))
    short = group(3).try_cast("int")
    year = F.when(short > 99, short).when(short > 68, short + 1900).otherwise(short + 2000)
    text = F.format_string(
        "%04d-%02d-%02dT%2s:%2s:%2s", year, month_no, group(day).try_cast("int"), group(4), group(5), group(6)
    )
    # Parts of the clock that are absent or have one digit are padded with blanks so far.
    return F.when(c.rlike(pattern), F.translate(text, " ", "0").try_cast("timestamp_ntz"))


def parse_mail_date(c: Column) -> Column:
    """UTC wall time of a Date header; null if it cannot be read.

    RFC 2822 dates come first (comments, zone names and two-digit years
    included), then month-first dates and ISO dates.
    """

    def parse(text: Column) -> Column:
        iso = F.regexp_replace(text, _ISO, "$1T$2")
        wall = F.coalesce(
            _assemble(text, _MAIL_DATE, day=1, month=2),
            _assemble(text, _MONTH_FIRST, day=2, month=1),
            F.when(text.rlike(_ISO), F.rtrim(iso, F.lit("T")).try_cast("timestamp_ntz")),
        )
        zone = F.regexp_extract(text, r"([+-]\d{2}:?\d{2}|[A-Za-z]+)\z", 1)
        return F.timestamp_add("MINUTE", -_offset_minutes(zone), wall)

    return let(strip(F.regexp_replace(c, r"\([^()]*\)", "")), parse)


def parse_iso_date(c: Column) -> Column:
    """Wall time of an ISO date with any zone dropped, not converted.

    Falls back to the first ten characters, then to the first day of year 1;
    null stays null.
    """
    group = lambda i: F.regexp_extract(c, _ANY_ISO, i)
    two = lambda i: F.lpad(group(i), 2, "0")
    wall = F.concat(
        group(1), F.lit("-"), group(2), F.lit("-"), group(3), F.lit("T"),
        two(4), F.lit(":"), two(5), F.lit(":"), two(6), group(7),
    )
    ten = F.substring(c, 1, 10)
    return F.when(
        c.isNotNull(),
        F.coalesce(
            F.when(c.rlike(_ANY_ISO), wall.try_cast("timestamp_ntz")),
            F.when(ten.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), ten.try_cast("timestamp_ntz")),
            F.lit("0001-01-01").cast("timestamp_ntz"),
        ),
    )
