"""Character classes shared by the text functions.

Java's ``\\s`` and ``\\w`` are ASCII unless a flag is set, and the flag brings
in marks and joiners as well, so the Unicode classes are spelled out here.
The same spelling is valid in RE2, which the SQL twins run on.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD = r"\p{L}\p{N}_"


SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Trim every Unicode white space character from both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse(c: Column) -> Column:
    """Turn each run of white space into one space."""
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def replace_where(c: Column, marker: str, pattern: str, replacement: str) -> Column:
    """Pattern replacement in texts that hold ``marker``.

    The marker is a plain string that every match contains; texts without it,
    which are most, are not put through the pattern engine.
    """
    return let(
        c,
        lambda text: F.when(
            F.contains(text, F.lit(marker)), F.regexp_replace(text, pattern, replacement)
        ).otherwise(text),
    )


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def up_to_last(c: Column, end: str, change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` to the text up to the last ``end``; the rest is kept.

    For patterns whose matches close with ``end``: a start without an end is
    then never searched for, which would cost a scan of the rest each time.
    """

    def split(text: Column) -> Column:
        rest = F.substring_index(text, end, -1)
        return F.concat(change(F.left(text, F.length(text) - F.length(rest))), rest)

    return let(c, split)
