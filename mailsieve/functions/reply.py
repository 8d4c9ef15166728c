"""Visible part of a reply.

Each line is classified to one letter and the letters of a message form a
short string, so fragments become plain character runs in it:

    q  quoted line            o  "On ... wrote:" line
    h  From/Sent/To/Subject   s  possible start of a signature
    b  blank                  p  anything else

Rules, read from the bottom of the message:

* a quoted block takes with it the blank and "On ... wrote:" lines above it;
* any other "On ... wrote:" or header line hides itself and all below it;
* a signature start with a blank line above it opens a signature;
* quoted blocks, signatures and blanks at the end are hidden, and quoted
  blocks are left out everywhere.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.patterns import SPACE, WORD, let, replace_where, strip

_HEADER_LINE = r"\*?(?:From|Sent|To|Subject):\*? [^\n]+"
_SIGNATURE_START = rf"--|__|-[{WORD}]|Sent from my (?:[{WORD}]+[{SPACE}]*){{3}}"
_BREAK = "\x01"


def line_kind(line: Column) -> Column:
    # Only lines with these beginnings are compared with the longer patterns.
    header = F.contains(line, F.lit(":")) & line.rlike(rf"\A{_HEADER_LINE}")

    def unquoted(bare: Column) -> Column:
        signature = bare.startswith("-") | bare.startswith("_") | bare.startswith("Sent")
        return (
            F.when(bare == "", "b")
            .when(signature & bare.rlike(rf"\A(?:{_SIGNATURE_START})"), "s")
            .otherwise("p")
        )

    return (
        F.when(line.startswith(">"), "q")
        .when(line.startswith("On") & line.endswith("wrote:"), "o")
        .when(header, "h")
        .otherwise(let(strip(line), unquoted))
    )


def join_attribution(c: Column) -> Column:
    """Put an "On ... wrote:" header that was wrapped over lines on one line."""
    first = r"^(On[ \t][^\n]*+)(?<!wrote:)\n(?!On[ \t])"
    middle = r"(?:([^\n>][^\n]*+)(?<!wrote:)\n)?"
    last = r"(?!>)([^\n]*wrote:)$"
    return replace_where(c, "wrote:", f"(?md){first}{middle}{last}", "$1$2$3")


def _visible_kinds(lines: Column) -> Column:
    """Kind letters of the lines kept, with ``Q`` for lines of quoted blocks."""
    kinds = F.array_join(F.transform(lines, line_kind), "")
    # From the end: a quoted line, and the blank and attribution lines that follow on it.
    kinds = F.reverse(F.regexp_replace(F.reverse(kinds), r"q|\G(?!\A)[bo]", "Q"))
    kinds = F.regexp_replace(kinds, r"[ho].*", "")
    return F.regexp_replace(
        kinds,
        r"(?:(?<=b)s[psb]*+|\Ab++(?:s[psb]*+)?)?(?:(?<!Q)Q++(?:b++(?:s[psb]*+)?)?)*\z",
        "",
    )


def _visible_lines(lines: Column) -> Column:
    def assemble(kinds: Column) -> Column:
        # A dropped quoted line leaves a break between two fragments.
        kept = F.zip_with(
            F.slice(lines, F.lit(1), F.length(kinds)),
            F.split(kinds, "(?!^)", -1),
            lambda line, kind: F.when(kind == "Q", _BREAK).otherwise(line),
        )
        fragments = F.transform(F.split(F.array_join(kept, "\n"), _BREAK, -1), strip)
        return F.when(kinds == "", "").otherwise(
            F.array_join(F.filter(fragments, lambda fragment: fragment != ""), "\n")
        )

    return let(_visible_kinds(lines), assemble)


def _may_be_structured(text: Column) -> Column:
    """Cheap test that lets plain messages pass as they are."""
    found = text.startswith(">") | text.startswith("-")
    for sign in ("\n>", "\n-", "--", "__", "wrote:", "From:", "Sent", "To:", "Subject:", " -"):
        found = found | F.contains(text, F.lit(sign))
    return found


def visible_reply(c: Column) -> Column:
    """Text of the newest reply without quotes, their headers and signatures."""

    def reply(text: Column) -> Column:
        lines = F.split(join_attribution(text), "\n", -1)
        return F.when(_may_be_structured(text), let(lines, _visible_lines)).otherwise(strip(text))

    return let(F.replace(c, F.lit("\r\n"), F.lit("\n")), reply)
