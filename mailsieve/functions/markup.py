"""HTML to text by a chain of native replacements."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.entities import unescape
from mailsieve.functions.patterns import let, or_empty, strip, up_to_last

BLOCK_TAGS = (
    "address|article|aside|blockquote|body|caption|center|dd|div|dl|dt|fieldset|figure|footer|form|"
    "h[1-6]|header|hr|html|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)

# Stand-ins for a heading mark and a list indent until white space is settled.
_HEADING = "\x02"
_INDENT = "\x03"
# Bounds of a quoted block until lines are settled.
_QUOTE, _UNQUOTE = "\x04", "\x05"


def _replace_tags(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)<br\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"(?i)<h([1-6])\b[^>]*>", f"\n\n{_HEADING}$1 ")
    for level in range(1, 7):
        c = F.replace(c, F.lit(f"{_HEADING}{level}"), F.lit("#" * level))
    c = F.regexp_replace(c, r"(?i)<li\b[^>]*>", f"\n{_INDENT}* ")
    c = F.regexp_replace(c, r"(?i)<blockquote\b[^>]*>", f"\n\n{_QUOTE}")
    c = F.regexp_replace(c, r"(?i)</blockquote\b[^>]*>", f"{_UNQUOTE}\n\n")
    c = F.regexp_replace(c, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n\n")
    return F.regexp_replace(c, r"</?[A-Za-z!][^>]*>", "")


def _quote_lines(c: Column) -> Column:
    """Put ``> `` before every line of a quoted block.

    Blocks inside a block are part of it; one that isn't closed reaches to the end.
    Each match goes on where the one before it ended, so a text is read once.
    """
    c = F.regexp_replace(c, f"{_QUOTE}[ \n{_QUOTE}]*", _QUOTE)
    c = F.regexp_replace(c, f"[ \n{_UNQUOTE}]*{_UNQUOTE}", _UNQUOTE)
    inside = rf"({_QUOTE}|\G(?!\A)(?<!{_UNQUOTE}))([^\n{_UNQUOTE}]*)\n"
    c = F.regexp_replace(c, inside, "$1$2\n> ")
    return F.translate(F.replace(c, F.lit(_QUOTE), F.lit("> ")), _UNQUOTE, "")


def html_to_text(c: Column) -> Column:
    """Visible text of an HTML document: no scripts, links, images or emphasis.

    Quoted blocks have ``> `` before their lines, so that the reply rules know them.
    Headings keep ``#`` marks and list items a ``  * `` bullet; lines are not
    wrapped and at most one blank line separates blocks.
    """
    c = or_empty(c)
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)", "")
    c = up_to_last(c, "-->", lambda t: F.regexp_replace(t, r"(?s)<!--.*?-->", ""))
    c = F.regexp_replace(c, r"(?i)</head\s*>", "</head>")
    c = up_to_last(c, "</head>", lambda t: F.regexp_replace(t, r"(?is)<head\b.*?</head>", ""))
    c = F.regexp_replace(c, r"[ \t\r\n\f]+", " ")
    c = up_to_last(c, ">", _replace_tags)
    c = F.replace(unescape(c), F.lit("\u00a0"), F.lit(" "))
    c = F.regexp_replace(c, r" *\n *", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = let(c, lambda t: F.when(F.contains(t, F.lit(_QUOTE)), _quote_lines(t)).otherwise(t))
    return F.replace(strip(c), F.lit(_INDENT), F.lit("  "))
