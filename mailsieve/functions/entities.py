"""HTML character references, decoded with native expressions."""

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.patterns import let

# Checked first because nearly all references in mail are one of these.
_FREQUENT = ("amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "copy;", "middot;")

_REPLACEMENT = "\ufffd"

# A numeric reference, or a name that is closed by a semicolon.
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)"

# Control characters and noncharacters are left out.
_DROPPED = r"[\x01-\x08\x0b\x0e-\x1f\x7f\x{fdd0}-\x{fdef}%s]" % "".join(
    rf"\x{{{plane:x}fffe}}\x{{{plane:x}ffff}}" for plane in range(17)
)


def _literal_map(entries: dict[str, str]) -> Column:
    # One foldable expression instead of one literal per entry.
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _windows_1252() -> dict[str, str]:
    """Numbers 128..159 name Windows-1252 characters, where one is defined."""
    out = {}
    for code in range(0x80, 0xA0):
        try:
            out[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            out[str(code)] = chr(code)
    return out


def code_point(n: Column) -> Column:
    """The character with code point ``n`` (Spark's ``chr`` wraps at 256)."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _character(number: Column) -> Column:
    """The character a numeric reference stands for."""

    def decode(n: Column) -> Column:
        character = code_point(n)
        return (
            F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), _REPLACEMENT)
            .when(n.between(0x80, 0x9F), F.try_element_at(_literal_map(_windows_1252()), n.cast("string")))
            .when(character.rlike(_DROPPED), "")
            .otherwise(character)
        )

    return let(number, decode)


def _number(reference: Column) -> Column:
    """Value of ``#65`` or ``#x41``; anything too long is out of range."""
    decimal = F.regexp_extract(reference, r"^#0*([0-9]*)", 1)
    hexadecimal = F.regexp_extract(reference, r"^#[xX]0*([0-9a-fA-F]*)", 1)
    value = F.when(
        reference.rlike("^#[xX]"),
        F.when(F.length(hexadecimal) < 7, F.conv(hexadecimal, 16, 10)),
    ).otherwise(F.when(F.length(decimal) < 8, F.concat(F.lit("0"), decimal)))
    return F.coalesce(F.when(value == "", "0").otherwise(value).try_cast("int"), F.lit(0x110000))


def _segment(s: Column) -> Column:
    """Decode the text that followed one ampersand."""
    named = {k: v for k, v in html5.items() if k.endswith(";")}
    bare = {k: v for k, v in html5.items() if not k.endswith(";")}
    bare_alternatives = "|".join(sorted(bare, key=lambda k: (-len(k), k)))

    def resolve(name: Column) -> Column:
        value = F.coalesce(
            F.when(name.startswith("#"), _character(_number(name))),
            F.try_element_at(_literal_map({k: named[k] for k in _FREQUENT}), name),
            F.try_element_at(_literal_map(named), name),
        )

        def splice(prefix: Column) -> Column:
            return F.when(
                prefix != "",
                F.concat(
                    F.try_element_at(_literal_map(bare), prefix),
                    F.substring(s, F.length(prefix) + 1, F.length(s)),
                ),
            ).otherwise(F.concat(F.lit("&"), s))

        rest = F.substring(s, F.length(name) + 1, F.length(s))
        without_semicolon = let(F.regexp_extract(s, f"^({bare_alternatives})", 1), splice)
        return F.coalesce(F.when(name != "", F.concat(value, rest)), without_semicolon)

    return let(F.regexp_extract(s, _REFERENCE, 1), resolve)


def unescape(c: Column) -> Column:
    """Decode named, decimal and hexadecimal references in one pass."""

    def decode(text: Column) -> Column:
        pieces = F.split(text, "&", -1)
        rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _segment)
        return F.when(
            F.contains(text, F.lit("&")), F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))
        ).otherwise(text)

    return let(c, decode)
