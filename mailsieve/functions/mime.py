"""MIME parts of a message and the texts built from them.

Everything is native: a flat message in a common coding is read in place, any other
one by its part tree. Only payloads in a charset of several bytes a character (but
UTF-8), in uuencode, or in damaged base64 go to Python, in Arrow batches; every
other message sends a null there.
"""

import base64
import binascii
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions.headers import header_block, message_body
from mailsieve.functions.markup import html_to_text
from mailsieve.functions.multipart import base64_bytes, part_tree, payload, quoted_printable
from mailsieve.functions.patterns import let, or_empty, strip

# Fixed value: a plain text has to be longer than this to be preferred to HTML.
SUBSTANTIAL_CHARS = 50

_TEXT_TYPES = ("text/plain", "text/html")
_UTF8 = ("", "utf-8", "utf8")
_ASCII = ("us-ascii", "ascii")
_LATIN1 = ("iso-8859-1", "iso8859-1", "latin-1", "latin1")
_IDENTITY = ("", "7bit", "8bit", "binary")
_UUENCODE = ("x-uuencode", "uuencode", "uue", "x-uue")
#: Charsets of one byte a character, which are read as Latin-1 and then translated.
SINGLE_BYTE = (
    *(f"iso-8859-{n}" for n in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16)),
    *(f"windows-{n}" for n in range(1250, 1259)), *(f"cp{n}" for n in range(1250, 1259)),
    "koi8-r", "koi8-u", "macintosh", "tis-620", "cp437", "cp850", "cp852", "cp866",
)


def _replacements(name: str) -> tuple[str, str]:
    """What to translate where ``name`` differs from Latin-1; undefined bytes come last, without a partner."""
    pairs = [(chr(b), bytes([b]).decode(name, "ignore")) for b in range(128, 256)]
    pairs.sort(key=lambda pair: pair[1] == "")
    return "".join(a for a, b in pairs if a != b), "".join(b for a, b in pairs if a != b)


def _by_charset(name: Column, which: int) -> Column:
    """Of the charset called ``name``; the table is one constant, which the planner folds."""
    table = json.dumps({charset: _replacements(charset)[which] for charset in SINGLE_BYTE})
    return F.try_element_at(F.from_json(F.lit(table), "map<string,string>"), name)


def decode_lossy(c: Column) -> Column:
    """Bytes as UTF-8 text with invalid bytes dropped.

    Invalid bytes become replacement characters, which are then removed. Those that
    really are in the text are written as an escape meanwhile, and so is the
    noncharacter that begins the escape.
    """
    text = c.cast("string")
    escape, self_, kept = "\ufdd0", "\ufdd0\ufdd1", "\ufdd0\ufdd2"
    escaped = F.replace(F.replace(text, F.lit(escape), F.lit(self_)), F.lit("\ufffd"), F.lit(kept))
    cleaned = F.replace(F.make_valid_utf8(escaped), F.lit("\ufffd"), F.lit(""))
    restored = F.replace(F.replace(cleaned, F.lit(kept), F.lit("\ufffd")), F.lit(self_), F.lit(escape))
    return F.when(F.is_valid_utf8(text), text).otherwise(restored)


def _body_of(text: Column) -> Column:
    return message_body(text, header_block(text))


def needs_tree(kind: Column, name: Column, coding: Column, body: Column) -> Column:
    """Whether a message is more than one text in a common coding."""
    flat = ~kind.startswith("multipart/") & ~kind.startswith("message/")
    identity = coding.isin(*_IDENTITY) & name.isin(*_UTF8, *_ASCII, *_LATIN1)
    encoded = (coding == "base64") & name.isin(*_UTF8) & base64_bytes(body).isNotNull()
    return ~(flat & (identity | encoded))


def flat_part(raw: Column, kind: Column, name: Column, coding: Column, body: Column, tree: Column) -> Column:
    """The one part of a message that needs no tree; only evaluated for those."""
    latin = name.isin(*_LATIN1) & ~tree
    latin_body = F.when(latin, let(F.decode(raw.cast("binary"), "ISO-8859-1"), _body_of))
    text = (
        F.when(coding == "base64", decode_lossy(base64_bytes(body)))
        .when(name.isin(*_ASCII), F.regexp_replace(body, r"[^\x00-\x7f]", ""))
        .when(latin, latin_body)
        .otherwise(body)
    )
    other = F.when(name.isin(*_ASCII) | latin, body)
    return let(
        text,
        lambda own: F.array(
            F.struct(
                F.lit(0).alias("part_no"),
                kind.alias("content_type"),
                F.when(name == "", "utf-8").otherwise(name).alias("charset"),
                own.alias("text"),
                F.when(other != own, other).alias("utf8_text"),
            )
        ),
    )


_WORD = r"=\?([^?\s*]+)(?:\*[^?\s]*)?\?([BbQq])\?([^?\s]*)\?="
_PLAIN_WORD = r"=\?[^?\s]+\?[BbQq]\?[^?\s]*\?="


def in_charset(data: Column, name: Column) -> Column:
    """Bytes as text, without what is no character of the charset; null for charsets of several bytes but UTF-8."""
    latin = F.decode(data, "ISO-8859-1")
    return (
        F.when(name.isin(*_UTF8), decode_lossy(data))
        .when(name.isin(*_ASCII), F.regexp_replace(latin, r"[^\x00-\x7f]", ""))
        .when(name.isin(*_LATIN1), latin)
        .when(name.isin(*SINGLE_BYTE), F.call_function("translate", latin, _by_charset(name, 0), _by_charset(name, 1)))
    )


def decode_words(value: Column) -> Column:
    """A header value with its encoded words decoded.

    White space between two encoded words belongs to neither. Words in a charset that
    isn't read natively, or whose base64 is damaged, stay as they are.
    """

    def decoded(word: Column) -> Column:
        payload_ = F.regexp_extract(word, _WORD, 3)
        quoted = F.encode(quoted_printable(F.translate(payload_, "_", " ")), "ISO-8859-1")
        data = F.when(F.lower(F.regexp_extract(word, _WORD, 2)) == "q", quoted).otherwise(base64_bytes(payload_))
        return F.coalesce(in_charset(data, F.lower(F.regexp_extract(word, _WORD, 1))), word)

    def joined(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(_PLAIN_WORD), F.lit(0))
        pieces = let(
            words,
            lambda found: F.transform(
                F.split(text, _PLAIN_WORD),
                lambda rest, i: F.concat(rest, F.when(i < F.size(found), decoded(F.get(found, i))).otherwise("")),
            ),
        )
        return F.array_join(pieces, "")

    close = F.regexp_replace(value, rf"({_PLAIN_WORD})\s+(?={_PLAIN_WORD})", "$1")
    return F.when(F.contains(value, F.lit("=?")), let(close, joined)).otherwise(value)


# Parts by tree: leaves with their bytes, then texts.


def leaves(raw: Column) -> Column:
    """The parts without parts of a message, numbered in walk order, with their decoded bytes.

    ``bytes`` is null where only Python can tell them; ``encoded`` is set there.
    """

    def leaf(node: Column, number: Column) -> Column:
        coding, name = node["coding"], node["charset"]
        read = (number == 0) | node["kind"].isin(*_TEXT_TYPES)

        def build(encoded: Column, data: Column) -> Column:
            common = name.isin(*_UTF8, *_ASCII, *_LATIN1, *SINGLE_BYTE)
            return F.struct(
                number.alias("part_no"), node["kind"].alias("content_type"),
                F.when(name == "", "utf-8").otherwise(name).alias("charset"), coding.alias("coding"), read.alias("read"),
                data.alias("bytes"), F.when(read & (data.isNull() | ~common), F.encode(encoded, "ISO-8859-1")).alias("encoded"),
            )

        def decoded(encoded: Column) -> Column:
            return (
                F.when(~read | coding.isin(*_UUENCODE), F.lit(None).cast("binary"))
                .when(coding == "quoted-printable", F.encode(quoted_printable(encoded), "ISO-8859-1"))
                .when(coding == "base64", base64_bytes(encoded))
                .otherwise(F.encode(encoded, "ISO-8859-1"))
            )

        return let(payload(node), lambda encoded: let(decoded(encoded), lambda data: build(encoded, data)))

    numbered = let(part_tree(raw), lambda nodes: F.transform(nodes, lambda n, i: F.struct(n.alias("node"), i.alias("i"))))
    return F.transform(F.filter(numbered, lambda n: n["node"]["leaf"]), lambda n: leaf(n["node"], n["i"]))


_RARE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("utf8_text", T.StringType())]))
_ARROW_RARE = pa.list_(pa.struct([("text", pa.string()), ("utf8_text", pa.string())]))


def _lines_of_uu(data: bytes) -> bytes:
    out = []
    for line in data.partition(b"\nbegin ")[2].splitlines()[1:] if not data.startswith(b"begin ") else data.splitlines()[1:]:
        if line.strip() in (b"end", b"`", b""):
            break
        try:
            out.append(binascii.a2b_uu(line))
        except binascii.Error:
            out.append(binascii.a2b_uu(line[: (((line[0] - 32) & 63) * 4 + 5) // 3]))
    return b"".join(out)


def _rare_text(coding: str, name: str, encoded: bytes) -> dict:
    """A payload that native expressions don't read, in its charset and as UTF-8."""
    data = encoded
    try:
        if coding in _UUENCODE:
            data = _lines_of_uu(encoded)
        elif coding == "base64":
            data = base64.b64decode(encoded + b"===")
        elif coding == "quoted-printable":
            data = binascii.a2b_qp(encoded)
    except (binascii.Error, IndexError):
        data = encoded
    utf8 = data.decode("utf-8", errors="ignore")
    try:
        text = data.decode(name, errors="ignore").encode("utf-8", "ignore").decode("utf-8")
    except (LookupError, UnicodeError):
        text = None
    return {"text": text, "utf8_text": utf8}


@F.arrow_udf(_RARE)
def _rare_batch(rows: pa.Array) -> pa.Array:
    def texts(parts):
        return [{} if p["encoded"] is None else _rare_text(p["coding"], p["charset"], p["encoded"]) for p in parts]

    return pa.array((None if parts is None else texts(parts) for parts in rows.to_pylist()), type=_ARROW_RARE)


# Keeps the planner from evaluating the function a second time in a filter.
_rare_batch = _rare_batch.asNondeterministic()


def rare_texts(leaves_: Column) -> Column:
    """Texts of the leaves that Python has to read; null for messages that have none."""
    sent = F.transform(leaves_, lambda p: F.struct(p["coding"].alias("coding"), p["charset"].alias("charset"), p["encoded"].alias("encoded")))
    return _rare_batch(F.when(F.exists(leaves_, lambda p: p["encoded"].isNotNull()), sent))


def tree_parts(leaves_: Column, rare: Column) -> Column:
    """Array of parts with their texts."""

    def part(leaf: Column, other: Column) -> Column:
        name, data = leaf["charset"], leaf["bytes"]
        text = (
            F.when(leaf["encoded"].isNotNull(), other["text"])
            .otherwise(in_charset(data, name))
        )
        utf8 = F.when(leaf["encoded"].isNotNull(), other["utf8_text"]).when(~name.isin(*_UTF8), decode_lossy(data))
        return let(
            F.when(leaf["read"], F.struct(text.alias("text"), utf8.alias("utf8"))),
            lambda t: F.struct(
                leaf["part_no"].alias("part_no"), leaf["content_type"].alias("content_type"), name.alias("charset"),
                t["text"].alias("text"), F.when(~t["utf8"].eqNullSafe(t["text"]), t["utf8"]).alias("utf8_text"),
            ),
        )

    none = F.transform(leaves_, lambda _: F.lit(None).cast(_RARE.elementType))
    return F.zip_with(leaves_, F.coalesce(rare, none), part)


def _texts(parts: Column, kind: str) -> Column:
    return F.filter(parts, lambda p: (p["content_type"] == kind) & p["text"].isNotNull())


def unreadable(parts: Column) -> Column:
    """Parsing failed, or a text part names a charset nobody knows."""
    return parts.isNull() | F.exists(
        parts, lambda p: p["content_type"].isin(*_TEXT_TYPES) & p["text"].isNull()
    )


def plain_text(parts: Column) -> Column:
    """All plain text parts, one after the other."""
    return or_empty(F.array_join(F.transform(_texts(parts, "text/plain"), lambda p: p["text"]), "\n"))


def html_text(parts: Column) -> Column:
    """All HTML parts as text, one after the other."""
    texts = F.transform(_texts(parts, "text/html"), lambda p: html_to_text(p["text"]))
    return or_empty(F.array_join(texts, "\n"))


def first_plain(parts: Column) -> Column:
    """First plain part read as UTF-8; a message without parts counts as plain."""
    candidates = F.filter(parts, lambda p: (p["part_no"] == 0) | (p["content_type"] == "text/plain"))
    part = F.get(candidates, F.lit(0))
    return F.coalesce(part["utf8_text"], part["text"], F.lit(""))


def choose_body(plain: Column, html: Column) -> Column:
    """Plain text if it is substantial, else HTML if there is any, else plain."""
    plain, html = or_empty(plain), or_empty(html)
    return (
        F.when(F.length(strip(plain)) > SUBSTANTIAL_CHARS, plain).when(html != "", html).otherwise(plain)
    )
