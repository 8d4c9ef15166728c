"""The part tree of a MIME message, as native expressions.

A message is read as Latin-1, one character a byte, so its parts can be cut as text
and turned back into their very bytes. The tree is an array of nodes in walk order;
each round of a fold opens all multipart and message nodes of one level: a body is
cut at the lines of its own boundary, of which the closing one ends it. Rounds stop
doing anything once no node is left to open.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.headers import charset, content_type, header, header_block, message_body, transfer_encoding, unfold
from mailsieve.functions.patterns import let

#: Levels of nesting that are opened; a deeper multipart stays one part.
MAX_DEPTH = 32

_EOL = r"(?:\r\n|\n|\r)"
_MARK, _EQUALS, _END = "Ā", "ā", "\ufdd3"  # beyond Latin-1, so in no text read as Latin-1


def boundary(unfolded: Column) -> Column:
    """The boundary parameter, or an empty string."""
    value = header(unfolded, "Content-Type")
    quoted = F.regexp_extract(value, r'(?i);\s*boundary\s*=\s*"((?:[^"\\]|\\.)*)"', 1)
    bare = F.regexp_extract(value, r'(?i);\s*boundary\s*=\s*([^\s";][^;]*)', 1)
    return F.rtrim(F.when(quoted != "", F.regexp_replace(quoted, r"\\(.)", "$1")).otherwise(bare))


def _node(text: Column, unclosed: Column, inner: Column, in_digest: Column) -> Column:
    """A node that isn't opened yet. ``unclosed`` says that nothing but the end of the
    message ends it, ``inner`` that it is a part of a multipart."""

    def build(whole: Column, block: Column, lines: Column) -> Column:
        typed = F.when(in_digest & (header(lines, "Content-Type") == ""), "message/rfc822").otherwise(content_type(lines))
        return let(
            F.struct(typed.alias("kind"), boundary(lines).alias("boundary")),
            lambda own: F.struct(
                own["kind"].alias("kind"), charset(lines).alias("charset"), transfer_encoding(lines).alias("coding"),
                own["boundary"].alias("boundary"), message_body(whole, block).alias("body"), unclosed.alias("unclosed"),
                inner.alias("inner"), F.lit(True).alias("leaf"),
                ((own["kind"].startswith("multipart/") & (own["boundary"] != "")) | own["kind"].startswith("message/")).alias("opens"),
            ),
        )

    return let(text, lambda whole: let(header_block(whole), lambda block: let(unfold(block), lambda lines: build(whole, block, lines))))


def _as(node: Column, body: Column, leaf: bool) -> Column:
    """The same node, not to be opened again; one that holds others needs no body."""
    kept = [node[c].alias(c) for c in ("kind", "charset", "coding", "boundary")]
    return F.struct(
        *kept, body.alias("body"), node["unclosed"].alias("unclosed"), node["inner"].alias("inner"),
        F.lit(leaf).alias("leaf"), F.lit(False).alias("opens"),
    )


def _open_multipart(node: Column) -> Column:
    quoted = F.concat(F.lit(r"\Q"), F.replace(node["boundary"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    line_end = F.lit(r"[ \t]*(?=\r|\n|\z)")
    opening = F.concat(F.lit(_EOL + "--"), quoted, line_end)
    closing = F.concat(F.lit(_EOL + "--"), quoted, F.lit("--"), line_end)

    def parts(pieces: Column, closed: Column) -> Column:
        def part(piece: Column, at: Column) -> Column:
            last = at == F.size(pieces) - 2
            return _node(
                F.regexp_replace(piece, rf"\A{_EOL}", ""), node["unclosed"] & ~closed & last, F.lit(True),
                node["kind"] == "multipart/digest",
            )

        inside = F.transform(F.slice(pieces, 2, F.size(pieces)), part)
        return F.concat(F.array(_as(node, F.lit(""), False)), inside)

    def unopened(whole: Column, before: Column, closed: Column) -> Column:
        """The text up to a closing line, if no part began before it."""
        line_end = F.when(F.substring(whole, F.length(before) + 1, F.lit(2)) == "\r\n", 2).otherwise(1)
        kept = F.substring(whole, F.lit(2), F.length(before) + line_end - 1)
        return F.array(_as(node, F.when(closed, kept).otherwise(node["body"]), True))

    def opened(whole: Column, cut: Column, pieces: Column) -> Column:
        closed = F.size(cut) > 1
        return F.when(F.size(pieces) > 1, parts(pieces, closed)).otherwise(unopened(whole, cut[0], closed))

    # A boundary line takes all that follow it at once, whatever they say, as one with it.
    repeated = F.concat(F.lit(f"({_EOL}--"), quoted, F.lit(f"[ \\t]*+)(?:{_EOL}--"), quoted, F.lit(r"(?:--)?[ \t]*+(?=\r|\n|\z))++"))
    return let(
        F.regexp_replace(F.concat(F.lit("\n"), node["body"]), repeated, F.lit("$1")),
        lambda whole: let(
            F.split(whole, closing, 2),
            lambda cut: let(F.split(cut[0], opening), lambda pieces: opened(whole, cut, pieces)),
        ),
    )


def _open_message(node: Column) -> Column:
    """The message inside; a delivery status holds one block of headers after another."""
    status = F.filter(F.split(node["body"], rf"{_EOL}{_EOL}"), lambda block: block != "")
    texts = F.when(node["kind"] == "message/delivery-status", status).otherwise(F.array(node["body"]))
    inside = F.transform(texts, lambda text: _node(text, node["unclosed"], node["inner"], F.lit(False)))
    return F.concat(F.array(_as(node, F.lit(""), False)), inside)


def _open(node: Column) -> Column:
    return (
        F.when(node["opens"] & node["kind"].startswith("multipart/"), _open_multipart(node))
        .when(node["opens"], _open_message(node))
        .otherwise(F.array(node))
    )


def part_tree(raw: Column) -> Column:
    """All nodes of a message in walk order."""
    root = _node(F.decode(raw.cast("binary"), "ISO-8859-1"), F.lit(True), F.lit(False), F.lit(False))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_DEPTH)),
        F.array(root),
        lambda nodes, _: F.when(
            F.exists(nodes, lambda n: n["opens"]), F.flatten(F.transform(nodes, _open))
        ).otherwise(nodes),
    )


def payload(node: Column) -> Column:
    """The body of a leaf as Latin-1 text, still encoded.

    The line end before a boundary belongs to the boundary; a last part that no
    boundary ends loses one, too.
    """
    cut = F.regexp_replace(node["body"], rf"{_EOL}\z", "")
    return F.when(node["unclosed"] & node["inner"], cut).otherwise(node["body"])


def quoted_printable(text: Column) -> Column:
    """Bytes of a quoted-printable text, both as Latin-1 text.

    Runs of escapes are marked from left to right before soft line breaks go, so that
    no escape arises where a break stood. Runs that only such breaks parted become one,
    and each is decoded at once.
    """
    marked = F.regexp_replace(F.replace(text, F.lit("=="), F.lit(_EQUALS)), r"((?:=\p{XDigit}{2})++)", f"{_MARK}$1{_END}")
    joined = F.replace(F.regexp_replace(marked, r"=(?:\n|\r[^\n]*+(?:\n|\z)|\z)", ""), F.lit(_EQUALS), F.lit("="))

    def decoded(piece: Column, at: Column) -> Column:
        run = F.substring_index(piece, _END, 1)
        data = F.decode(F.unhex(F.replace(run, F.lit("="), F.lit(""))), "ISO-8859-1")
        rest = F.substring(piece, F.length(run) + 2, F.length(piece))
        return F.when(at == 0, piece).otherwise(F.concat(data, rest))

    pieces = F.transform(F.split(F.replace(joined, F.lit(_END + _MARK), F.lit("")), _MARK), decoded)
    return F.when(F.contains(text, F.lit("=")), F.array_join(pieces, "")).otherwise(text)


def base64_bytes(text: Column) -> Column:
    """Bytes of a base64 text, padded if its end is missing; null if it can't be read.

    Other characters are removed with the run of base64 before them: Java passes over a
    run much faster than it looks for a character out of a class. One is put at the end,
    so that no run is without.
    """
    others = r"([A-Za-z0-9+/=]*+)[^A-Za-z0-9+/=]++"
    kept = F.rtrim(F.regexp_replace(F.concat(text, F.lit("\n")), others, "$1"), F.lit("="))
    return F.try_to_binary(let(kept, lambda t: F.rpad(t, F.length(t) + F.pmod(-F.length(t), F.lit(4)), "=")), F.lit("base64"))
