import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from mailsieve.functions import entities, markup, patterns, quality, reply, text


def test_strip_and_collapse_match_python(apply):
    values = ["  a b ", " \n x\ty \x1f", "", " 　", "a\x85b"]
    assert apply(patterns.strip, values) == [v.strip() for v in values]
    assert apply(patterns.collapse, values) == [re.sub(r"\s+", " ", v) for v in values]


def test_unescape_matches_python(apply):
    values = [
        "a &amp; b", "&amp;amp;", "&lt;&gt;&quot;&apos;&nbsp;", "&copy &copy; &copyx &notit; &notin;",
        "&#65;&#x41;&#X41", "&#0; &#128; &#x80; &#150; &#xD800; &#x110000; &#99999999999999999999;",
        "&#1; &#xb; &#127; &#xfdd0; &#x1ffff; &#13;", "&& & &; &#; &#x; &unknown; &amp", "&CounterClockwiseContourIntegral;",
        "&NotEqualTilde;", "&#128512;", "plain", "", "&ampamp;", "&AMP&lt", "x&", "&#0065;&#x00041",
        "&frac12;&Eacute;&eacute", "&gt;&gtr;&gtx",
    ]
    assert apply(entities.unescape, values) == [html.unescape(v) for v in values]


def test_unescape_random(apply):
    rng = random.Random(5)
    pieces = ["&", "amp", ";", "#", "x", "41", "lt", "copy", " ", "é", "not", "in", "128", "0"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(400)]
    assert apply(entities.unescape, values) == [html.unescape(v) for v in values]


def test_clean_subject(apply):
    values = ["Re: Forwarded", "FWD:  a  b", "fw:x", "Re: Re: x", " Re: kept", "A &amp; B\n C", "", None, "Reply"]
    assert apply(text.clean_subject, values) == [
        "Forwarded", "a b", "x", "Re: x", "Re: kept", "A & B C", "", "", "Reply",
    ]


def test_masking_matches_python(apply):
    values = [
        "see https://a.b/c?d now", "http://x", "mail a.b@c.de, (x-y@z.org)", "café.x@é.fr", "a@b.c-x@y.z",
        "a@b", "..@..a", "x@y.z@w.v", "w" * 5000, "https://é.fr/ü z",
    ]
    urls = [re.sub(r"https?://[^\s]+", "[URL]", v) for v in values]
    mails = [re.sub(r"[\w\.-]+@[\w\.-]+\.\w+", "[EMAIL]", v) for v in values]
    assert apply(text.mask_urls, values) == urls
    assert apply(text.mask_emails, values) == mails


def test_masking_is_idempotent(apply):
    values = ["a@b.cd https://x.y", "q", "a@b.c@d.e http://a@b.c"]
    once = apply(lambda c: text.mask_emails(text.mask_urls(c)), values)
    assert apply(lambda c: text.mask_emails(text.mask_urls(c)), once) == once


def test_body_steps(apply):
    assert apply(text.normalize_newlines, ["a\n\n\n\nb\n\nc"]) == ["a\n\nb\n\nc"]
    assert apply(text.normalize_spaces, ["a \t b\t"]) == ["a b "]
    assert apply(text.strip_signature, ["a\n-- \nb\nc", "-----\nx", "a -- b"]) == ["a\n", "---", "a -- b"]
    assert apply(text.strip_reply_attribution, ["x On a wrote: On b wrote: y\nOn c\nwrote:"]) == [
        "x  y\nOn c\nwrote:"
    ]
    assert apply(text.strip_quoted_headers, ["Reply-To: x\nb\nFrom: y\nTo: last"]) == ["Reply-b\nTo: last"]


def test_clean_body(apply):
    body = (
        "Dear all,\n\n\n\nsee https://ex.org/1 \t or a.b@ex.org\n"
        "On 1 Jan 2024, x wrote:\n> quoted\n\n-- \nsignature"
    )
    assert apply(text.clean_body, [body, "", None, "Re: Fwd: Test"]) == [
        "Dear all,\n\nsee [URL] or [EMAIL]", "", "", "Re: Fwd: Test",
    ]


def test_clean_simple(apply):
    values = [
        "<p>Hi  <b>you</b></p>\n http://a.b/c", "x ---- Original Message ---- y", "a On b wrote: c On d",
        "On the table", "a wrote: On b", "---Original Message-", "", None, "On wrote:", "x On On wrote: y",
    ]

    def expected(v):
        if not v:
            return ""
        v = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", v))
        v = re.sub(r"-+\s*Original Message\s*-+.*", "", v, flags=re.DOTALL)
        v = re.sub(r"On .* wrote:.*", "", v, flags=re.DOTALL)
        return re.sub(r"https?://[^\s]+", "[URL]", v).strip()

    assert apply(text.clean_simple, values) == [expected(v) for v in values]


def test_search_text(spark):
    df = spark.createDataFrame([("S", "a [URL]\n\n\nb [EMAIL] "), (None, None)], "s string, b string")
    rows = [r[0] for r in df.select(text.search_text(F.col("s"), F.col("b"))).collect()]
    assert rows == ["S\na \nb", ""]


@pytest.mark.parametrize(
    ("message", "visible"),
    [
        ("Hello\nWorld", "Hello\nWorld"),
        ("Hi\n\nOn Monday, x wrote:\n> old\n> older", "Hi"),
        ("Hi\nOn Mon, Jan 1, 2024 at 9:00, x <x@ex.org>\nwrote:\n> old", "Hi"),
        ("Hi\nOn Mon, x\n<x@ex.org> at nine\nhe wrote:\n> old", "Hi"),
        ("Hi\n\nFrom: x\nSent: y\n\nold text", "Hi"),
        ("Hi\n\n-- \nJoe\nphone", "Hi"),
        ("Hi\n-- \nJoe", "Hi\n-- \nJoe"),
        ("Hi\n\nSent from my small phone", "Hi"),
        ("On Monday x wrote:\n> old\n\nanswer below", "answer below"),
        ("first\n> q1\n\nsecond\n> q2\nthird", "first\nsecond\nthird"),
        ("> only quoted", ""),
        ("a\n\n__\nb\n\n--\nc", "a"),
        ("a\r\n> q\r\nb", "a\nb"),
        ("", ""),
        ("On the way we wrote:", ""),
        ("text\n\n\n", "text"),
    ],
)
def test_visible_reply(apply, message, visible):
    assert apply(reply.visible_reply, [message]) == [visible]


def test_visible_reply_long_input(apply):
    quoted = "top\n" + "> q\n" * 20000 + "\n" * 5000 + "end"
    assert apply(reply.visible_reply, [quoted]) == ["top\nend"]


def test_html_to_text(apply):
    page = (
        "<html><head><title>T</title></head><body><script>var a='<p>x</p>';</script><style>p{}</style>"
        "<h1>Title</h1><p>This is a <b>test</b>\n email.</p><!-- no --><ul><li>one<li>two</ul>a<br>b"
        "<img src='x'>&nbsp;&eacute;&lt;p&gt; 1 < 2</body></html>"
    )
    link = "<p>Check <a href='http://example.com'>this</a> out!</p>"
    assert apply(markup.html_to_text, [page, link, "", None, "<script>open"]) == [
        "# Title\n\nThis is a test email.\n\n  * one\n  * two\n\na\nb é<p> 1 < 2", "Check this out!", "", "", "",
    ]


def test_quoted_blocks_of_html_are_quotes(apply):
    nested = "<p>answer</p><blockquote>a<br>b<blockquote><p>older</p></blockquote></blockquote><p>end</p>"
    texts = ["<p>answer</p><blockquote><p>old text</p></blockquote>", nested, "x<blockquote>open<br>y"]
    found = apply(markup.html_to_text, texts)
    assert found == ["answer\n\n> old text", "answer\n\n> a\n> b\n> \n> > older\n\nend", "x\n\n> open\n> y"]
    assert apply(reply.visible_reply, found) == ["answer", "answer\nend", "x"]


@pytest.mark.parametrize("piece", ["w", "-", " ", "\n", "> q\n", "<", "On ", "From:", "a@", "<!--", "&", "\n--\nx", "On x\n"])
def test_long_runs_stay_linear(spark, piece):
    df = spark.range(1).select(F.repeat(F.lit(piece), 40000).alias("t"))
    start = time.time()
    df.select(*(F.length(f(F.col("t"))) for f in (text.clean_body, text.clean_simple, markup.html_to_text))).collect()
    assert time.time() - start < 15


@pytest.mark.parametrize(
    "function, text",
    [
        (reply.visible_reply, lambda n: "-- " + "\n" * n + "text\n> q\nend"),
        (lambda c: quality.spam_pattern(c, c), lambda n: "URGENT " * (n // 7) + "\nREPL"),
        (markup.html_to_text, lambda n: "<head " * (n // 6) + "</head>" + "<head " * (n // 6)),
    ],
)
def test_mixed_texts_stay_linear(spark, function, text):
    """Doubling the text at most about doubles the time."""
    times = []
    for n in (40_000, 160_000):
        df = spark.createDataFrame([(text(n),)], "v string")
        start = time.time()
        df.select(function(F.col("v"))).collect()
        times.append(time.time() - start)
    assert times[1] < 8 * times[0] + 2 and times[1] < 20
