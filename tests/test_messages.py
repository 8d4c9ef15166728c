"""Raw messages: headers, parts, bodies and ingest."""

import email

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from mailsieve.functions import headers, mime
from mailsieve.operators.ingest import accepted, ingest, ingest_counts, reject_counts
from mailsieve.operators.parse import explode_parts, parse_messages, with_headers
from mailsieve.sources.tables import read_raw

LONG = "A plain text that is clearly longer than fifty characters."
MULTI = (
    "Subject: s\nContent-Type: multipart/alternative; boundary=b\n\n--b\nContent-Type: text/plain\n\n{plain}\n"
    "--b\nContent-Type: text/html\n\n<p>From the page</p>\n--b--\n"
)


@pytest.fixture(scope="module")
def frame(spark):
    def make(*raws):
        rows = [(str(i), 5, r if isinstance(r, bytes) else r.encode()) for i, r in enumerate(raws)]
        return spark.createDataFrame(rows, "uid string, uidvalidity long, raw binary")

    return make


def column(df, name):
    return [r[name] for r in df.orderBy("uid").select(name).collect()]


def test_header_record(frame):
    raw = (
        "Subject: Test\nFrom: a@b.c\nTo: x@y.z\nDate: Sat, 13 Jul 2025 14:32:00 +0530\n"
        "Message-ID: <1@x>\nFROM: second@x\nCc: one,\n two\n\nBody\nTo: not a header\n"
    )
    rows = with_headers(frame(raw, "no header\n\nFrom: x", "\nFrom: body", "A: b\nbroken line\nFrom: x\n\nz"))
    records = [r["h"].asDict() for r in rows.orderBy("uid").select(
        headers.header_record(F.col("headers"), F.col("text")).alias("h")).collect()]
    assert records[0] == {
        "sender": "a@b.c", "to": "x@y.z", "cc": "one, two", "bcc": "", "date": "Sat, 13 Jul 2025 14:32:00 +0530",
        "message_id": "<1@x>", "in_reply_to": "", "references": "", "content_type": "text/plain", "size": len(raw),
    }
    assert [r["sender"] for r in records[1:]] == ["", "", ""]


def test_native_body_matches_standard_parser(spark, frame):
    raws = [
        "Subject: s\n\nbody\n\nmore\n", "Subject: s\r\nFrom: x\r\n\r\nbody\r\nmore", "\nonly body", "no header at all",
        "Subject: s\nnot a header\nrest", "Subject: s\n\n\nbody", "A: b\n\n", "A: b\n", "", "Subject: a\n b\n\nx",
    ]
    got = parse_messages(frame(*raws)).orderBy("uid").select(F.col("parts")[0]["text"].alias("t")).collect()
    want = [email.message_from_string(r).get_payload() for r in raws]
    assert [r["t"] for r in got] == want


def test_parts_native_and_parsed_agree(frame):
    raws = [
        "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\naGVsbG8gd8O2\ncmxk\n",
        "Content-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\nw=C3=B6rld=\n!\n",
        b"Content-Type: text/plain; charset=iso-8859-1\n\nw\xf6rld",
        b"Content-Type: text/plain; charset=us-ascii\n\nw\xc3\xb6rld",
        b"Subject: x\n\nw\xc3\xb6rld\xff",
        "Content-Type: broken\n\nx",
        "Content-Type: text/plain; charset=no-such-set\n\nx",
    ]
    rows = parse_messages(frame(*raws)).orderBy("uid").select(
        F.col("parts")[0]["text"].alias("t"), F.col("parts")[0]["content_type"].alias("k"),
        mime.unreadable(F.col("parts")).alias("u")).collect()
    assert [r["t"] for r in rows] == ["hello wörld", "wörld!\n", "wörld", "wrld", "wörld", "x", None]
    assert {r["k"] for r in rows} == {"text/plain"}
    assert [r["u"] for r in rows] == [False] * 6 + [True]


def test_multipart_walk(frame):
    nested = (
        "Content-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: multipart/alternative; boundary=i\n\n"
        "--i\nContent-Type: text/plain\n\none\n--i\nContent-Type: text/html\n\n<b>two</b>\n--i--\n"
        "--o\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\ndGhyZWU=\n"
        "--o\nContent-Type: application/pdf\nContent-Transfer-Encoding: base64\n\nAAAA\n--o--\n"
    )
    df = frame(nested)
    rows = explode_parts(df).orderBy("part_no").collect()
    assert [(r["part_no"], r["content_type"], r["text"]) for r in rows] == [
        (2, "text/plain", "one"), (3, "text/html", "<b>two</b>"), (4, "text/plain", "three"), (5, "application/pdf", None),
    ]
    row = parse_messages(df).select(
        mime.plain_text(F.col("parts")).alias("p"), mime.html_text(F.col("parts")).alias("h"),
        mime.first_plain(F.col("parts")).alias("f")).first()
    assert tuple(row) == ("one\nthree", "two", "one")


def test_first_plain_of_flat_html(frame):
    row = parse_messages(frame("Content-Type: text/html\n\n<p>x</p>")).select(mime.first_plain(F.col("parts"))).first()
    assert row[0] == "<p>x</p>"


@pytest.mark.parametrize(
    ("plain", "body"),
    [("x" * 50, "From the page"), ("x" * 51, "x" * 51), (LONG, LONG), ("", "From the page")],
)
def test_body_choice_at_the_limit(frame, plain, body):
    assert column(ingest(frame(MULTI.format(plain=plain))), "body") == [body]


def test_golden_messages(frame):
    df = ingest(
        frame(
            "Subject: Test Email\n\nThis is a simple plain text email.",
            "Subject: Test Email\nContent-Type: text/html; charset=utf-8\n\n<html><head></head><body>"
            "<h1>Title</h1><p>This is a test email.</p></body></html>",
            "Subject: HTML with Links\nContent-Type: text/html; charset=utf-8\n\n"
            "<p>Check <a href='http://example.com'>this</a> out!</p>",
            "Subject: Re: Forwarded\nContent-Type: text/plain; charset=utf-8\n\nRe: Fwd: Test",
        )
    )
    assert column(df, "subject") == ["Test Email", "Test Email", "HTML with Links", "Forwarded"]
    bodies = column(df, "body")
    assert bodies[0] == "This is a simple plain text email."
    assert "Title" in bodies[1] and "This is a test email." in bodies[1]
    assert bodies[2:] == ["Check this out!", "Re: Fwd: Test"]


def test_ingest_record_and_counts(frame):
    df = ingest(
        frame(
            "Subject: Test Email\nFrom: a@b.c\nDate: Sat, 13 Jul 2025 14:32:00 +0530\n\nThis is a test email body.",
            "Subject: short\n\ntoo short",
            "Subject: s\nContent-Type: text/plain; charset=nope\n\n" + LONG,
            "Subject: act now\n\n" + LONG,
            "",
        )
    )
    assert column(df, "reject_reason") == [None, "short body", "unreadable", "ACT NOW", "empty"]
    record = accepted(df).collect()
    assert len(record) == 1
    assert record[0]["sender"] == "a@b.c" and record[0]["uidvalidity"] == 5
    assert str(record[0]["date"]) == "2025-07-13 09:02:00"
    assert record[0]["search_content"] == "Test Email\nThis is a test email body."
    assert tuple(ingest_counts(df).first()) == (5, 1, 4)
    assert {r["reason"]: r["messages"] for r in reject_counts(df).collect()}["accepted"] == 1


def test_decode_keeps_real_replacement_characters(apply):
    values = [b"a\xffb", "a�b".encode(), "a�b".encode() + b"\xc3(", b"\xe2\x82", b""]
    assert apply(mime.decode_lossy, values, "binary") == ["ab", "a�b", "a�b(", "", ""]


def test_read_raw(spark, frame, tmp_path):
    frame("Subject: a\n\nb").write.parquet(str(tmp_path / "raw"))
    assert read_raw(spark, str(tmp_path / "raw")).count() == 1
    assert read_raw(spark, str(tmp_path / "none"), first_run=True).count() == 0
    with pytest.raises(AnalysisException):
        read_raw(spark, str(tmp_path / "none"))
    for uid in ("11", "12", "13"):
        (tmp_path / f"{uid}.eml").write_text(f"Subject: s{uid}\n\nbody")
    (tmp_path / "note.txt").write_text("x")
    rows = read_raw(spark, str(tmp_path), "eml", uidvalidity=9)
    assert sorted(r["uid"] for r in rows.collect()) == ["11", "12", "13"]
    with pytest.raises(ValueError):
        read_raw(spark, "x", "mbox")
