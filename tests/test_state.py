"""Upserts, epochs, status, sync and streams."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from mailsieve.functions import display
from mailsieve.operators import listing, status, store
from mailsieve.operators.vectors import hashing_embedder
from mailsieve.plans.sync import State, read_state, run_sync, sync
from mailsieve.schema import EMAILS_SCHEMA, KV_SCHEMA, RAW_SCHEMA, VECTORS_SCHEMA
from mailsieve.session import shared_folder
from mailsieve.sources import tables
from mailsieve.streaming import ingest as streams

MAIL = "uid string, subject string, sender string, body string, date timestamp_ntz, uidvalidity long"


def body(i):
    return f"this is the body number {i} of a message"


@pytest.fixture()
def emails(spark):
    return spark.createDataFrame(
        [
            ("1", "Test Email 1", "sender1@example.com", "This is the first test email", datetime(2025, 7, 13), 123456),
            ("2", "Test Email 2", "sender2@example.com", "This is the second test email", datetime(2025, 7, 14), 123456),
        ],
        MAIL,
    )


def raw_of(spark, messages, epoch=1):
    rows = [(uid, epoch, f"Subject: {subject}\n\n{text}".encode(), n) for n, (uid, subject, text) in enumerate(messages)]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def empty_state(spark):
    return State(*(spark.createDataFrame([], s) for s in (EMAILS_SCHEMA, VECTORS_SCHEMA, KV_SCHEMA)))


def test_upsert_replaces_whole_rows(spark, emails):
    update = spark.createDataFrame(
        [
            ("1", "older", "x", "x", datetime(2025, 7, 1), 1, 0),
            ("1", "Modified Test Email 1", "modified@example.com", "Modified", datetime(2025, 7, 15), 123456, 1),
        ],
        MAIL + ", seq int",
    )
    result = store.upsert(emails, update, "uid", ["seq"])
    assert result.count() == 2
    row = listing.get_email(result, "1").first()
    assert (row["subject"], row["sender"]) == ("Modified Test Email 1", "modified@example.com")
    assert [r["uid"] for r in listing.newest(result).collect()] == ["1", "2"]
    assert listing.get_email(result, "999").count() == 0
    assert store.cleared(result).count() == 0


def test_latest_is_independent_of_order_and_skew(spark):
    rows = [("hot" if i % 3 else str(i), i * 7919 % 1000, f"v{i}") for i in range(3000)]
    newest = {}
    for key, seq, value in rows:
        newest[key] = max(newest.get(key, (-1, "")), (seq, value))
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, seq int, v string").repartition(7)
        got = {r["k"]: (r["seq"], r["v"]) for r in store.latest(df, "k", ["seq"]).collect()}
        assert got == newest


def test_latest_combines_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"))
    plan = store.latest(df, "k", ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_kv(spark):
    kv = spark.createDataFrame([], KV_SCHEMA)
    assert store.kv_get(kv, "last_fetch").first()["value"] == "Never"
    kv = store.kv_set(store.kv_set(kv, "last_fetch", "a"), "last_fetch", "b")
    assert [tuple(r) for r in kv.collect()] == [("last_fetch", "b")]
    assert store.kv_get(kv, "last_fetch").first()["value"] == "b"


@pytest.mark.parametrize(
    ("stored", "changed"), [(None, False), ("123456", False), ("654321", True), ("not a number", False)]
)
def test_epoch(spark, emails, stored, changed):
    kv = spark.createDataFrame([("uidvalidity", stored)] if stored else [], KV_SCHEMA)
    assert store.epoch_changed(kv, emails).first()["changed"] is changed


def test_status(spark, emails):
    none = spark.createDataFrame([], VECTORS_SCHEMA)
    kv = spark.createDataFrame([], KV_SCHEMA)
    row = status.status(emails, none, kv).first()
    assert (row["emails"], row["vectors"], row["in_sync"], row["offline_available"]) == (2, 0, False, False)
    lines = [tuple(r) for r in status.status_rows(store.cleared(emails), none, kv).collect()]
    assert lines[0] == ("Database", "0 emails", "No emails")
    assert lines[2][1] == "Never" and lines[3][1] == "Up to date"


def test_views(spark):
    row = spark.createDataFrame(
        [("1", "s" * 51, "x" * 30, "b" * 201, None)], "uid string, subject string, sender string, body string, date timestamp_ntz"
    )
    shown = listing.list_columns(row).first()
    assert (shown["subject"], shown["sender"], shown["date"]) == ("s" * 50 + "...", "x" * 30, "N/A")
    assert row.select(display.preview(F.col("body"))).first()[0] == "b" * 200 + "..."
    text = listing.rendered(row.withColumn("body", F.lit(None).cast("string"))).first()["text"]
    assert text.startswith("\nSubject: sss") and "\nDate: Unknown Date\nUID: 1\n\n\n    " in text
    top = listing.list_view(row.crossJoin(spark.range(3).drop("id")), limit=2).collect()
    assert len(top) == 2 and top[0]["total"] == 3


def test_sync_keeps_state_and_embeds_new_mail(spark, tmp_path):
    raw = raw_of(spark, [("1", "a", body(1)), ("2", "b", "short"), ("3", "c", body(3))])
    first = run_sync(spark, raw, empty_state(spark), str(tmp_path / "s1"), "t1", hashing_embedder(8))
    assert sorted(r["uid"] for r in first.emails.collect()) == ["1", "3"]
    assert first.vectors.count() == 2
    assert dict(map(tuple, first.kv.collect())) == {"uidvalidity": "1", "last_fetch": "t1"}

    again = raw_of(spark, [("3", "changed", body(33)), ("4", "d", body(4))])
    second = sync(again, read_state(spark, str(tmp_path / "s1")), "t2", hashing_embedder(8))
    assert {r["uid"]: r["subject"] for r in second.emails.collect()} == {"1": "a", "3": "changed", "4": "d"}
    assert sorted(r["uid"] for r in second.vectors.collect()) == ["1", "3", "4"]

    reset = sync(raw_of(spark, [("1", "new", body(5))], epoch=2), first, "t3", hashing_embedder(8))
    assert [r["subject"] for r in reset.emails.collect()] == ["new"]
    assert reset.vectors.count() == 1
    assert store.kv_get(reset.kv, "uidvalidity").first()["value"] == "2"


def test_sync_of_repeated_uids_and_old_epochs(spark, tmp_path):
    rows = [("1", 5, b"Subject: zeta first\n\n" + body(1).encode() + b" omega", 1), ("1", 5, b"Subject: beta second\n\n" + body(1).encode(), 2)]
    rows += [("2", 4, b"Subject: old epoch\n\n" + body(2).encode(), 3)]
    new = run_sync(spark, spark.createDataFrame(rows, RAW_SCHEMA), empty_state(spark), str(tmp_path / "s"), "t", hashing_embedder(64))
    assert [(r["uid"], r["subject"]) for r in new.emails.collect()] == [("1", "beta second")]
    own = new.emails.select("uid", hashing_embedder(64)(F.col("body")).alias("own")).join(new.vectors, "uid")
    assert own.where("own = embedding").count() == 1
    with pytest.raises(ValueError):
        sync(spark.createDataFrame(rows, RAW_SCHEMA).drop("seq"), empty_state(spark), "t")


def test_missing_paths_are_errors_but_on_a_first_run(spark, tmp_path):
    with pytest.raises(AnalysisException):
        tables.read_emails(spark, str(tmp_path / "absent")).count()
    with pytest.raises(AnalysisException):
        read_state(spark, str(tmp_path / "absent"))
    assert read_state(spark, str(tmp_path / "absent"), first_run=True).emails.count() == 0


def test_shared_folder_is_asked_for_off_this_machine(spark, monkeypatch):
    class Far:
        conf = type("conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("context", (), {"master": "spark://host:1", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        shared_folder(Far)


def test_sync_without_valid_mail_changes_nothing(spark):
    kv = spark.createDataFrame([("uidvalidity", "1"), ("last_fetch", "t0")], KV_SCHEMA)
    state = State(*(spark.createDataFrame([], s) for s in (EMAILS_SCHEMA, VECTORS_SCHEMA)), kv)
    new = sync(raw_of(spark, [("1", "a", "short")]), state, "t1")
    assert dict(map(tuple, new.kv.collect())) == {"uidvalidity": "1", "last_fetch": "t0"}
    assert new.emails.count() == 0 and new.vectors.count() == 0


def test_lookup_uses_bloom_filter(spark, emails, tmp_path):
    tables.write_emails(emails, str(tmp_path / "e"))
    assert tables.read_emails(spark, str(tmp_path / "e")).where("uid = '2'").count() == 1
    plan = listing.get_email(tables.read_emails(spark, str(tmp_path / "e")), "2")._jdf.queryExecution().executedPlan()
    assert "EqualTo(uid,2)" in plan.toString()


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    landing, target = str(tmp_path / "raw"), str(tmp_path / "state")
    raw_of(spark, [(str(i), "first", body(i)) for i in range(20)]).coalesce(2).write.parquet(landing)

    def run():
        stream = streams.read_stream(spark, landing, RAW_SCHEMA, max_files_per_trigger=1)
        streams.stream_sync(stream, target).awaitTermination()
        return {r["uid"]: r["subject"] for r in streams.current_emails(spark, target).collect()}

    assert run() == {str(i): "first" for i in range(20)}
    raw_of(spark, [("3", "second", body(3)), ("90", "second", body(90))]).coalesce(1).write.mode("append").parquet(landing)
    after = run()
    assert (after["3"], after["90"], after["4"], len(after)) == ("second", "second", "first", 21)
    assert run() == after
    raw_of(spark, [("7", "epoch", body(7))], epoch=2).coalesce(1).write.mode("append").parquet(landing)
    assert run() == {"7": "epoch"}
    # The epoch that came last counts, also if it is a lower one.
    raw_of(spark, [("8", "lower", body(8))], epoch=1).coalesce(1).write.mode("append").parquet(landing)
    assert run() == {"8": "lower"}


def test_first_seen(spark, tmp_path):
    landing = str(tmp_path / "in")
    spark.range(100).select((F.col("id") % 7).alias("k"), F.lit(datetime(2025, 1, 1)).cast("timestamp").alias("ts")).coalesce(1).write.parquet(landing)
    schema = spark.read.parquet(landing).schema
    for event_time in (None, "ts"):
        stream = streams.first_seen(streams.read_stream(spark, landing, schema), "k", event_time)
        out = str(tmp_path / f"out-{event_time}")
        (stream.writeStream.option("checkpointLocation", out + "-cp").trigger(availableNow=True)
         .start(out, format="parquet").awaitTermination())
        assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == list(range(7))
