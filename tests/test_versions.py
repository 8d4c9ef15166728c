"""Versioned state: commits, merges, lookups, streams that are killed, and epochs in stream state."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_state import body, empty_state, raw_of

from mailsieve.operators.vectors import hashing_embedder
from mailsieve.plans.sync import read_versioned, rebuild_vectors, run_sync, sync_changes
from mailsieve.schema import RAW_SCHEMA
from mailsieve.sources import versions
from mailsieve.streaming import ingest as streams

EMBED = hashing_embedder(8)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select(sorted(df.columns)).collect())))


def same_state(a, b):
    return all(rows(x) == rows(y) for x, y in ((a.emails, b.emails), (a.vectors, b.vectors), (a.kv, b.kv)))


def loads(spark):
    """Loads with new, changed, repeated and refused mail, a new epoch and an old one beside it."""
    first = [(str(i), f"first {i}", body(i)) for i in range(40)]
    yield raw_of(spark, first)
    yield raw_of(spark, [("3", "changed", body(33)), ("90", "new", body(90)), ("91", "refused", "short"), ("3", "again", body(34))])
    yield raw_of(spark, [("5", "refused", "short")])
    yield raw_of(spark, [("7", "epoch", body(7)), ("8", "epoch", body(8))], epoch=2).unionByName(raw_of(spark, [("9", "old", body(9))]))
    yield raw_of(spark, [("9", "back", body(9))], epoch=1)


def test_changes_give_the_state_of_a_whole_sync(spark, tmp_path):
    whole, folder = empty_state(spark), str(tmp_path / "state")
    for n, raw in enumerate(loads(spark)):
        whole = run_sync(spark, raw, whole, str(tmp_path / f"whole{n}"), f"t{n}", EMBED)
        assert sync_changes(spark, raw, folder, f"t{n}", EMBED).version == n + 1
        assert same_state(read_versioned(spark, folder), whole), n
    assert versions.versions(spark, folder) == [1, 2, 3, 4, 5]
    assert read_versioned(spark, folder, 1).emails.count() == 40


def test_merges_touch_full_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MAX_SEGMENTS", 3)
    folder = str(tmp_path / "state")
    sync_changes(spark, raw_of(spark, [(str(i), "first", body(i)) for i in range(300)]), folder, "t", EMBED)
    for n in range(versions.MAX_SEGMENTS):
        done = sync_changes(spark, raw_of(spark, [("7", f"change {n}", body(n))]), folder, "t", EMBED)
    sizes = sorted(len(s) for s in done.tables["emails"].values())
    assert sizes[-1] == 1 and read_versioned(spark, folder).emails.count() == 300
    first = {s.path for held in versions.read_manifest(spark, folder, 1).tables["emails"].values() for s in held}
    now = {s.path for held in done.tables["emails"].values() for s in held}
    assert len(first - now) == 1
    (row,) = versions.lookup(spark, done, "emails", "7").collect()
    assert row.subject == f"change {versions.MAX_SEGMENTS - 1}"
    before = rows(read_versioned(spark, folder).emails)
    sync_changes(spark, raw_of(spark, [("8", "x", body(1))]), folder, "t", EMBED)
    assert max(map(len, versions.compact(spark, folder).tables["emails"].values())) == 1
    versions.expire(spark, folder, keep=1)
    assert len(versions.versions(spark, folder)) == 1
    after = rows(read_versioned(spark, folder).emails)
    assert len(after) == 300 and len(set(after) - set(before)) == 1


def test_a_small_sync_writes_little(spark, tmp_path):
    folder = str(tmp_path / "state")
    size = lambda: sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())
    long = "\n".join(os.urandom(30).hex() for _ in range(400))
    sync_changes(spark, raw_of(spark, [(str(i), "first", f"{i} {long}") for i in range(500)]), folder, "t", EMBED)
    whole = size()
    sync_changes(spark, raw_of(spark, [("7", "change", body(7))]), folder, "t", EMBED)
    assert size() - whole < 0.01 * whole


def test_lookup_reads_the_segments_that_may_hold_the_uid(spark, tmp_path):
    folder = str(tmp_path / "state")
    done = sync_changes(spark, raw_of(spark, [(str(i), "s", body(i)) for i in range(200)]), folder, "t", EMBED)
    found = versions.lookup(spark, done, "emails", "42")
    assert len(found.inputFiles()) == 1 and found.first().uid == "42"
    assert versions.lookup(spark, done, "emails", "none").count() == 0


def test_two_commits_of_one_version(spark, tmp_path):
    folder = str(tmp_path / "state")
    sync_changes(spark, raw_of(spark, [("1", "a", body(1))]), folder, "t", EMBED)
    parent = versions.read_manifest(spark, folder)
    versions.commit(spark, folder, parent, {}, {"by": "one"})
    with pytest.raises(versions.CommitConflict):
        versions.commit(spark, folder, parent, {}, {"by": "two"})
    assert versions.read_manifest(spark, folder).entries == {"by": "one"}
    assert not [p for p in (tmp_path / "state" / "manifest").iterdir() if p.name.startswith(".") and "crc" not in p.name]


def test_vectors_are_built_again(spark, tmp_path):
    folder = str(tmp_path / "state")
    sync_changes(spark, raw_of(spark, [(str(i), "s", body(i)) for i in range(9)]), folder, "t", EMBED)
    assert versions.read_table(spark, versions.cleared(spark, folder, ["vectors"]), "vectors").count() == 0
    rebuild_vectors(spark, folder, hashing_embedder(16))
    state = read_versioned(spark, folder)
    assert {r[0] for r in state.vectors.select(F.size("embedding")).collect()} == {16} and state.vectors.count() == 9


def test_killed_stream_leaves_the_state_of_a_batch_sync(spark, tmp_path, monkeypatch):
    landing, target = str(tmp_path / "raw"), str(tmp_path / "stream")
    whole = empty_state(spark)
    written, kills = versions._written, {"emails": 1, "vectors": 1}

    def dying(spark_, folder, table, rows_, manifest):
        found = written(spark_, folder, table, rows_, manifest)
        if manifest.version == 2 and kills[table]:
            kills[table] -= 1
            raise RuntimeError("killed after the rows of " + table)
        return found

    monkeypatch.setattr(versions, "_written", dying)

    def run():
        stream = streams.read_stream(spark, landing, RAW_SCHEMA, max_files_per_trigger=1)
        streams.stream_state(stream, target, "t", EMBED).awaitTermination()

    for n, raw in enumerate(loads(spark)):
        raw.coalesce(1).write.mode("append").parquet(landing)
        whole = run_sync(spark, raw, whole, str(tmp_path / f"whole{n}"), "t", EMBED)
        for _ in range(2 if n == 1 else 0):
            with pytest.raises(Exception):
                run()
        run()
        run()
    assert not any(kills.values())
    folder = f"{target}/state"
    assert versions.versions(spark, folder) == [1, 2, 3, 4, 5]
    assert same_state(read_versioned(spark, folder), whole)
    # A repeated batch is passed over.
    last = versions.read_manifest(spark, folder)
    assert sync_changes(spark, raw_of(spark, [("1", "x", body(1))]), folder, "t", EMBED, ("mail", 4)) == last


def test_turns_of_several_mailboxes(spark, tmp_path):
    landing, target = str(tmp_path / "raw"), str(tmp_path / "stream")

    def load(*messages):
        made = [(box, uid, epoch, f"Subject: {subject}\n\n{body(1)}".encode(), n) for n, (box, uid, epoch, subject) in enumerate(messages)]
        df = spark.createDataFrame(made, "mailbox string, uid string, uidvalidity long, raw binary, seq long")
        df.coalesce(1).write.mode("append").parquet(landing)
        stream = streams.read_stream(spark, landing, df.schema, max_files_per_trigger=1)
        streams.stream_turns(stream, target).awaitTermination()
        found = streams.turn_emails(spark, target).collect()
        return {(r.mailbox, r.uid): r.subject for r in found}

    assert load(("a", "1", 7, "one"), ("b", "1", 7, "one"), ("b", "2", 6, "older")) == {("a", "1"): "one", ("b", "1"): "one"}
    # A lower epoch begins a new turn, and the one that returns another.
    assert load(("a", "2", 5, "two"), ("b", "2", 7, "two")) == {("a", "2"): "two", ("b", "1"): "one", ("b", "2"): "two"}
    assert load(("a", "3", 7, "three"), ("b", "1", None, "lost")) == {("a", "3"): "three", ("b", "1"): "one", ("b", "2"): "two"}
    assert load(("a", "3", 7, "changed"), ("c", "1", 1, "new")) == {
        ("a", "3"): "changed", ("b", "1"): "one", ("b", "2"): "two", ("c", "1"): "new",
    }
